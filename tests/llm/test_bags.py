import math
import re

import duckdb
import pytest

from dailyfolio.llm import bags
from dailyfolio.llm.words import table
from tests.llm.conftest import ODD, frame, prose

SF = "/root/testdata/sf0.001"
BENCH = "item_id bigint, text string, doc_id string"


def split(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, top=10):
    """Every document scored for every item, as (item_id, rank, doc_id, score)."""
    held = [(i, split(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for i, t in held:
            m = 100 - 90 + (90 * len(t) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * t.count(w)) // (1000 * t.count(w) + 8 * m))
                        for w in set(split(text)) & set(t))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top], 1)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def got(found):
    return key([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()])


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "The stone, the RIVER; winter-bread 12"), (2, prose(4, 40)), (2, prose(4, 40)), (3, None), (4, " .,; "),
            (5, "unknown terms only-here"), (None, "valley Valley"), (6, "ünïcode ßtraße 漢字 a"), (7, "word 1")]
    return spark.createDataFrame([(*r, "x") for r in rows], BENCH), rows


def test_ranks_equal_the_plain_ones_with_classes_of_copies(spark, items):
    texts = [prose(i % 23, 5 + 7 * (i % 11)) for i in range(70)] + [prose(4, 40)] * 30 + ["the stone"] * 25 + [None, "", "zzz"]
    docs = frame(spark, texts)
    want = key(plain(list(enumerate(texts)), [r for r in items[1] if r[1] is not None]))
    assert got(bags.ranked(docs, items[0])) == want
    assert got(bags.ranked(docs, items[0], block_terms=60)) == want


def test_odd_documents_repeats_and_empty_tables(spark, odd, nothing, items):
    docs = odd.unionByName(odd)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(bags.ranked(docs, items[0])) == key(plain(rows, [r for r in items[1] if r[1] is not None]))
    assert got(bags.ranked(nothing, items[0])) == []
    assert bags.ranked(odd, items[0].limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(str(x) for x in ODD) + prose(9, 900)
    whole = [w for part in bags.words(text) for w in part]
    assert whole == [w.encode() for w in split(text)]
    monkeypatch.setattr(bags, "PIECE", 50)
    assert [w for part in bags.words(text) for w in part] == whole
    numbers = {w: i for i, w in enumerate(dict.fromkeys(whole))}
    n, terms, counts = bags.bag_of(text, numbers)
    assert n == len(whole) == counts.sum() and [whole.count(w) for w in numbers] == counts.tolist()
    assert terms.tolist() == sorted(numbers.values())


def test_sql_states_the_same(spark):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    want = key(c.execute(bags.sql()).fetchall())
    assert want and got(bags.ranked(table(spark, SF, "documents"), table(spark, SF, "benchmark"))) == want
