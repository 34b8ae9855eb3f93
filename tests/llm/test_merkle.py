import hashlib
import zlib

import duckdb
import pytest

from dailyfolio.llm import merkle
from dailyfolio.llm.words import table
from tests.llm.conftest import frame, prose

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, fan):
    """The root and each leaf's siblings, as (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % fan:k - k % fan + fan]
            paths[i].append(("".join(run[:k % fan]), "".join(run[k % fan + 1:])))
        nodes = [h(*nodes[k:k + fan]) for k in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], paths


def plain(rows, fan=2):
    """The manifest of dicts as a list of tuples."""
    columns = merkle.COLUMNS
    trees = {}
    for r in rows:
        changed = dict(r)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            changed["n_chars"] += 1
        trees.setdefault(r["lang"], []).append(
            (r["doc_id"], h(*[cell(r[c]) for c in columns]), h(*[cell(changed[c]) for c in columns])))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[lang] = climb([leaf for _, leaf, _ in trees[lang]], fan)
    root, above = climb([made[lang][0] for lang in langs], fan) if langs else (None, [])
    out = []
    for lang, up in zip(langs, above):
        for (doc_id, leaf, claimed), path in zip(trees[lang], made[lang][1]):
            fold = claimed
            for before, after in path + up:
                fold = h(before, fold, after)
            out.append((doc_id, leaf, made[lang][0], root, h(*[a + b for a, b in path + up]), fold, fold == root))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r if not isinstance(x, bool)))


def got(docs, **kw):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return key([tuple(r[n] for n in names) for r in merkle.verified(merkle.manifest(docs, **kw)).collect()])


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 0, 4, 5), (17, 1, 9), (64, 33, 1, 2, 8)])
def test_trees_equal_the_plain_ones(spark, sizes):
    langs = [lang for lang, n in zip(["en", None, "ä", "de", "zz"], sizes) for _ in range(n)]
    docs = frame(spark, [prose(i, i % 7) for i in range(len(langs))], lang=langs)
    rows = [r.asDict() for r in docs.collect()]
    for fan, height in ((2, 2), (2, 8), (3, 1), (4, 2)):
        assert got(docs, fan=fan, height=height) == key(plain(rows, fan)), (fan, height)


def test_sql_states_the_same(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    cursor = c.execute(merkle.sql())
    names = [d[0] for d in cursor.description]
    order = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = key([tuple(r[names.index(n)] for n in order) for r in cursor.fetchall()])
    assert got(table(spark, SF, "documents")) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_odd_rows_repeats_and_an_empty_table(spark, odd, nothing):
    docs = odd.unionByName(odd)
    assert got(docs) == key(plain([r.asDict() for r in docs.collect()]))
    assert got(nothing) == []
    top = spark.createDataFrame([(38, "x", "en", "s", 2 ** 63 - 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert all(r[-1] for r in got(top))
