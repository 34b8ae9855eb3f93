"""Ranked lexical search over bags of words that are scored once.

A document only matters through its counts of the items' terms and through its length weight ``m``.
Every document is cut down to that in its own row; rows whose hash, ``m`` and counts agree are one
class, found by the hash and verified by the whole vector. A class is scored once against every item, each task keeps
an item's best classes, and only the classes that win are expanded into their documents, by ascending id.

Items are taken in blocks with a bounded number of terms, one block at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.llm.words import blocks
from dailyfolio.operators.ranking import keep_ranked
from dailyfolio.session import written

TOP = 10
#: Terms of the items of a block, about, as long as no item has more on its own; what is sent to tasks and driver at once.
BLOCK_TERMS = 1 << 18
#: Bytes whose words are held at once.
PIECE = 1 << 20
#: Cells of the matrix of a group of classes.
CELLS = 1 << 21

#: ASCII letters in lower case, digits and all bytes of other characters; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The terms in order, in lists of bounded size; null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass(frozen=True)
class Items:
    """The items of a block: each term's number, and the items' term numbers one after the other."""

    ids: list
    numbers: dict[bytes, int]
    terms: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str]) -> Items:
        numbers: dict[bytes, int] = {}
        terms: list[int] = []
        first = []
        for text in texts:
            held = dict.fromkeys(w for part in words(text) for w in part)
            first.append(len(terms))
            terms += [numbers.setdefault(w, len(numbers)) for w in held]
        return Items(ids, numbers, np.array(terms, np.int64), np.array(first, np.int64))


def bag_of(text: str | None, numbers: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of terms, and the known ones in ascending order with their counts."""
    n, held = 0, Counter()
    for part in words(text):
        n += len(part)
        found = np.fromiter(map(numbers.get, part, repeat(-1)), np.int64, len(part))
        at, count = np.unique(found[found >= 0], return_counts=True)
        held.update(dict(zip(at.tolist(), count.tolist())))
    terms = np.array(sorted(held), np.int32)
    return n, terms, np.array([held[t] for t in terms.tolist()], np.int64)


def bags(docs: DataFrame, items: Items) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with at least one term."""
    numbers = items.numbers

    @F.pandas_udf("struct<n: bigint, terms: array<int>, tfs: array<bigint>>")
    def made(texts: pd.Series) -> pd.DataFrame:
        out = [bag_of(x, numbers) for _, part in blocks(texts) for x in part]
        return pd.DataFrame({"n": np.array([n for n, _, _ in out], np.int64),
                             "terms": pd.Series([t for _, t, _ in out], dtype=object),
                             "tfs": pd.Series([c for _, _, c in out], dtype=object)})

    return docs.select("doc_id", made.asNondeterministic()(F.col("text")).alias("b")).select("doc_id", "b.*").filter("n > 0")


def weights(rows: DataFrame, documents: int, terms: int) -> np.ndarray:
    """Each term's weight from the documents that hold it; a term that none holds has the largest."""
    df = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a block's terms at most
        df[r["term"]] = r["count"]
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _ranked(items: Items, weight: np.ndarray, top: int):
    """The best classes of every item among the rows of a task."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros((4, 0), np.int64)]  # item, score, least, class
        full = np.zeros(len(items.ids), np.int64)  # the score that a class must reach
        size = max(1, CELLS // max(len(weight), len(items.terms), 1))
        waiting = 0

        def cut() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
            place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
            last = place == top - 1
            full[rows[0][last]] = rows[1][last]
            return rows[:, place < top]

        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at:at + size]
                column = np.repeat(np.arange(len(part)), [len(t) for t in part["terms"]])
                if not len(column):
                    continue
                term = np.concatenate(part["terms"].to_list()).astype(np.int64)
                tf = np.concatenate(part["tfs"].to_list()).astype(np.int64)
                cells = np.zeros((len(weight), len(part)), np.int64)
                cells[term, column] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * part["m"].to_numpy()[column]))
                score = np.add.reduceat(cells[items.terms], items.first, axis=0)
                item, which = np.nonzero((score > 0) & (score >= full[:, None]))
                held.append(np.stack([item, score[item, which], part["least"].to_numpy()[which], part["class"].to_numpy()[which]]))
                waiting += len(item)
                if waiting > 200_000:
                    held[:], waiting = [cut()], 0
        rows = cut()
        yield pd.DataFrame(dict(zip(("item", "score", "least", "class"), rows)))

    return best


def _block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` of the items of one block."""
    held = written(bags(docs, items), "bags")
    documents, length = held.agg(F.count("*"), F.sum("n")).first()
    weight = weights(held, documents, len(items.numbers))
    # 100 - 90 + (90 n N) div L, in wide integers: n N can pass 64 bits before it is divided.
    m = (F.lit(10) + F.expr(f"bigint((cast(n as decimal(19,0)) * {90 * documents}BD) div {max(1, length or 0)}BD)")).alias("m")
    vector = ["hash", "m", "terms", "tfs"]
    known = held.filter(F.size("terms") > 0).select("doc_id", m, "terms", "tfs").withColumn(
        "hash", F.xxhash64("m", "terms", "tfs"))
    last = F.lit((1 << 63) - 1)  # rows without an id come last
    classes = written(
        known.groupBy(*vector).agg(F.coalesce(F.min("doc_id"), last).alias("least"))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    found = classes.select("m", "terms", "tfs", "least", "class").mapInPandas(
        _ranked(items, weight, top), "item bigint, score bigint, least bigint, class bigint")
    won = written(keep_ranked(found, ["item"], [F.col("score").desc(), F.col("least").asc(), F.col("class").asc()], top), "won")
    winners = classes.join(won.select("class").distinct(), "class", "left_semi").select("class", *vector)
    members = known.join(winners, vector).select("class", "doc_id")
    first = keep_ranked(members, ["class"], [F.col("doc_id").asc_nulls_last()], top)
    return keep_ranked(won.join(first, "class"), ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()],
                       top, rank="rank").select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above zero of every item.

    A null text has no term and counts nowhere; an item without terms has no row. Equal scores go by ascending id, rows
    without one last; rows that repeat are documents each. Items that repeat id and text count once; another text under
    the same id, or under none, is ranked by itself. Empty tables give no row; other columns are not read.
    """
    spark = docs.sparkSession
    items = written(benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct(), "items")
    # A term has two bytes or more with its separator, so this bounds a block's terms on average.
    total = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    n = int(total // block_terms) + 1
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # one block
        block = Items.of([r["item_id"] for r in rows], [r["text"] for r in rows])
        filled = np.diff(np.append(block.first, len(block.terms))) > 0
        ids = [x for x, held in zip(block.ids, filled) if held]
        block = Items(ids, block.numbers, block.terms, block.first[filled])
        if not ids:
            continue
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {kind}")
        one = written(_block(docs, block, top).join(names, "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out


def sql(top: int = TOP) -> str:
    """The same over views ``documents`` and ``benchmark``, for DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, {terms} AS term FROM numbered),
items AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT DISTINCT i, item_id, {terms} AS term FROM items),
sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
counts AS (SELECT r, term, count(*) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, docs),
scores AS (
  SELECT i, item_id, r, s.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))))::BIGINT AS score
  FROM wanted JOIN counts USING (term) JOIN weight USING (term) JOIN sizes s USING (r), total GROUP BY i, item_id, r, s.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= {top}"""
