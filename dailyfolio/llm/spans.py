"""Repeated passages: hashes of runs of consecutive sentences, joined over the whole corpus.

A sentence ends at ``. ! ?`` or a line feed; one of over ``LONG`` words is parted where the content says so, at words
whose hash is the least among ``WINDOW`` words on either side, so that the parts move with a passage and are found at any
offset (what repeats one word is parted by length). Every run of ``RUN`` sentences, extended by more of them until it has ``LEAST`` words, is hashed (case, spacing and
punctuation do not count). A run that occurs more than once keeps its first place, the smallest (doc_id, text hash,
position); the sentences that any other place covers are removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.llm.words import Words, blocks, mix, words_of
from dailyfolio.session import written

RUN = 2
LEAST = 20
LONG = 12
WINDOW = 5
#: Words of the parts of what repeats one word.
STRIDE = 24

_STEP = np.uint64(0x9FB21C651E98DF25)
_OTHER = np.uint64(0xA24BAED4963EE407)


def sentences(w: Words, long: int = LONG) -> np.ndarray:
    """The index of the first word of each sentence, parts of long ones included."""
    if not len(w.doc):
        return np.zeros(0, np.int64)
    new = w.breaks.copy()
    new[0] = True
    new[1:] |= w.doc[1:] != w.doc[:-1]
    number = np.cumsum(new)
    least = (np.bincount(number)[number] > long) & ~new
    for k in range(1, WINDOW + 1):
        same = number[k:] == number[:-k]
        least[k:] &= ~same | (w.key[k:] < w.key[:-k])
        least[:-k] &= ~same | (w.key[:-k] <= w.key[k:])
    first = np.flatnonzero(new | least)
    # Where nothing stands out (one word over and over) parts of equal length from the part's own start are as good.
    place = np.arange(len(new)) - np.repeat(first, np.diff(np.concatenate([first, [len(new)]])))
    return np.flatnonzero(place % STRIDE == 0)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _run_hash(sentence: np.ndarray, step: np.uint64, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of each run, whatever its place: differences of one running sum, shifted back."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sentence * _powers(step, len(sentence)))])
    back = _powers(np.uint64(pow(int(step), -1, 1 << 64)), len(sentence))
    return mix((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64))


def runs(texts: list[str], run: int = RUN, least: int = LEAST, long: int = LONG) -> pd.DataFrame:
    """Runs of each text: its place in the list, the first sentence, how many, and 64 + 32 bits of hash."""
    w = words_of(texts)
    first = sentences(w, long)
    n = len(first)
    if not n:
        return pd.DataFrame({"doc": np.zeros(0, np.int64), "sentence": np.zeros(0, np.int32), "many": np.zeros(0, np.int32),
                             "hash": np.zeros(0, np.int64), "check": np.zeros(0, np.int32)})
    edge = np.concatenate([first, [len(w.doc)]])
    size = np.diff(edge)
    place = np.arange(len(w.doc)) - np.repeat(first, size)
    power = _powers(_STEP, int(size.max()))
    whole = mix(np.add.reduceat(w.key * power[place], first) + size.astype(np.uint64))
    other = mix(np.add.reduceat(mix(w.key + _OTHER) * power[place], first))
    begin = np.arange(n)
    end = np.maximum(begin + run, np.searchsorted(edge, first + least))
    doc = w.doc[first]
    head = np.searchsorted(doc, doc, "left")
    keep = np.flatnonzero(end <= np.searchsorted(doc, doc, "right"))
    begin, end = begin[keep], end[keep]
    h, c = _run_hash(whole, _STEP, begin, end), _run_hash(other, _OTHER, begin, end)
    return pd.DataFrame({"doc": doc[keep], "sentence": (begin - head[keep]).astype(np.int32),
                         "many": (end - begin).astype(np.int32), "hash": h.view(np.int64),
                         "check": (c >> np.uint64(32)).astype(np.uint32).view(np.int32)})


def kept_text(text: str, covered: list[int], long: int = LONG) -> tuple[str, list[tuple[int, int]]]:
    """The text without the covered sentences, and the removed ranges (code points, joined where they meet).

    A sentence reaches from its first word to the next sentence, the first one from the start of the text.
    """
    w = words_of([text])
    at = w.start[sentences(w, long)].tolist()
    edges = [0, *at[1:], len(text)]
    cut: list[tuple[int, int]] = []
    for k in sorted(set(covered)):
        a, b = edges[k], edges[k + 1]
        if cut and cut[-1][1] == a:
            cut[-1] = (cut[-1][0], b)
        else:
            cut.append((a, b))
    out, last = [], 0
    for a, b in cut:
        out.append(text[last:a])
        last = b
    return "".join([*out, text[last:]]), cut


def run_rows(docs: DataFrame, run: int = RUN, least: int = LEAST, long: int = LONG) -> DataFrame:
    """``(doc_id, same, sentence, many, hash, check)``: a row for every run; ``same`` is a hash of the text."""

    @F.pandas_udf("struct<sentence: array<int>, many: array<int>, hash: array<bigint>, check: array<int>>")
    def made(texts: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"sentence": [], "many": [], "hash": [], "check": []}
        for _, part in blocks(texts):
            r = runs(part, run, least, long)
            edge = np.searchsorted(r["doc"].to_numpy(), np.arange(1, len(part)))
            for name, cells in out.items():
                cells += np.split(r[name].to_numpy(), edge)
        return pd.DataFrame({name: pd.Series(cells, dtype=object) for name, cells in out.items()})

    rows = docs.select("doc_id", F.xxhash64("text").alias("same"),
                       made.asNondeterministic()(F.col("text")).alias("runs"))
    return rows.select("doc_id", "same", F.inline(F.arrays_zip("runs.sentence", "runs.many", "runs.hash", "runs.check")))


def repeated(rows: DataFrame) -> DataFrame:
    """Runs at more than one place with the first of these."""
    return rows.groupBy("hash", "check").agg(
        F.min(F.struct("doc_id", "same", "sentence")).alias("first"),
        F.max(F.struct("doc_id", "same", "sentence")).alias("last"),
    ).filter(~F.col("first").eqNullSafe(F.col("last"))).select("hash", "check", "first")


def covered(docs: DataFrame, run: int = RUN, least: int = LEAST, long: int = LONG) -> DataFrame:
    """``(doc_id, same, covered)``: the sentences of each document that a non-first place covers."""
    rows = written(run_rows(docs, run, least, long), "runs")
    again = written(repeated(rows), "repeated").select("hash", "check", "first")
    place = F.struct("doc_id", "same", "sentence")
    later = rows.join(again, ["hash", "check"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "same").agg(
        F.array_distinct(F.flatten(F.collect_set(F.transform(
            F.sequence(F.lit(0), F.col("many") - 1), lambda k: F.col("sentence") + k)))).alias("covered"))


def without_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST, long: int = LONG) -> DataFrame:
    """``docs`` with ``__cut``: ``text`` without repeated passages and the ranges ``removed``.

    Null texts stay null, empty ones empty. Rows that repeat id and text are one document and
    lose nothing to each other; rows that share only the id are documents of their own. A null
    id comes before all others.
    """
    cut = written(covered(docs, run, least, long), "covered")

    @F.pandas_udf("struct<text: string, removed: array<struct<start: int, end: int>>>")
    def drop(texts: pd.Series, which: pd.Series) -> pd.DataFrame:
        made = [(None, []) if not isinstance(x, str) else (x, []) if k is None or not len(k)
                else kept_text(x, list(k), long) for x, k in zip(texts, which)]
        return pd.DataFrame({"text": pd.Series([t for t, _ in made], dtype=object), "removed": pd.Series(
            [[{"start": a, "end": b} for a, b in r] for _, r in made], dtype=object)})

    same = F.xxhash64(docs["text"])
    found = cut.select(F.col("doc_id").alias("__doc_id"), F.col("same").alias("__same"), F.col("covered").alias("__covered"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (same == F.col("__same")), "left")
    return joined.withColumn("__cut", drop.asNondeterministic()(docs["text"], F.col("__covered"))).select(
        *[docs[c] for c in docs.columns], "__cut")


def remove_repeats(docs: DataFrame, **kwargs) -> DataFrame:
    """``docs`` with shortened texts (and ``n_chars`` to match)."""
    out = without_repeats(docs, **kwargs).withColumn("text", F.col("__cut.text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

