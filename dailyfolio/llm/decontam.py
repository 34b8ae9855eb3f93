"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``MIN_MATCH`` words. The distinct seeds of every text are joined with those of the benchmark
inside the text's own row: a block of items, of bounded size, is a sorted table of seeds that goes
to the tasks, one block after the other. Items whose words could be covered far enough by shared seeds are tiled
by running Karp-Rabin: windows of a falling length are matched by hash, checked word by word,
extended, and the longest non-overlapping matches are marked until none of ``MIN_MATCH`` words is left. Tiles may come in any order, so
reordered passages count too. A text is contaminated if the tiles cover enough of an item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.llm.words import Words, blocks, grams, inside_doc, words_of
from dailyfolio.session import written

#: Shortest tile in words; an item of fewer words matches whole.
MIN_MATCH = 5
#: Share of an item's words that the tiles must cover.
COVERAGE = 0.6
#: Words of benchmark items that one pass over the texts is sent (about 16 bytes each).
BLOCK_WORDS = 4_000_000
#: Rows of (document, item) that are broadcast to the documents; more of them meet the documents in a shuffle.
BROADCAST_ROWS = 500_000
_TABLE_BITS = 20


class Benchmark:
    """The items of one block: word keys, and their distinct seeds sorted by hash."""

    def __init__(self, texts: list[str], min_match: int, coverage: float):
        w = words_of(texts)
        self.min_match, self.coverage, self.items = min_match, coverage, len(texts)
        self.key, self.first = w.key, w.first
        #: By seed length: the seed of each place, and the distinct (seed, item) with a table of their high bits.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.diff(w.first)
        for n in sorted({min(min_match, s) for s in size.tolist() if s}):
            g = grams(w.key, n)
            at = np.flatnonzero(inside_doc(w.doc, n) & (np.minimum(size, min_match)[w.doc[:len(g)]] == n))
            order = np.lexsort((w.doc[at], g[at]))
            seed, item = g[at][order], w.doc[at][order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])
            seen = np.zeros(1 << _TABLE_BITS, bool)
            seen[(seed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.seeds[n] = (g, seed[new], item[new], seen)

    def shared(self, w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' seeds of ``n`` words, and what they share: text, item and seed, each once, by text and item."""
        _, seeds, items, seen = self.seeds[n]
        g = grams(w.key, n)
        at = np.flatnonzero(seen[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        at = at[inside_doc(w.doc, n)[at]] if len(at) else at
        order = np.lexsort((g[at], w.doc[at]))
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = (g[at][1:] != g[at][:-1]) | (w.doc[at][1:] != w.doc[at][:-1])
        at = at[new]
        low, high = np.searchsorted(seeds, g[at], "left"), np.searchsorted(seeds, g[at], "right")
        count = high - low
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        text, item, seed = np.repeat(w.doc[at], count), items[np.repeat(low, count) + step], np.repeat(g[at], count)
        order = np.lexsort((seed, item, text))
        return g, text[order], item[order], seed[order]

    def matches(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text the numbers of the items that its tiles cover far enough, with the covered share."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        w = words_of(texts)
        for n in self.seeds:
            g, text, item, seed = self.shared(w, n)
            if not len(text):
                continue
            edge = np.concatenate([[0], np.flatnonzero(np.diff(text) | np.diff(item)) + 1, [len(text)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                t, k = int(text[a]), int(item[a])
                begin, end = int(self.first[k]), int(self.first[k + 1])
                places = np.flatnonzero(_among(self.seeds[n][0][begin:end - n + 1], seed[a:b]))
                if len(_widened(places, n)) < self.coverage * (end - begin):
                    continue  # tiles consist of seeds, so they cannot cover more
                lo, hi = int(w.first[t]), int(w.first[t + 1])
                near = _widened(np.flatnonzero(_among(g[lo:hi - n + 1], seed[a:b])), n) + lo
                runs = [w.key[r[0]:r[-1] + 1] for r in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1)]
                share = tiled(self.key[begin:end], runs, n) / (end - begin)
                if share >= self.coverage:
                    out[t].append((k, float(share)))
        return out


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _widened(places: np.ndarray, n: int) -> np.ndarray:
    """The words that seeds of ``n`` words at ``places`` hold, in order."""
    if not len(places):
        return places
    mark = np.zeros(int(places[-1]) + n + 1, np.int32)
    mark[places] += 1
    mark[places + n] -= 1
    return np.flatnonzero(np.cumsum(mark))


def _windows(key: np.ndarray, size: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unmarked windows of ``size`` words, by hash: hashes and places."""
    g = grams(key, size)
    free = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(free[size:] == free[:-size]) if len(g) else np.zeros(0, np.int64)
    at = at[np.argsort(g[at], kind="stable")]
    return g[at], at


def _extended(item: np.ndarray, i: int, text: np.ndarray, at: np.ndarray, size: int, item_used: np.ndarray,
              text_used: np.ndarray) -> np.ndarray:
    """How far the match of ``item`` at ``i`` goes on at each place of ``text``."""
    n = np.full(len(at), size)
    on, step = np.arange(len(at)), size
    while len(on) and i + step < len(item) and not item_used[i + step]:
        next_ = at[on] + step
        ok = next_ < len(text)
        on, next_ = on[ok], next_[ok]
        on = on[(text[next_] == item[i + step]) & ~text_used[next_]]
        n[on] += 1
        step += 1
    return n


def _maximal(item: np.ndarray, text: np.ndarray, size: int, item_used: np.ndarray, text_used: np.ndarray):
    """Matches of at least ``size`` words that go on on neither side, longest first: (length, place, place).

    One window of the item at a time, so words that repeat cost time along their diagonals but no memory for all pairs.
    """
    hashes, places = _windows(text, size, text_used)
    own, starts = _windows(item, size, item_used)
    found = []
    for h, i in zip(own, starts.tolist()):
        at = places[np.searchsorted(hashes, h, "left"):np.searchsorted(hashes, h, "right")]
        if i and not item_used[i - 1] and len(at):  # what goes on to the left belongs to the window before
            at = at[(at == 0) | text_used[at - 1] | (text[at - 1] != item[i - 1])]
        for k in range(size):  # hashes can agree by chance
            if not len(at):
                break
            at = at[text[at + k] == item[i + k]]
        if len(at):
            n = _extended(item, i, text, at, size, item_used, text_used)
            found.append(np.stack([n, np.full(len(at), i), at]))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found, axis=1)
    return rows[:, np.lexsort((rows[2], rows[1], -rows[0]))].T


def tiled(item: np.ndarray, runs: list[np.ndarray], min_match: int) -> int:
    """Words of ``item`` that greedy tiles of at least ``min_match`` words from ``runs`` cover.

    Longest first, each word of either side is in one tile at most; ties go to the earlier place.
    """
    parts, at = [], 0
    for r in runs:  # a run never matches across its end: separators are marked
        parts += [r, np.array([at], np.uint64)]
        at += 1
    text = np.concatenate(parts)
    text_used = np.zeros(len(text), bool)
    text_used[np.cumsum([len(r) + 1 for r in runs]) - 1] = True
    item_used = np.zeros(len(item), bool)
    size = len(item)
    while size >= min_match and not item_used.all():
        found = 0
        for n, i, j in _maximal(item, text, size, item_used, text_used).tolist():
            if not item_used[i:i + n].any() and not text_used[j:j + n].any():
                item_used[i:i + n] = True
                text_used[j:j + n] = True
                found += 1
        if found:
            continue  # what overlapped a marked tile may still hold a match of this size
        if size == min_match:
            break
        size = max(min_match, size // 2)
    return int(item_used.sum())


def _blocks_of(items: DataFrame, block_words: int) -> int:
    """How many parts by a hash of the item hold about ``block_words`` words each."""
    words = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    return int(words // block_words) + 1


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
          block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """``(doc_id, same, item_id, coverage)`` of every text that holds an item; ``same`` is a hash of the text.

    ``item_id`` has the benchmark's own type. One block of items is collected at a time.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    items = written(benchmark.select("item_id", F.col("text").cast("string").alias("text"))
                    .filter("item_id is not null and text is not null").distinct(), "items")
    n, found = _blocks_of(items, block_words), None
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about block_words words
        if not rows:
            continue
        block = Benchmark([r["text"] for r in rows], min_match, coverage)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
        one = docs.select("doc_id", F.xxhash64(text_col).alias("same"), _leaks(block)(F.col(text_col)).alias("l")).select(
            "doc_id", "same", F.inline("l"))
        one = written(one, "leaks").join(ids, "item").select("doc_id", "same", "item_id", "coverage")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.select("doc_id", F.xxhash64(text_col).alias("same"), F.lit(None).cast(kind).alias("item_id"),
                            F.lit(0.0).alias("coverage")).limit(0)
    return found


def _leaks(block: Benchmark):
    @F.pandas_udf("array<struct<item: int, coverage: double>>")
    def found(texts: pd.Series) -> pd.Series:
        out: list = []
        for _, part in blocks(texts):
            out += [[{"item": i, "coverage": c} for i, c in m] for m in block.matches(part)]
        return pd.Series(out, dtype=object)

    return found.asNondeterministic()


def _meets(docs: DataFrame, found: DataFrame, rows: int, text_col: str, how: str) -> DataFrame:
    """``docs`` joined with rows of (__id, __same): in place up to a counted size, else by a shuffle."""
    side = F.broadcast(found) if rows <= BROADCAST_ROWS else found
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__same")), how)


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                  coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, text_cols: str = "text") -> DataFrame:
    """``docs`` with ``__leaks``: ``array<struct<item_id, coverage>>`` of the items found in its text, by item.

    Words are runs of letters and digits without case, so punctuation and spacing don't matter.
    Null and empty texts hold nothing; a null or wordless item, or one with a null id, is never
    found; an item that repeats is found once for each id, with the best coverage of the texts under that id. Ids may be of any
    type that can be ordered. Items of fewer than ``min_match`` words must occur whole. Rows that repeat are alike.
    """
    found = written(leaks(docs, benchmark, min_match, coverage, block_words, text_cols), "found")
    each = found.groupBy("doc_id", "same", "item_id").agg(F.max("coverage").alias("coverage"))
    listed = each.groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__same")).agg(
        F.sort_array(F.collect_list(F.struct("item_id", "coverage"))).alias("__found"))
    none = F.array().cast(listed.schema["__found"].dataType)
    return _meets(docs, listed, found.count(), text_cols, "left").select(
        *[docs[c] for c in docs.columns], F.coalesce("__found", none).alias("__leaks"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the contaminated rows."""
    text = kwargs.get("text_col", "text")
    found = leaks(docs, benchmark, **kwargs).select(F.col("doc_id").alias("__id"), F.col("same").alias("__same")).distinct()
    found = written(found, "contaminated")
    return _meets(docs, found, found.count(), text, "left_anti").select(docs.columns)
