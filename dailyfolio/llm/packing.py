"""Packing of whole texts into token sequences by the sum-of-squares rule.

Each piece goes where the sum of squares of the numbers of open sequences per residual gap
becomes smallest: into an open sequence, or a new one. Pieces are dealt into groups of bounded
size by a hash, each packed in one task; then the sequences that stayed open are opened again
and their pieces packed once more in fewer groups.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.session import written

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs.
GROUP_PIECES = 4096
#: Sequences with a larger gap are packed again.
OPEN_GAP = 16
#: Words whose ids a worker keeps.
CACHE_WORDS = 200_000
VOCABULARY = "byte_bpe_50k"
_SPECIAL = "<|endoftext|>"


@lru_cache(1)
def _encoder(vocabulary: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers.

    The vocabulary's splitting rule never joins across a single space between two words, so words
    are encoded once and kept; other texts (with runs of white space) are encoded whole. Texts
    that hold a special token go to the tokenizer file itself, which knows it.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={}).encode_ordinary
    full = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    odd_space = re.compile(r" (?:\s|$)|^\s").search
    known: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(text: str) -> bytes:
        if _SPECIAL in text:
            return packed(full.encode(text, add_special_tokens=False).ids)
        if odd_space(text):
            return packed(plain(text))
        head, *rest = text.split(" ")
        parts = list(map(known.get, rest))
        if None in parts:
            if len(known) > CACHE_WORDS:
                known.clear()
            for i, x in enumerate(parts):
                if x is None:
                    word = rest[i]
                    x = known.get(word)
                    if x is None:
                        x = known[word] = packed(plain(" " + word))
                    parts[i] = x
        return packed(plain(head)) + b"".join(parts)

    return encode


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of a document's ids; only the first piece may be short."""
    n = len(ids) // 4
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
    return [(k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every row's ids, then ``END_ID``, cut at ``capacity``."""

    @F.pandas_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    def made(texts: pd.Series) -> pd.Series:
        encode, end = _encoder(vocabulary), struct.pack("<I", END_ID)
        names = ("piece", "start", "length", "ids_crc32")
        return pd.Series([[dict(zip(names, p)) for p in cut(encode(x or "") + end, capacity)] for x in texts],
                         dtype=object)

    return docs.select("doc_id", F.inline(made.asNondeterministic()(F.col("text"))))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, packed in the given order, and the gap of each bin.

    ``open_[g]`` is the number of open bins with gap ``g``; full bins do not count. Placing a piece
    of length s into gap g changes the sum of squares by ``2 (open_[g-s] - open_[g]) + 2``, by
    ``1 - 2 open_[g]`` if it fills the bin, and a new bin by ``2 open_[capacity-s] + 1``. Ties go to the smaller gap, new bins last.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    bins_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    gap: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (open_[:capacity + 1 - s] - open_[s:]) + 2
        change[0] = 1 - 2 * open_[s]
        change[open_[s:] == 0] = 1 << 40
        fresh = 2 * open_[capacity - s] + 1 if s < capacity else 0
        at = int(change.argmin())
        if change[at] <= fresh and open_[s + at]:
            g = s + at
            b = bins_of[g].pop()
            open_[g] -= 1
        else:
            g, b = capacity, len(gap)
            gap.append(capacity)
        where[i], offset[i] = b, capacity - g
        gap[b] = g - s
        if g > s:
            bins_of[g - s].append(b)
            open_[g - s] += 1
    return where, offset, np.array(gap, np.int64)




def _packed(rows: DataFrame, groups: int, capacity: int, turn: int) -> DataFrame:
    """``rows`` packed in ``groups`` tasks; ``bin`` is unique in this turn."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "row"], ascending=[False, True, True], ignore_index=True)
        where, offset, gap = sum_of_squares(group["length"].to_numpy(np.int64), capacity)
        return group.assign(bin=where + (int(key[0]) << 32), offset=offset, gap=gap[where])[
            ["row", "bin", "offset", "gap"]]

    slim = (rows.select("row", "length", "ids_crc32")
            .withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("int")))
    return slim.groupBy("group").applyInPandas(pack, "row bigint, bin bigint, offset bigint, gap bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id alone. Rows that repeat, and null ids, are
    packed like any other. The table of the pieces is written before, so packing is the
    same if a task runs again.
    """
    cutting = written(pieces(docs, capacity, vocabulary), "pieces").withColumn("row", F.monotonically_increasing_id())
    rows = written(cutting, "numbered")
    short = rows.filter(F.col("length") < capacity)
    first = written(_packed(short, max(1, short.count() // group_pieces), capacity, 0), "packed")
    again = first.filter(F.col("gap") > OPEN_GAP)
    second = written(
        _packed(short.join(again.select("row"), "row", "left_semi"), max(1, again.count() // group_pieces), capacity, 1),
        "packed-again")
    places = (first.filter(F.col("gap") <= OPEN_GAP).select("row", (F.col("bin") * 4).alias("sequence_id"), "offset")
              .unionByName(second.select("row", (F.col("bin") * 4 + 1).alias("sequence_id"), "offset")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = rows.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("row") * 4 + 2).withColumn(
        "offset", F.lit(0).cast("bigint"))
    return short.join(places, "row").select(columns).unionByName(whole.select(columns))
