"""Word streams of whole texts as numpy arrays, and the frame helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Code points held at once; longer texts make a block of their own.
BLOCK_CHARS = 1_000_000

_TOP = 0x20000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


class Tables(NamedTuple):
    lower: np.ndarray
    word: np.ndarray
    letter: np.ndarray


@lru_cache(1)
def tables() -> Tables:
    """Per code point: its one-to-one lower case, whether it is part of a word, a letter.

    Code points from 0x20000 on (ideographs) share the last entry: caseless letters.
    """
    chars = [chr(i) for i in range(_TOP)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)] + [_TOP], np.uint32)
    word = np.array([c.isalnum() for c in chars] + [True])
    letter = np.array([c.isalpha() for c in chars] + [True])
    return Tables(lower, word, letter)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of some texts, in order.

    ``doc`` is the text's place in the list, ``start`` and ``end`` are offsets in that text
    (code points), ``key`` a 64-bit hash of the lower-cased word, ``breaks`` whether a
    sentence ends between this word and the one before, ``first`` the index of each text's first word.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    breaks: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters and digits; everything between them separates."""
    t = tables()
    raw = [codes_of(x) for x in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.full(int(begin[-1]), 10, np.uint32)
    for at, x in zip(begin, raw):
        codes[at:at + len(x)] = x
    small = np.minimum(codes, _TOP)
    inside = t.word[small]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), none.astype(bool), np.zeros(len(texts) + 1, np.int64))
    chars = t.lower[small[inside]].astype(np.uint64) + np.uint64(1)
    sizes_w = end - start
    at = np.concatenate([[0], np.cumsum(sizes_w)[:-1]])
    place = np.arange(len(chars)) - np.repeat(at, sizes_w)
    power = np.ones(int(sizes_w.max()), np.uint64)
    power[1:] = _BASE
    key = mix(np.add.reduceat(chars * np.cumprod(power)[place], at) + sizes_w.astype(np.uint64))
    ends = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 10)  # . ! ? and line feed
    seen = np.concatenate([[0], np.cumsum(ends)])
    before = np.concatenate([[0], end[:-1]])
    breaks = seen[start] > seen[before]
    doc = np.searchsorted(begin, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(doc, start - begin[doc], end - begin[doc], key, breaks, first)


def grams(key: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive keys (across texts too; mask those by ``inside_doc``)."""
    if len(key) < n:
        return np.zeros(0, np.uint64)
    out = key[: len(key) - n + 1].copy()
    for k in range(1, n):
        out *= _STEP
        out += key[k: len(key) - n + 1 + k]
    return mix(out)


def inside_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return doc[: len(doc) - n + 1] == doc[n - 1:] if len(doc) >= n else np.zeros(0, bool)


def blocks(texts: Iterable[str | None], chars: int = BLOCK_CHARS, most: int = 1 << 30) -> Iterator[tuple[int, list[str]]]:
    """Runs of ``most`` texts and about ``chars`` code points, with the place of the first; null is empty."""
    held: list[str] = []
    first = size = 0
    for i, x in enumerate(texts):
        x = x if isinstance(x, str) else ""
        if held and (size + len(x) > chars or len(held) >= most):
            yield first, held
            first, held, size = i, [], 0
        held.append(x)
        size += len(x)
    if held:
        yield first, held


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

