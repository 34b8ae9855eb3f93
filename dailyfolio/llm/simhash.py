"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are first reduced to the distinct ones. Two that differ in at most three of 64 bits
agree on one of four 16-bit blocks, so the upper nodes of the index are the patterns under the
four block masks, and each node is a Spark group. Nodes over a size limit are split
the same way again on the bits not yet fixed. Inside a node, fingerprints are sorted by Gray
rank; runs of them become nodes that hold the bits all members share, and two nodes are compared by the differences of
their shared bits, added up from the top; pairs of nodes over the limit are pruned whole.
Each node reports a spanning star of what it links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.llm.components import components
from dailyfolio.session import written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Distinct fingerprints above which a node of the index is split on its free bits.
NODE_LIMIT = 4096
#: Levels of block masks; four fix at least 44 of 64 bits.
LEVELS = 4
LEAF = 32
FAN = 8
#: Pairs of nodes that are held at once.
FRONTIER = 200_000

_ASCII_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64.

    Only A-Z are lower-cased; words are separated by ASCII white space; repeats count. A text of
    fewer words is one shingle; without a word (or null) the fingerprint is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_digest(whole, SEED)]
    else:
        start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        hashed = xxhash.xxh64_digest
        hashes = [hashed(whole[a:b], SEED) for a, b in zip(start[:-shingle].tolist(), (start[shingle:] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        part = np.frombuffer(b"".join(hashes[at:at + 100_000]), np.uint8)
        total += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fp(shingle: int):
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    return fp.asNondeterministic()  # so that a filter above does not evaluate it again


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""
    return docs.select("doc_id", _fp(shingle)(F.col("text")).alias("fp"))


def children(mask: int) -> list[int]:
    """``mask`` with each quarter of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Rows ``(fp, mask)`` once for each child mask."""
    pairs = [(m, [_signed(c) for c in children(m)]) for m in masks]
    if len(pairs) == 1:
        nexts = F.array(*[F.lit(c) for c in pairs[0][1]])
    else:
        kv = [x for m, cs in pairs for x in (F.lit(_signed(m)), F.array(*[F.lit(c) for c in cs]))]
        nexts = F.create_map(*kv)[F.col("mask")]
    return rows.select("fp", F.explode(nexts).alias("mask"))


def node_rows(distinct: DataFrame, limit: int = NODE_LIMIT, levels: int = LEVELS) -> DataFrame:
    """Every fingerprint once for each upper node it stands in: ``(mask, pattern, fp)``.

    Nodes of over ``limit`` members are counted before and replaced by their children.
    """
    masks, out = [0], []
    rows = distinct.select("fp", F.lit(0).cast("bigint").alias("mask"))
    for level in range(levels):
        rows = _split(rows, masks).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        if level:  # a mask can have two parents
            rows = rows.distinct()
        masks = sorted({c for m in masks for c in children(m)})
        if level == levels - 1:
            out.append(rows)
            break
        large = written(rows.groupBy("mask", "pattern").count().filter(F.col("count") > limit)
                        .select("mask", "pattern"), "large-nodes")
        if large.isEmpty():
            out.append(rows)
            break
        out.append(rows.join(large, ["mask", "pattern"], "left_anti"))
        rows = rows.join(large, ["mask", "pattern"], "left_semi").select("fp", "mask")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from the leaves up: shared bits (mask) and their values (pattern) of each node."""
    at = np.arange(0, len(fps), LEAF)
    ones, zeros = np.bitwise_and.reduceat(fps, at), ~np.bitwise_or.reduceat(fps, at)
    out = [(ones | zeros, ones)]
    while len(ones) > 1:
        at = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        out.append((ones | zeros, ones))
    return out


def _spread(left: np.ndarray, right: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of paired nodes, once each."""
    a = (left[:, None] * fan + np.arange(fan))[:, :, None]
    b = (right[:, None] * fan + np.arange(fan))[:, None, :]
    a, b = np.broadcast_arrays(a, b)
    keep = (a <= b) & (b < n)
    return a[keep], b[keep]


def linked(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each class that links of at most ``distance`` bits make: (member, head)."""
    fps = np.unique(fps)
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    label = np.arange(len(fps))
    levels = _levels(fps)
    # (level, left, right, differences so far, bits already counted on both sides)
    zero = np.zeros(1, np.int64)
    stack = [(len(levels) - 1, zero, zero, np.zeros(1, np.int64), np.zeros(1, np.uint64))]
    while stack:
        level, left, right, spent, counted = stack.pop()
        mask, pattern = levels[level]
        shared = mask[left] & mask[right]
        spent = spent + np.bitwise_count((pattern[left] ^ pattern[right]) & shared & ~counted)
        keep = spent <= distance
        left, right, spent, counted = left[keep], right[keep], spent[keep], (counted | shared)[keep]
        if not len(left):
            continue
        fan, n = (LEAF, len(fps)) if level == 0 else (FAN, len(levels[level - 1][0]))
        room = max(1, FRONTIER // (fan * fan))
        for at in range(0, len(left), room):
            cut = slice(at, at + room)
            a, b = _spread(left[cut], right[cut], fan, n)
            if level:
                slot = _owner(left[cut], right[cut], fan, n)
                stack.append((level - 1, a, b, spent[cut][slot], counted[cut][slot]))
                continue
            near = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= distance)
            _union(label, a[near], b[near])
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    member = np.flatnonzero(label != np.arange(len(label)))
    return fps[member], fps[label[member]]


def _owner(left: np.ndarray, right: np.ndarray, fan: int, n: int) -> np.ndarray:
    """For each pair that ``_spread`` makes, the pair of nodes it comes from."""
    a = (left[:, None] * fan + np.arange(fan))[:, :, None]
    b = (right[:, None] * fan + np.arange(fan))[:, None, :]
    a, b = np.broadcast_arrays(a, b)
    return np.broadcast_to(np.arange(len(left))[:, None, None], a.shape)[(a <= b) & (b < n)]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of ``a`` and ``b``; a label never exceeds its index."""
    while len(a):
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = label[a], label[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the nodes of one partition, whose rows come sorted by node."""

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        edge = rows[["mask", "pattern"]].ne(rows[["mask", "pattern"]].shift()).any(axis=1).to_numpy().nonzero()[0]
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        out = [linked(fps[a:b]) for a, b in zip(edge, [*edge[1:], len(fps)]) if b - a > 1]
        a = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in out]]).view(np.int64)
        b = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in out]]).view(np.int64)
        return pd.DataFrame({"a": a, "b": b})

    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[["mask", "pattern"]].iloc[-1]
        whole = (batch["mask"] != last["mask"]) | (batch["pattern"] != last["pattern"])
        if whole.any():
            yield made(pd.concat([*rest, batch[whole]], ignore_index=True))
            rest = [batch[~whole]]
        elif rest and (rest[-1][["mask", "pattern"]].iloc[-1] != last).any():
            yield made(pd.concat(rest, ignore_index=True))
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield made(pd.concat(rest, ignore_index=True))


def links(distinct: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links among the distinct fingerprints."""
    nodes = node_rows(distinct, limit).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return nodes.mapInPandas(_stars, "a bigint, b bigint")


def classes(docs: DataFrame, shingle: int = SHINGLE, limit: int = NODE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and of each distinct one its class: ``(fp, root, component_id)``."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(written(links(distinct, limit), "near"))
    headed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = headed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, written(headed.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "heads")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = NODE_LIMIT) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, fp, component_id)``.

    ``component_id`` is the smallest doc_id reachable over links of at most three bits, itself
    included. Null ids are linked like others and take part in no minimum (null if a component
    has only those). Rows that repeat a doc_id each get a result; equal texts always share a
    component. An empty table gives no row; other columns are not read.
    """
    rows, heads = classes(docs, shingle, limit)
    return rows.join(heads, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, limit: int = NODE_LIMIT) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id.

    A row without an id stays only if its group has no id at all, again one for the group. Rows
    that repeat id and fingerprint count once. All columns are kept as they are.
    """
    rows, heads = classes(docs, shingle, limit)
    kept = written(
        rows.join(heads, "fp").filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # Hinted, so that small tables take the same plan as large ones: ids meet texts in hash joins.
    once = docs.join(kept.filter("n = 1").hint("shuffle_hash"), "doc_id", "left_semi")
    mark = "__fp"
    of_row = _fp(shingle)(F.col("text"))
    repeated = (docs.join(kept.filter("n > 1"), "doc_id", "left_semi").withColumn(mark, of_row)
                .dropDuplicates(["doc_id", mark]))
    lonely = heads.filter("component_id is null").select(F.col("fp").alias(mark), F.col("root").alias("__root"))
    nameless = (docs.filter(F.col("doc_id").isNull()).withColumn(mark, of_row)
                .join(lonely, mark).dropDuplicates(["__root"]))
    return once.select(docs.columns).unionByName(repeated.select(docs.columns)).unionByName(
        nameless.select(docs.columns))
