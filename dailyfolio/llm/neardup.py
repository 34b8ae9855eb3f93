"""Near duplicates of at least a given Jaccard similarity of word shingles, one document of each group kept.

SimHash at three of 64 bits finds only the closest of them: at a similarity of 0.8 two fingerprints
differ in about ten bits. So links come from two places and are all verified on the whole shingle sets:

* the Gray-order index of operator 8 over the fingerprints of the shingles, and
* bands of minimal hashes. In every bucket of a band the members stand in Gray order; each is paired with the
  few of nearest fingerprint and with the bucket's medoid, the member next to the majority of all bits, which in a family of copies
  is what they were copied from. So pairs grow with the rows, never with their square.

Buckets are cut into ranges of bounded size wherever they are large; the medoids of the ranges elect one
that meets all members. Verified links give connected components.

Buckets whose members are not all in one component then are gone through whole: every pair of them that is not joined is
compared on its shingle sets, cell by cell. So no two similar members of a bucket are left apart, whichever pairs were chosen before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailyfolio.llm import simhash
from dailyfolio.llm.components import components
from dailyfolio.llm.words import blocks, grams, mix, words_of
from dailyfolio.session import written

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and minimal hashes of each: a pair of similarity 0.8 shares one with probability 0.998.
BANDS = 12
ROWS = 4
#: Members of a bucket that are compared with each other at once.
CHUNK = 2048
#: Nearest members that each is paired with, and the bits that a pair may differ in before it is verified
#: (five standard deviations above the mean at a similarity of 0.8).
NEAREST = 3
FAR = 24
#: Members and shingles of one side of a cell, in which those of a bucket that are not joined are compared.
CELL = 2048
CELL_SHINGLES = 1 << 20
#: Shingles whose minimal hashes are taken at once, and code points whose words are.
PIECE = 1 << 14
BLOCK_CHARS = 250_000

_RNG = np.random.default_rng(5)
_FACTOR = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(0x5F0C1D7A9B3E8642)


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; of fewer words the one of all, of none nothing."""
    w = words_of(texts)
    g = grams(w.key, shingle)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(g[a:b - shingle + 1]))
        else:
            out.append(mix(grams(w.key[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), PIECE):
        total += np.unpackbits(shingles[at:at + PIECE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(shingles)).tobytes(), "big")


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of minimal hashes; texts without words share theirs."""
    least = np.full(BANDS * ROWS, _EMPTY, np.uint64)
    for at in range(0, len(shingles), PIECE):
        part = shingles[at:at + PIECE]
        for k in range(BANDS * ROWS):
            h = part * _FACTOR[k]
            low = (h ^ (h >> np.uint64(29))).min()
            least[k] = low if not at else min(least[k], low)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * _FACTOR[r] + least.reshape(BANDS, ROWS)[:, r])
    return h


def _key(shingles: np.ndarray) -> bytes:
    """128 bits of the whole set."""
    at = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    one, other = mix(shingles * at + at).sum(dtype=np.uint64), mix(shingles ^ mix(at)).sum(dtype=np.uint64)
    return np.array([one, other], np.uint64).tobytes()


def _sketch(shingle: int):
    @F.pandas_udf("struct<key: binary, fp: bigint, n: int, bands: array<bigint>>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = (s for _, part in blocks(texts, BLOCK_CHARS) for s in shingle_sets(part, shingle))
        rows = [(_key(s), fingerprint(s), len(s), bands(s).view(np.int64)) for s in sets]
        return pd.DataFrame({
            "key": pd.Series([r[0] for r in rows], dtype=object), "fp": np.array([r[1] for r in rows], np.uint64).view(np.int64),
            "n": np.array([r[2] for r in rows], np.int32), "bands": pd.Series([r[3] for r in rows], dtype=object)})

    return sketch.asNondeterministic()


def _sets(shingle: int):
    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([s.view(np.int64) for _, part in blocks(texts, BLOCK_CHARS) for s in shingle_sets(part, shingle)], dtype=object)

    return sets.asNondeterministic()


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, as a signed number."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def bit_sums(fps: np.ndarray) -> np.ndarray:
    """How many members set each bit."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def medoid(fps: np.ndarray, sums: np.ndarray, members: int) -> int:
    """The place of the one nearest to the majority of all bits; the first of equals."""
    middle = np.uint64(int.from_bytes(np.packbits(sums * 2 > members).tobytes(), "big"))
    return int(np.bitwise_count(fps ^ middle).argmin())


def paired(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member with its nearest ones and with the medoid."""
    g = len(fps)
    a, b = [np.arange(g)], [np.full(g, medoid(fps, bit_sums(fps), g))]
    k = min(NEAREST, g - 1)
    for at in range(0, g, 256):
        far = np.bitwise_count(fps[at:at + 256, None] ^ fps[None, :])
        far[np.arange(len(far)), np.arange(at, at + len(far))] = 65
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        a.append(np.repeat(np.arange(at, at + len(far)), k))
        b.append(near.ravel())
    return np.concatenate(a), np.concatenate(b)


def _bucket_pairs(similarity: float, chunk: int):
    """Pairs of the buckets of a range, whose rows come sorted; and the medoids of buckets that may go on elsewhere."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("bucket", "cid", "fp", "n")
        rest = [np.zeros(0, np.int64)] * 4
        opened = True  # whether the bucket at hand may have begun elsewhere

        def made(rows: list[np.ndarray], first_open: bool, last_open: bool) -> pd.DataFrame:
            bucket, cid, fp, n = rows
            fps = fp.view(np.uint64)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            size, out, bits = np.diff(edge), [], []
            big = set(np.flatnonzero(size > 1).tolist()) | ({0} if first_open else set()) | ({len(size) - 1} if last_open else set())
            for k in sorted(big):
                lo, hi = int(edge[k]), int(edge[k + 1])
                is_open = (k == 0 and first_open) or (k == len(size) - 1 and last_open) or hi - lo > chunk
                for at in range(lo, hi, chunk):
                    end = min(at + chunk, hi)
                    if is_open:
                        sums = bit_sums(fps[at:end])
                        m = at + medoid(fps[at:end], sums, end - at)
                        out.append((bucket[m:m + 1], cid[m:m + 1], cid[m:m + 1], fp[m:m + 1], n[m:m + 1]))
                        bits.append([end - at, *sums])
                    if end - at > 1:
                        a, b = paired(fps[at:end])
                        a, b = a + at, b + at
                        keep = ((a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= FAR)
                                & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])))
                        a, b = a[keep], b[keep]
                        pair = np.unique(np.stack([np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b])]), axis=1)
                        none = np.zeros(pair.shape[1], np.int64)
                        out.append((none, pair[0], pair[1], none, none))
                        bits += [None] * pair.shape[1]
            cells = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(5)]
            return pd.DataFrame({**dict(zip(("bucket", "a", "b", "fp", "n"), cells)), "bits": pd.Series(bits, dtype=object)})

        for batch in batches:
            rows = [np.concatenate([r, batch[c].to_numpy(np.int64)]) for r, c in zip(rest, names)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0] == rows[0][-1], True))  # the last bucket may go on
            if len(rows[0]) - cut >= chunk:  # so large that it is done piece by piece
                cut = cut + (len(rows[0]) - cut) // chunk * chunk
                yield made([r[:cut] for r in rows], opened, True)
                opened = True
            elif cut:
                yield made([r[:cut] for r in rows], opened, False)
                opened = False
            rest = [r[cut:] for r in rows]
        if len(rest[0]):
            yield made(rest, opened, True)

    return near


def _elected(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the medoids of a bucket's pieces, one for ``CHUNK`` members, that next to the majority of the whole bucket."""
    rows = rows.sort_values("cid", ignore_index=True)
    bits = np.sum(np.stack(rows["bits"].to_list()), axis=0)
    at = medoid(rows["fp"].to_numpy(np.int64).view(np.uint64), bits[1:], bits[0])
    return rows.iloc[at:at + 1][["bucket", "cid", "fp", "n"]]


def bucketed(classes: DataFrame) -> DataFrame:
    """A row for each bucket of a class (cid, fp, n, bands)."""
    return written(classes.select("cid", "fp", F.col("n").cast("bigint").alias("n"), F.explode("bands").alias("bucket"),
                                  gray_rank(F.col("fp")).alias("rank")), "buckets")


def candidates(classes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Pairs ``(a, b)`` of classes (cid, fp, n, bands), of which ``rows`` are the buckets, to be verified first."""
    order = ["bucket", "rank", "cid"]
    found = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("bucket", "cid", "fp", "n")
        .mapInPandas(_bucket_pairs(similarity, chunk), "bucket bigint, a bigint, b bigint, fp bigint, n bigint, bits array<bigint>"), "bucket-pairs")
    medoids = found.filter("a = b").select("bucket", F.col("a").alias("cid"), "fp", "n", "bits")
    again = medoids.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    heads = written(medoids.join(again, "bucket", "left_semi").groupBy("bucket").applyInPandas(
        _elected, "bucket bigint, cid bigint, fp bigint, n bigint"), "heads-of-buckets")
    head = heads.select("bucket", F.col("cid").alias("h"), F.col("fp").alias("hfp"), F.col("n").alias("hn"))
    met = rows.join(head, "bucket").filter(
        (F.col("cid") != F.col("h")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hfp"))) <= FAR)
        & (F.least("n", "hn") >= similarity * F.greatest("n", "hn")))
    pairs = found.filter("a <> b").select("a", "b").unionByName(
        met.select(F.least("cid", "h").alias("a"), F.greatest("cid", "h").alias("b")))
    # The index of operator 8: its stars join fingerprints, whose smallest classes are paired.
    heads_of = classes.groupBy("fp").agg(F.min("cid").alias("cid"))
    stars = written(simhash.links(written(classes.select("fp").distinct(), "fps")), "stars")
    side = lambda c, name: heads_of.select(F.col("fp").alias(c), F.col("cid").alias(name))
    linked = stars.join(side("a", "x"), "a").join(side("b", "y"), "b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = classes.select("fp", "cid").join(heads_of.withColumnRenamed("cid", "x"), "fp").filter("cid <> x").select(
        F.col("x").alias("a"), F.col("cid").alias("b"))
    return pairs.unionByName(linked).unionByName(same).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose ``sets`` (cid, shingles) have the similarity, exactly."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb")
    return (pairs.join(side("a"), "a").join(side("b"), "b").withColumn("__both", both)
            .filter(F.col("__both") >= similarity * (whole - F.col("__both"))).select("a", "b"))


def open_buckets(rows: DataFrame, roots: DataFrame, cell: int = CELL, shingles: int = CELL_SHINGLES) -> DataFrame:
    """The members (bucket, cid, root, cells) of buckets that hold more than one root; ``cells`` is the number of blocks to deal them to."""
    joined = rows.select("bucket", "cid", "n").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    wide = joined.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.greatest(F.ceil(F.count("*") / cell), F.ceil(F.sum("n") / shingles), F.lit(1)).cast("int").alias("cells")).filter("low <> high")
    return joined.join(wide.select("bucket", "cells"), "bucket").select("bucket", "cid", "root", "cells")


def _cell_pairs(similarity: float):
    """Pairs of similar sets with different roots: of one block's members, or between two blocks' members."""

    def near(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid", ignore_index=True)
        cid, root, own = (rows[c].to_numpy(np.int64) for c in ("cid", "root", "own"))
        sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        roots, of, members = np.unique(root, return_inverse=True, return_counts=True)
        found = [np.zeros((0, 2), np.int64)]
        asked = np.flatnonzero(of != members.argmax()) if len(roots) > 1 else []  # a pair has one outside the largest root
        code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(asked) else size[:0]
        by = np.argsort(code, kind="stable")
        holder = np.repeat(np.arange(len(sets)), size)[by]
        first = np.concatenate([[0], np.cumsum(np.bincount(code))])
        start = np.cumsum(size) - size
        across = key[1] != key[2]
        for x in asked:
            mine = code[start[x]:start[x] + size[x]]
            n = first[mine + 1] - first[mine]
            met = holder[np.arange(n.sum()) + np.repeat(first[mine] - np.cumsum(n) + n, n)]
            both = np.bincount(met, minlength=len(sets))
            like = (both >= similarity * (size + size[x] - both)) & (root != root[x])
            if across:
                like &= own != own[x]
            y = np.flatnonzero(like)
            found.append(np.stack([np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return near


def rest(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All similar pairs ``(a, b)`` of ``open_buckets`` that are not joined. Every block of a bucket meets every other in a cell."""
    own = F.pmod(F.xxhash64("cid"), F.col("cells")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "root")
    return cells.join(sets, "cid").groupBy("bucket", "i", "j").applyInPandas(_cell_pairs(similarity), "a bigint, b bigint").distinct()


def _first(doc_id: str, same: str) -> Column:
    return F.min(F.struct(F.col(doc_id).isNull().alias("nameless"), F.col(doc_id).alias("doc_id"), F.col(same).alias("same")))


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK,
           cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, same, key)``, and of each key ``(key, cid, root)``; equal roots are near duplicates.

    ``same`` is a hash of the text, ``key`` one of its shingle set.
    """
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("same"), _sketch(shingle)(F.col("text")).alias("s")).select(
        "doc_id", "same", "s.*"), "sketches")
    classes = written(rows.groupBy("key").agg(
        F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), _first("doc_id", "same").alias("rep"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = bucketed(classes)
    pairs = written(candidates(classes, buckets, similarity, chunk), "candidates")

    def sets_of(asked: DataFrame) -> DataFrame:
        of = classes.join(asked, "cid").select("cid", F.col("rep.doc_id").alias("__id"), F.col("rep.same").alias("__same"))
        texts = docs.select("doc_id", "text").join(
            of, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__same")))
        return written(texts.select("cid", "text").dropDuplicates(["cid"]).select(
            "cid", _sets(shingle)(F.col("text")).alias("shingles")), "shingles")

    sets = sets_of(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
    near = written(verified(pairs, sets, similarity), "near")
    roots = components(near)
    members = written(open_buckets(buckets, roots, cell), "open-buckets")
    if not members.isEmpty():
        others = sets_of(members.select("cid").distinct().join(sets, "cid", "left_anti"))
        more = written(rest(members, sets.unionByName(others), similarity), "near-rest")
        if not more.isEmpty():
            roots = components(written(near.unionByName(more), "all-near"))
    heads = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", "cid", F.coalesce("root", "cid").alias("root"))
    return rows.select("doc_id", "same", "key"), written(heads, "groups")


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Words are runs of letters and digits without case. Texts of fewer words than a shingle are equal or
    different; null, empty and wordless texts are one group. A row without an id stays only in a group
    that has no id at all. Rows that repeat id and text are one; rows that share only the id are documents of
    their own. All columns are kept as they are.
    """
    rows, heads = groups(docs, shingle, similarity)
    kept = written(
        rows.join(heads, "key").groupBy("root").agg(_first("doc_id", "same").alias("rep"))
        .select(F.col("rep.doc_id").alias("__id"), F.col("rep.same").alias("__same"))
        .join(rows.groupBy(F.col("doc_id").alias("id"), F.col("same").alias("s")).agg(F.count("*").alias("__n")),
              F.col("__id").eqNullSafe(F.col("id")) & (F.col("__same") == F.col("s"))).select("__id", "__same", "__n"), "kept")
    met = lambda some: docs.join(
        some.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__same")), "left_semi")
    again = met(kept.filter("__n > 1"))
    return met(kept.filter("__n = 1")).unionByName(
        again.withColumn("__same", F.xxhash64("text")).dropDuplicates(["doc_id", "__same"]).select(docs.columns))
