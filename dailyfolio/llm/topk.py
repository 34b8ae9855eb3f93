"""Exact top-k search by inner product in three phases with a uniform threshold.

Components are dealt to ``nodes`` (component ``i`` to node ``i % nodes``); a node knows only its part of
a score. Phase one gathers every node's list of best local scores for each query and resolves what stands on
one, which gives the safe cutoff: the k-th best of those exact scores. A score that reaches it has some local
score of at least its ``nodes``-th part, so in phase two, with the cutoffs sent to all nodes, each returns all its entries from there on. Upper
bounds of what is only partly known prune once more, and phase three asks the other nodes for the missing parts.

Equal vectors are one class with its smallest ids, so copies are scored once. Rows meet queries in
slices and blocks of bounded size, one pair of them at a time in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.operators.ranking import keep_ranked
from dailyfolio.session import written

K = 5
EVERY = 50
SCALE = 256
NODES = 2
#: Classes of a slice and query classes of a block: together they bound what a task holds.
SLICE = 4096
BLOCK = 1024
#: Queries whose local scores are sorted at once.
STEP = 64
#: Partial products beyond it count as it; sums of a few nodes then stay long integers.
MOST = 1 << 59

_ENTRY = "qid bigint, cid bigint, size int, node int, part bigint"


def vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Distinct ``(vec_id, v)`` with ``v`` the components as ``floor(scale * x)``.

    Rows without an id, without a vector, or with a null or non-finite component take no part.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def matrix(cells: pd.Series) -> np.ndarray:
    """One row per vector; shorter ones are filled up with zeros."""
    width = max((len(c) for c in cells), default=0)
    out = np.zeros((len(cells), width), np.int64)
    for i, c in enumerate(cells):
        out[i, :len(c)] = c
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact, at most ``MOST`` in size."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * width
    if bound < 1 << 53:  # every partial sum is a whole double
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound <= MOST:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -MOST, MOST).astype(np.int64)


def _parts(nodes: int):
    """Exploded, the components of each node."""

    def part(node: int):
        return F.filter("v", lambda _, i: i % nodes == node)

    return F.posexplode(F.array(*[part(j) for j in range(nodes)])).alias("node", "part")


def _entries(qid, cid, size, node, part) -> pd.DataFrame:
    return pd.DataFrame({"qid": qid, "cid": cid, "size": size, "node": np.int32(node), "part": part}).astype(
        {"size": np.int32, "node": np.int32})


_NONE = _entries(*[np.zeros(0, np.int64)] * 5)


def _local_best(need: int):
    """Of a slice, each query's ``need`` best entries of one node; ties to the smaller id."""

    def best(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return _NONE
        rows = rows.sort_values("cid", ignore_index=True)
        b, out = matrix(rows["part"]), []
        for at in range(0, len(queries), STEP):
            some = queries.iloc[at:at + STEP]
            s = products(matrix(some["part"]), b)
            top = np.argsort(-s, axis=1, kind="stable")[:, :need]
            q = np.repeat(some["qid"].to_numpy(), top.shape[1])
            out.append(_entries(q, rows["cid"].to_numpy()[top.ravel()], rows["size"].to_numpy()[top.ravel()], key[0],
                                np.take_along_axis(s, top, 1).ravel()))
        return pd.concat(out, ignore_index=True)

    return best


def _above_cutoff(nodes: int):
    """Of a slice, the entries of one node of at least the ``nodes``-th part of the query's cutoff (all without one)."""

    def above(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return _NONE
        b, out = matrix(rows["part"]), [_NONE]
        for at in range(0, len(queries), STEP):
            some = queries.iloc[at:at + STEP]
            s = products(matrix(some["part"]), b)
            least = np.array([-(1 << 62) if pd.isna(c) else -(-int(c) // nodes) for c in some["cutoff"]], np.int64)
            q, r = np.nonzero(s >= least[:, None])
            out.append(_entries(some["qid"].to_numpy()[q], rows["cid"].to_numpy()[r], rows["size"].to_numpy()[r], key[0], s[q, r]))
        return pd.concat(out, ignore_index=True)

    return above


def _asked_for(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The entries of one node that the queries name."""
    if not len(rows) or not len(queries):
        return _NONE
    rows = rows.sort_values("cid", ignore_index=True)
    cid, size, b = rows["cid"].to_numpy(), rows["size"].to_numpy(), matrix(rows["part"])
    out = []
    for qid, part, want in zip(queries["qid"], queries["part"], queries["want"]):
        at = np.searchsorted(cid, np.asarray(want, np.int64))
        out.append(_entries(np.full(len(at), qid), cid[at], size[at], key[0], products(matrix(pd.Series([part])), b[at])[0]))
    return pd.concat(out, ignore_index=True)


class Search:
    """The node lists, sliced, and the parts of the queries, in blocks; both are written tables."""

    def __init__(self, classes: DataFrame, asked: DataFrame, need: int, nodes: int, slice_rows: int, block_rows: int):
        self.need, self.nodes = need, nodes
        self.slices = max(1, -(-classes.count() // slice_rows))
        self.blocks = max(1, -(-asked.count() // block_rows))
        self.lists = written(classes.select("cid", F.size("members").alias("size"), _parts(nodes), self.slice_of("cid")), "lists")
        self.queries = written(asked.select("qid", _parts(nodes), self._dealt("qid", self.blocks).alias("block")), "queries")

    def slice_of(self, cid: str):
        return self._dealt(cid, self.slices).alias("slice")

    @staticmethod
    def _dealt(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def _rows(self) -> DataFrame:
        """Every slice once for each block of queries."""
        return self.lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))

    def _met(self, queries: DataFrame, fn) -> DataFrame:
        keys = ["node", "slice", "block"]
        return self._rows().groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(fn, _ENTRY)

    def _everywhere(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))))

    def local_lists(self) -> DataFrame:
        """Phase one: each node's ``need`` best entries of each query."""
        found = self._met(self._everywhere(self.queries), _local_best(self.need))
        return keep_ranked(found, ["qid", "node"], [F.col("part").desc(), F.col("cid").asc()], self.need)

    def above(self, cutoffs: DataFrame) -> DataFrame:
        """Phase two: every entry from the uniform threshold on."""
        return self._met(self._everywhere(self.queries.join(cutoffs, "qid", "left")), _above_cutoff(self.nodes))

    def completed(self, seen: DataFrame) -> DataFrame:
        """``seen`` (qid, cid, size, known: the nodes seen, total: their sum) with whole totals, by asking the other nodes."""
        every = F.sequence(F.lit(0), F.lit(self.nodes - 1))
        open_ = seen.filter(F.size("known") < self.nodes)
        want = (open_.select("qid", "cid", F.explode(F.array_except(every, F.col("known"))).alias("node"))
                .withColumn("slice", self.slice_of("cid"))
                .groupBy("qid", "node", "slice").agg(F.sort_array(F.collect_list("cid")).alias("want")))
        parts = self._met(self.queries.join(want, ["qid", "node"]), _asked_for)
        missing = parts.groupBy("qid", "cid").agg(F.sum("part").alias("rest"))
        return seen.join(missing, ["qid", "cid"], "left").select(
            "qid", "cid", "size", (F.col("total") + F.coalesce("rest", F.lit(0))).alias("score"))

    def cutoffs(self, scored: DataFrame) -> DataFrame:
        """The ``need``-th best of each query's exact scores, copies counted; no row where there are fewer."""
        by = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid").rowsBetween(Window.unboundedPreceding, 0)
        return scored.withColumn("__so_far", F.sum("size").over(by)).filter(F.col("__so_far") >= self.need).groupBy(
            "qid").agg(F.max("score").alias("cutoff"))


def _seen(entries: DataFrame) -> DataFrame:
    return entries.groupBy("qid", "cid").agg(
        F.max("size").alias("size"), F.collect_set("node").alias("known"), F.sum("part").alias("total"))


def search(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, nodes: int = NODES,
           slice_rows: int = SLICE, block_rows: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best others of each row whose ``vec_id`` is divisible by ``every``.

    Scores are inner products of ``floor(scale * x)``, ties go to the smaller id; with fewer others than
    ``k`` all are returned. Vectors that are null or hold a null or non-finite component, and rows without an id, take no part.
    Rows that repeat id and vector count once; another vector under the same id is another row. In vectors of
    different lengths missing components count as zero. A node's part of a score saturates at ``MOST``.
    An empty table gives no row; other columns are not read.
    """
    need = k + 1  # a query finds itself
    ids = written(vectors(rows, scale), "vectors")
    classes = written(
        keep_ranked(ids, ["v"], [F.col("vec_id").asc()], need).groupBy("v").agg(
            F.sort_array(F.collect_list("vec_id")).alias("members"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    asked = written(ids.filter(F.col("vec_id") % every == 0).join(classes, "v").select(
        F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")), "asked")
    wanted = classes.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")
    nodes_of = Search(classes, wanted.select(F.col("cid").alias("qid"), "v"), need, nodes, slice_rows, block_rows)

    gathered = written(nodes_of.completed(written(_seen(nodes_of.local_lists()), "gathered")), "first")
    cutoffs = written(nodes_of.cutoffs(gathered), "cutoffs")
    seen = _seen(nodes_of.above(cutoffs)).join(
        gathered.select("qid", "cid", F.col("score").alias("exact")), ["qid", "cid"], "left")
    whole = F.size("known") == nodes
    seen = written(seen.withColumn("exact", F.when(whole, F.col("total")).otherwise(F.col("exact"))), "entries")
    sure = seen.filter("exact is not null").select("qid", "cid", "size", F.col("exact").alias("score"))
    better = nodes_of.cutoffs(sure).withColumnRenamed("cutoff", "second")
    most = F.col("total") + (nodes - F.size("known")) * F.floor((F.col("cutoff") - 1) / nodes).cast("bigint")
    doubtful = (seen.filter("exact is null").join(cutoffs, "qid", "left").join(better, "qid", "left")
                .filter(F.col("cutoff").isNull() | (most >= F.coalesce("second", "cutoff"))))
    scored = sure.unionByName(nodes_of.completed(
        written(doubtful.select("qid", "cid", "size", "known", "total"), "doubtful")))

    return _expanded(scored, classes, asked, k)


def _expanded(scored: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best rows of each query from the best classes: those are at most ``k + 1``, each with as many smallest ids."""
    named = scored.join(classes.select("cid", "members"), "cid")
    order = [F.col("score").desc(), F.col("members")[0].asc()]
    few = keep_ranked(named, ["qid"], order, k + 1).select("qid", "cid", "score", F.explode("members").alias("vec_id"))
    few = keep_ranked(few, ["qid"], [F.col("score").desc(), F.col("vec_id").asc(), F.col("cid").asc()], k + 1)
    others = asked.join(few, "qid").filter((F.col("vec_id") != F.col("query_id")) | (F.col("cid") != F.col("qid")))
    out = keep_ranked(others, ["query_id", "qid"], [F.col("score").desc(), F.col("vec_id").asc(), F.col("cid").asc()], k, rank="rank")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    """The same over a view ``embeddings``, for DuckDB (vectors of one length)."""
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id OR q.e <> c.e WHERE q.vec_id % {every} = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= {k}"""
