"""Connected components of an edge table by hooking and contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.session import written


def _ordered(a, b):
    return F.greatest(a, b).alias("high"), F.least(a, b).alias("low")


def _jumped(hooks: DataFrame) -> DataFrame:
    """``hooks`` (child, parent) with every parent a root: pointers double until none moves."""
    up = lambda h: h.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
    while not hooks.join(up(hooks), "parent", "left_semi").isEmpty():
        hooks = written(
            hooks.join(up(hooks), "parent", "left").select("child", F.coalesce("above", "parent").alias("parent")),
            "hooks")
    return hooks


def components(edges: DataFrame) -> DataFrame:
    """Each node that has an edge and is not the smallest of its component, with that smallest node.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and loops do not matter.
    Returns ``(node, root)``; roots and nodes without edges are left out. Every round hooks each
    node to its smallest neighbour and contracts the edges to roots, so at least half of the
    nodes that still have edges go. Rounds are written to the shared folder, and
    joins are plain equi-joins, whose hot keys AQE splits.
    """
    links = written(edges.filter("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        hooks = _jumped(written(
            links.groupBy(F.col("high").alias("child")).agg(F.min("low").alias("parent")), "hooks"))
        rounds.append(hooks)
        of = lambda side: hooks.select(F.col("child").alias(side), F.col("parent").alias(f"{side}_root"))  # noqa: E731,B023
        moved = links.join(of("high"), "high").join(of("low"), "low", "left")
        low = F.coalesce("low_root", "low")
        links = written(
            moved.filter(F.col("high_root") != low).select(*_ordered(F.col("high_root"), low)).distinct(), "links")
    if not rounds:
        return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    whole = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        above = whole.select(F.col("child").alias("parent"), F.col("parent").alias("top"))
        whole = earlier.join(above, "parent", "left").select(
            "child", F.coalesce("top", "parent").alias("parent")).unionByName(whole)
    return written(whole.select(F.col("child").alias("node"), F.col("parent").alias("root")), "components")
