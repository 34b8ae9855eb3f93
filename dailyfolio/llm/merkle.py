"""A Merkle manifest of a dataset, level by level with lag and lead.

Each row is a leaf, each language a tree, and the trees' roots are the leaves of the dataset's own
tree. Rows are numbered within their language, and runs of ``fan ** height`` consecutive nodes form
one window. In it a level's nodes stand on the first row of what they cover, so siblings are lag and lead
columns at fixed offsets, masked by the slot of a node among its siblings and by the length of a last, shorter run; the first-child
rows hash the parents. What a window ends with is a row of the next round, so a tree of any size takes
a few rounds whose rows fall by the window's length, and no window spans a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.session import written

FAN = 2
#: Levels that one window climbs (256 nodes for a fan of two).
HEIGHT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Divides the unsigned crc32 of the ids whose rows are tampered with.
TAMPERED = 7

_SIBLINGS = "array<struct<before: string, after: string>>"


def cell(value: Column) -> Column:
    """``-`` for null, else the byte count in UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[cell(v) for v in values]), 256)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the place ``pos`` (from 0) of each within its ``grp``, in the order of ``by``, and the group's size ``n``.

    Ranges of (grp, by) are sorted in their own partitions; a count per range and group, as many
    rows as there are ranges and groups, shifts the places. A running number breaks ties, so rows
    that repeat are dealt to several ranges too.
    """
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    order = ["grp", *by, "__tie"]
    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        .drop("__tie"), "placed")
    group = Window.partitionBy("grp")
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("grp", "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).select(
        "grp", "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(group).alias("n"))
    return placed.join(shift, ["grp", "__range"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop(
        "__range", "__at", "__shift")


def climbed(rows: DataFrame, fan: int, height: int) -> DataFrame:
    """``rows`` (grp, pos, n, node) with ``run``, its number, ``top``, the node above the run (on the run's first row),
    and ``path``: the siblings beside the ancestors of each row, from its own level up.

    Levels where a group has only one node left are skipped, so a lone node is its own root.
    """
    span = fan ** height
    out = rows.withColumn("run", F.floor(F.col("pos") / span).cast("bigint"))
    in_run = Window.partitionBy("grp", "run").orderBy("pos")
    so_far = in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("__d0", F.col("node"))
    steps = []
    for level in range(height):
        step = fan ** level
        node, here, up = F.col(f"__d{level}"), f"__s{level}", f"__d{level + 1}"
        nodes = F.ceil(F.col("n") / step)
        index = F.floor(F.col("pos") / step)
        slot = index % fan
        length = F.least(F.lit(fan), nodes - (index - slot))
        first = F.col("pos") % step == 0  # rows that carry a node of this level
        out = out.withColumns({
            **{f"__b{k}": F.lag(node, k * step).over(in_run) for k in range(1, fan)},
            **{f"__a{k}": F.lead(node, k * step).over(in_run) for k in range(1, fan)}})
        left = [F.when(slot >= k, F.col(f"__b{k}")).otherwise("") for k in range(fan - 1, 0, -1)]
        right = [F.when(slot + k < length, F.col(f"__a{k}")).otherwise("") for k in range(1, fan)]
        pair = F.struct(F.concat(*left).alias("before"), F.concat(*right).alias("after"))
        climbs = nodes > 1
        out = out.withColumns({
            here: F.when(first & climbs, pair),
            up: F.when(first & (slot == 0), F.when(climbs, F.sha2(F.concat(node, *right), 256)).otherwise(node)),
        }).drop(*[f"__{x}{k}" for x in "ba" for k in range(1, fan)])
        steps.append(here)
    # The rows below a first child take what it has: nothing but nulls stands between.
    out = out.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in steps[1:]})
    return out.withColumn("path", F.filter(F.array(*steps), lambda s: s.isNotNull())).withColumn(
        "top", F.col(f"__d{height}")).drop(*steps, *[f"__d{k}" for k in range(height + 1)])


def plain_crown(roots: DataFrame) -> DataFrame:
    """What stands above the roots (grp, node) of the groups: nothing."""
    return roots.select("grp", F.array().cast(_SIBLINGS).alias("path"), F.col("node").alias("root"))


def tree(rows: DataFrame, fan: int = FAN, height: int = HEIGHT, crown=plain_crown) -> DataFrame:
    """``rows`` (grp, pos, n, node, ...) with ``path``, all siblings up to the root of its group, and ``root``.

    ``crown`` gives each group's root the ``path`` that stands above it, and further columns.
    The rows themselves are read twice and never shuffled with their paths.
    """
    span = fan ** height
    slim = rows.select("grp", "pos", "n", "node")
    tops = written(climbed(slim, fan, height).filter(F.col("pos") % span == 0).select(
        "grp", F.col("run").alias("pos"), F.ceil(F.col("n") / span).cast("bigint").alias("n"), F.col("top").alias("node")), "tops")
    if tops.filter("n > 1").isEmpty():
        above = crown(tops.select("grp", "node")).withColumn("run", F.lit(0).cast("bigint"))
    else:
        above = tree(tops, fan, height, crown).withColumnRenamed("pos", "run").drop("n", "node")
    above = above.withColumnRenamed("path", "__above")
    return climbed(rows, fan, height).drop("top").join(above, ["grp", "run"]).withColumn(
        "path", F.concat("path", "__above")).drop("__above", "run")


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` and the siblings give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame, fan: int = FAN, height: int = HEIGHT, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, claimed`` of every row.

    ``path`` lists the siblings level by level from the leaf over the language's root (``subroot``)
    to the ``root``; ``claimed`` is the leaf with ``n_chars`` raised by one where ``TAMPERED`` divides the
    crc32 of the id, else the leaf. Null cells have a leaf text of their own, a null language is a tree of its
    own and comes first, a null id comes first in its language and is never tampered with; at the largest
    integer ``n_chars`` stays. Rows that repeat an id go by their leaf; wholly equal rows are leaves each.
    A lone leaf is its language's root, with an empty path. An empty table gives no row; other columns are not read.
    """
    lang = F.col("lang").cast("string")
    more = {"n_chars": F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))}
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    made = written(docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("grp"),
        leaf(*[F.col(c) for c in columns]).alias("node"),
        F.when(hit, leaf(*[more.get(c, F.col(c)) for c in columns])).alias("__claimed")), "leaves")

    def crown(subroots: DataFrame) -> DataFrame:
        langs = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("__lang"), "node")
        return tree(numbered(langs, ["__lang"]), fan, height).select(
            F.col("__lang").alias("grp"), "path", F.col("node").alias("subroot"), "root")

    leaves = tree(numbered(made, ["doc_id", "node"]), fan, height, crown)
    return leaves.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "path",
                         F.coalesce("__claimed", "node").alias("claimed"))


def verified(rows: DataFrame) -> DataFrame:
    """A manifest with ``proof_sha256``, the hash of all siblings, and the root that the claimed leaf gives."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    root = folded(F.col("claimed"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def sql() -> str:
    """The same over a view ``documents``, for DuckDB (a fan of two)."""
    enc = lambda c, v=None: (
        f"coalesce(strlen(({v or c})::VARCHAR)::VARCHAR || ':' || ({v or c})::VARCHAR, '-')")
    cells = " || ".join(enc(c) for c in COLUMNS)
    claimed = " || ".join(enc(c, "n_chars + 1" if c == "n_chars" else None) for c in COLUMNS)
    # crc32 by its shift register: each digit, then eight shifts.
    crc = ("xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
           "lambda s, c: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(s, c)), "
           "4294967295::BIGINT))")

    def climb(name: str, leaves: str) -> str:
        return f"""
{name}(grp, lvl, pos, n, h) AS (
  SELECT grp, 0, pos, n, h FROM {leaves}
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 2)"""

    return f"""
WITH RECURSIVE made AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({cells}) AS h,
         CASE WHEN {crc} % {TAMPERED} = 0 THEN sha256({claimed}) END AS claimed FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n FROM made),
{climb("nodes", "leaves")},
subroots AS (
  SELECT '' AS grp, grp AS lang, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
{climb("tops", "subroots")},
steps AS (
  SELECT l.grp, l.pos AS leaf, s.lvl, (l.pos >> s.lvl) & 1 AS side, s.h
  FROM leaves l JOIN nodes s ON s.grp = l.grp AND s.n > 1 AND s.pos = xor(l.pos >> s.lvl, 1)
  UNION ALL
  SELECT l.grp, l.pos, 100 + s.lvl, (t.pos >> s.lvl) & 1, s.h
  FROM leaves l JOIN subroots t ON t.lang = l.grp JOIN tops s ON s.n > 1 AND s.pos = xor(t.pos >> s.lvl, 1)),
levels AS (
  SELECT l.grp, l.pos AS leaf, row_number() OVER (PARTITION BY l.grp, l.pos ORDER BY v.lvl) AS k, s.side, s.h
  FROM leaves l
  JOIN (SELECT DISTINCT grp, lvl FROM nodes WHERE n > 1
        UNION SELECT lang, 100 + lvl FROM subroots, (SELECT DISTINCT lvl FROM tops WHERE n > 1)) v ON v.grp = l.grp
  LEFT JOIN steps s ON s.grp = l.grp AND s.leaf = l.pos AND s.lvl = v.lvl),
proofs AS (
  SELECT grp, leaf, list(struct_pack(side := side, h := coalesce(h, '')) ORDER BY k) AS path FROM levels GROUP BY grp, leaf),
folds AS (
  SELECT l.doc_id, l.h AS leaf, t.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
         sha256(coalesce(list_reduce(list_transform(p.path, lambda s: s.h), lambda a, b: a || b), '')) AS proof_sha256,
         list_reduce(list_transform(coalesce(p.path, []), lambda s: CASE WHEN s.side = 1 THEN s.h || '<' ELSE s.h || '>' END),
                     lambda a, s: sha256(CASE WHEN ends_with(s, '<') THEN s[:-2] || a ELSE a || s[:-2] END),
                     coalesce(l.claimed, l.h)) AS folded_root
  FROM leaves l JOIN subroots t ON t.lang = l.grp LEFT JOIN proofs p ON p.grp = l.grp AND p.leaf = l.pos)
SELECT *, folded_root = root AS verified FROM folds"""
