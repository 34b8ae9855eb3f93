"""Quality rules: base rules, and robust multivariate outliers, in DataFrame functions alone.

Each text gives a vector of transformed statistics. Per language and source, the minimum
covariance determinant estimate of centre and spread is found by concentration steps from several
starts: of all rows the ``SUBSET`` share nearest to the last estimate makes the next one, and
the start with the smallest determinant wins. A text is rejected if its Mahalanobis distance
is too large. A step is one pass: sums are kept per group and distance class, so that choosing
the nearest rows needs no sort and no group meets in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.session import written

LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: Share of the rows that make an estimate, and steps from each start.
SUBSET = 0.75
STEPS = 3
#: Groups of fewer rows are pooled by language, then all together; a smaller pool rejects nothing.
LEAST_GROUP = 100
#: Squared distance from which a text is rejected, in units of the estimate's spread.
REJECT = 50.0
#: Variances that are added to every estimate: what a measured statistic is allowed to vary at least.
FLOORS = (0.05 ** 2, 0.05 ** 2, 0.12 ** 2, 0.12 ** 2)
DIMENSIONS = len(FLOORS)
#: Distance classes per doubling.
CLASSES = 16
#: Groups up to which estimates (some 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"
WINDOW = 3


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once although ``body`` may use it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_words(w: Column) -> Column:
    """Words in windows of three that the text has twice or more.

    Each window is one number: a hash over its place, in as many bits as the text needs. Sorted, equal
    windows are neighbours; their words are compared, so a shared hash makes no error.
    """
    n = F.size(w)

    def found(bits: Column) -> Column:
        def place(x: Column) -> Column:
            return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")

        def key(i: Column) -> Column:
            h = F.xxhash64(*[w[i + k] for k in range(WINDOW)])
            return F.coalesce(F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("bigint")), F.lit(0).cast("bigint"))

        def starts(s: Column) -> Column:
            def same(k: Column) -> Column:
                equal = F.call_function("shiftrightunsigned", s[k], bits) == F.call_function(
                    "shiftrightunsigned", s[k - 1], bits)
                for j in range(WINDOW):
                    equal = equal & (w[place(s[k]) + j] == w[place(s[k - 1]) + j])
                return equal

            twins = F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)
            return F.sort_array(F.flatten(F.transform(twins, lambda k: F.array(place(s[k - 1]), place(s[k])))))

        windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), key))
        return let(windows, lambda s: F.when(F.size(s) > 1, F.aggregate(
            starts(s), F.struct(F.lit(0).alias("count"), F.lit(0).alias("end")),
            lambda a, x: F.struct((a["count"] + x + WINDOW - F.greatest(a["end"], x)).alias("count"),
                                  (x + WINDOW).alias("end")),
            lambda a: a["count"])).otherwise(0))

    return F.when(n < WINDOW, 0).otherwise(let(F.length(F.bin(n.cast("bigint"))), found))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every row; a null text has none."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    big = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    raw = docs.select(
        "doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(_SYMBOL)).alias("n_symbols"))
    return raw.select(
        "doc_id", "lang", "source", big(F.col("w.n_words")).alias("n_words"), big(F.col("w.word_chars")).alias("word_chars"),
        big(F.col("n_symbols")).alias("n_symbols"), big(F.col("l.n_dup_lines")).alias("n_dup_lines"),
        big(F.col("w.n_repeat_words")).alias("n_repeat_words"), big(F.col("l.n_lines")).alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def vector() -> list[Column]:
    """Logarithm of the mean word length; roots of the shares of symbols, repeated lines, repeated words."""
    return [F.log(F.col("word_chars") / F.col("n_words")), F.sqrt(F.col("n_symbols") / F.col("word_chars")),
            F.sqrt(F.col("n_dup_lines") / F.col("n_lines")), F.sqrt(F.col("n_repeat_words") / F.col("n_words"))]


_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
_X = [f"x{i}" for i in range(DIMENSIONS)]
_PARAMS = [f"m{i}" for i in range(DIMENSIONS)] + [f"l{i}{j}" for i, j in _PAIRS]


def _factor(frame: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor ``l..`` of the spread ``c..``, a column at a time, and ``logdet``."""
    for j in range(DIMENSIONS):
        frame = frame.withColumn(f"l{j}{j}", F.sqrt(F.greatest(
            F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(FLOORS[j] / 4))))
        for i in range(j + 1, DIMENSIONS):
            frame = frame.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum(
                (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    return frame.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(DIMENSIONS)), F.lit(0.0)))


def _distance() -> Column:
    """The squared Mahalanobis distance of ``x..`` from ``m..`` by forward substitution in ``l..``."""
    y: list[Column] = []
    for i in range(DIMENSIONS):
        y.append((F.col(f"x{i}") - F.col(f"m{i}") - sum(
            (F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def consistency(subset: float = SUBSET) -> float:
    """What the spread of the nearest share of normal rows is multiplied by, to be that of all.

    In four dimensions the chi-square functions with 4 and 6 degrees are closed: one minus
    exp(-t/2) times the first terms of the exponential series.
    """
    below = lambda t, terms: 1 - math.exp(-t / 2) * sum((t / 2) ** k / math.factorial(k) for k in range(terms))
    low, high = 0.0, 100.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, DIMENSIONS // 2) < subset else (low, middle)
    return subset / below(low, DIMENSIONS // 2 + 1)


def _beside(rows: DataFrame, of_group: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what their group has; few groups are broadcast, so that a large group stays where it is."""
    few = of_group.count() <= 2 * BROADCAST_GROUPS  # two starts
    return rows.join(F.broadcast(of_group) if few else of_group, "grp", how)


def _estimates(sums: DataFrame, scale: float) -> DataFrame:
    """Centre and factor from the sums of the chosen rows."""
    frame = sums
    for i in range(DIMENSIONS):
        frame = frame.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i, j in _PAIRS:
        spread = (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
        frame = frame.withColumn(f"c{i}{j}", spread + FLOORS[i] if i == j else spread)
    return _factor(frame).select("grp", "start", *_PARAMS, "logdet")


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]]


def _starts(vectors: DataFrame) -> DataFrame:
    """Two first estimates of each group: all rows, and medians with median absolute deviations."""
    whole = _estimates(vectors.groupBy("grp").agg(*_sums()).withColumn("start", F.lit(0)), 1.0)
    middle = written(vectors.groupBy("grp").agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(_X)]), "medians")
    spread = _beside(vectors, middle).groupBy("grp").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMENSIONS)],
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i in range(DIMENSIONS)])
    for i, j in _PAIRS:
        spread = spread.withColumn(
            f"c{i}{j}", (F.col(f"d{i}") * 1.4826) ** 2 + FLOORS[i] if i == j else F.lit(0.0))
    spread = _factor(spread).withColumn("start", F.lit(1)).select("grp", "start", *_PARAMS, "logdet")
    return whole.unionByName(spread)


def _step(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of all groups and starts."""
    grade = F.floor(F.log2(_distance() + 2.0 ** -10) * CLASSES)
    classes = _beside(vectors, params).withColumn("grade", grade).groupBy("grp", "start", "grade").agg(*_sums())
    by = Window.partitionBy("grp", "start")
    before = F.coalesce(F.sum("n").over(by.orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = (classes.withColumn("before", before).withColumn("all", F.sum("n").over(by))
            .filter(F.col("before") < F.ceil(F.col("all") * SUBSET)))
    totals = [F.sum(c).alias(c) for c in classes.columns if c not in ("grp", "start", "grade")]
    return _estimates(near.groupBy("grp", "start").agg(*totals), consistency())


def grouped(stats: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """``stats`` with ``grp``, the group whose estimate judges the row; null where no pool is large enough."""
    passed = stats.filter(~base_failed())
    fine = written(passed.groupBy("lang", "source").agg(F.count("*").alias("rows")), "group-sizes")
    small = fine.filter(F.col("rows") < least).groupBy("lang").agg(F.sum("rows").alias("pooled"))
    rest = small.filter(F.col("pooled") < least).agg(F.coalesce(F.sum("pooled"), F.lit(0)).alias("rest"))
    name = lambda *c: F.to_json(F.array(*c))
    key = (F.when(F.col("rows") >= least, name("lang", "source"))
           .when(F.col("pooled") >= least, name("lang"))
           .when(F.lit((rest.first() or [0])[0] >= least), F.lit("[]")))
    names = written(fine.join(small, "lang", "left").select("lang", "source", key.alias("grp")), "groups")
    if names.count() <= BROADCAST_GROUPS:
        names = F.broadcast(names)
    return stats.join(names, ["lang", "source"], "left")


def judged(docs: DataFrame, least: int = LEAST_GROUP, reject: float = REJECT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` (squared, null without an estimate) and ``kept``.

    Every row gets a result; a null language or source counts as an empty one, a null text has no
    words and fails. Rows that repeat are counted as often as they stand. Other columns are not read.
    """
    stats = written(grouped(written(statistics(docs), "statistics"), least), "grouped")
    vectors = stats.filter(~base_failed() & F.col("grp").isNotNull()).select(
        "grp", *[v.alias(x) for x, v in zip(_X, vector())])
    params = written(_starts(vectors), "estimates")
    for _ in range(STEPS):
        params = written(_step(vectors, params), "estimates")
    best = written(params.groupBy("grp").agg(F.min_by(F.struct(*_PARAMS), F.struct("logdet", "start")).alias("b"))
                   .select("grp", "b.*"), "best")
    whole = stats
    for x, v in zip(_X, vector()):
        whole = whole.withColumn(x, F.when(~base_failed(), v))
    out = _beside(whole, best, "left").withColumn("base_failed", base_failed()).withColumn("distance", _distance())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= reject)).alias("kept"))
