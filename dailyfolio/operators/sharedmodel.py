"""One preference model over all users: the fit without keys.

Nothing but the vocabulary and the weights, both of at most ``max_features`` rows, is in one place;
gradients are added up over the partitions, so the number of ratings has no bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dailyfolio.operators.retrieval import BIAS, MAX_FEATURES, exploded, fit_vocab, tfidf
from dailyfolio.session import scratch_path, spread, written

# Strength of the penalty as in the fits per user, the iterations, and the change at which the fit has converged.
C, STEPS, TOLERANCE = 1.0, 1000, 1e-12


def class_weights(rows: DataFrame) -> DataFrame:
    """Each row with ``weight = n / (2 * rows of its class)`` over the whole table."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
    n, own = sizes["n"], F.when(F.col("label") == 1, F.lit(sizes["n1"])).otherwise(F.lit(sizes["n"] - sizes["n1"]))
    return rows.withColumn("weight", F.lit(float(n)) / (2 * own))


def _with_vectors(vectors: DataFrame, terms: DataFrame, size: int, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` (label, weight) as the training table of the solver, with sparse feature vectors.

    Vectors are written as the struct that they are stored as and read as vectors: no row passes Python.
    """
    at = exploded(vectors, key, "weights", "w").join(F.broadcast(terms.select("term", "at")), "term")  # max_features rows
    packed = at.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("_v"))
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      F.coalesce("_v.at", F.array().cast("array<int>")).alias("indices"),
                      F.coalesce("_v.w", F.array().cast("array<double>")).alias("values"))
    path = scratch_path(rows.sparkSession, "vectors")
    rows.join(packed, list(key), "left").select(F.col("label").cast("double").alias("label"), "weight", sparse.alias("features")).write.parquet(path)
    schema = StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def fit_shared(training: DataFrame, counts: DataFrame, max_features: int = MAX_FEATURES,
               key: Sequence[str] = ("rating_id",)) -> DataFrame:
    """L2 logistic regression (C=1, balanced classes) over all rows (key, paper_id, label): rows (term, idf, coef, n).

    The intercept is the row of the bias term. One class gives no row. A paper counts for the vocabulary as often as it
    was rated; rows whose paper has no known term still count for the intercept.
    """
    key = list(key)
    spark = training.sparkSession
    none = spark.createDataFrame([], "term string, idf double, coef double, n bigint")
    rows = written(training.select(*key, "paper_id", "label"), "shared-training")
    if rows.select("label").distinct().count() < 2:
        return none
    texts = written(rows.join(counts, "paper_id").select(*key, "terms", "tfs"), "shared-texts")
    vocab = fit_vocab(exploded(texts, key), rows, max_features)
    # At most max_features rows: numbered in one task.
    vocab = written(vocab.withColumn("at", F.row_number().over(Window.orderBy("term")) - 1), "shared-vocab")
    size = vocab.count()
    weighted = class_weights(rows)
    vectors = tfidf(spread(texts, *key), vocab, key)
    table = _with_vectors(vectors, vocab, size, weighted.select(*key, "label", "weight"), key).persist()
    n = table.count()
    # The solver divides the loss by the sum of the weights, which is n, so the penalty is divided likewise.
    model = LogisticRegression(weightCol="weight", regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
                               maxIter=STEPS, tol=TOLERANCE).fit(table)
    table.unpersist()
    coefs = spark.createDataFrame(enumerate(model.coefficients.toArray().tolist()), "at int, coef double")
    bias = spark.createDataFrame([(BIAS, 0.0, float(model.intercept), n)], "term string, idf double, coef double, n bigint")
    fitted = vocab.join(coefs, "at").select("term", "idf", "coef", F.lit(n).cast("bigint").alias("n"))
    return fitted.unionByName(bias)
