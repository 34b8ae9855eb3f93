"""Models of users with many ratings against Newton's method on the dense problem, and packed numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailyfolio import schemas
from dailyfolio.operators import largefit, prefmodel, totals
from dailyfolio.plans import retrain
from dailyfolio.sources.tables import TableStore
from test_jobs import put_user, stored_papers
from test_models import dealt_folds, reference_fit, training_case


def test_packed_numbers():
    for most in (0, 255, 256, 70_000, 1 << 33):
        assert totals.unpack(totals.pack(np.array([most, 0, 3]))).tolist() == [most, 0, 3]
    assert totals.unpack(totals.pack(np.array([], np.int64))).tolist() == []


def test_all_ratings_are_fitted_by_default(spark, monkeypatch):
    """User 0 has 120 ratings, more than a task takes."""
    docs, rows, training, counts = training_case(spark, users=2)
    monkeypatch.setattr(largefit, "PIECE", 64)
    fitted = prefmodel.fit_models(training, counts, max_features=80, task_ratings=70).collect()
    for u in range(2):
        own = [r for r in rows if r[0] == u]
        _, terms, w = reference_fit(docs, own, 80)
        assert {r["n"] for r in fitted if r["user_id"] == u} == {len(own)}
        assert {r["term"]: pytest.approx(r["coef"], abs=1e-6) for r in fitted if r["user_id"] == u} == dict(zip([*terms, ""], w))


@pytest.mark.parametrize("local, slice_ratings", [(1 << 16, 1 << 16), (1 << 16, 25), (100, 40)])
def test_models_and_scores_of_all_ratings(spark, monkeypatch, local, slice_ratings):
    """In one task, with papers in several slices, and with user 0 fitted by steps over many chunks."""
    docs, rows, training, counts = training_case(spark, users=3)
    monkeypatch.setattr(largefit, "SLICE_RATINGS", slice_ratings)
    folded = prefmodel.assign_folds(training.where("user_id < 2"), 5)
    fitted = largefit.fit_large(folded, counts, range(6), 80, True, 100, 1e-9, local)
    trained = spark.createDataFrame(fitted.collect(), fitted.schema)
    models = {}
    for r in trained.where("term is not null").collect():
        models.setdefault((r["user_id"], r["fold"]), {})[r["term"]] = r
    held = {(r["user_id"], r["rating_id"]): r for r in prefmodel.held_out(trained).collect()}
    assert held.keys() == {(r[0], r[1]) for r in rows if r[0] < 2} and len(held) == trained.where("rating_id is not null").count()
    assert models.keys() == {(u, f) for u in range(2) for f in range(6)}
    for u in range(2):
        own = [r for r in rows if r[0] == u]
        folds = dealt_folds([r[3] for r in own], 5)
        for out in range(6):
            inside = [r for r, f in zip(own, folds) if f != out]
            vec, terms, w = reference_fit(docs, inside, 80)
            assert {t: m["coef"] for t, m in models[u, out].items()} == {t: pytest.approx(x, abs=1e-6) for t, x in zip([*terms, ""], w)}
            assert {m["n"] for m in models[u, out].values()} == {len(inside)}
            coef = dict(zip(terms, w))
            for _, rating, paper, label in (r for r, f in zip(own, folds) if f == out):
                z = sum(x * coef[t] for t, x in vec(docs[int(paper[1:])]).items()) + w[-1]
                assert (held[u, rating]["fold"], held[u, rating]["label"], held[u, rating]["paper_id"]) == (out, label, paper)
                assert held[u, rating]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@pytest.mark.parametrize("local", [1 << 16, 1])
def test_papers_without_terms_or_twice(spark, local):
    """Ratings of unknown papers count for the intercept, a paper that comes twice counts twice, one class gives no model."""
    ratings = [(1, i, f"p{i % 6}", int(i % 6 in (1, 2)) if i % 7 else 1) for i in range(40)] + [(1, 40, None, 0), (1, 41, "unknown", 1)]
    ratings += [(2, 100 + i, f"p{i % 6}", 1) for i in range(40)] + [(3, 200 + i, "unknown", i % 2) for i in range(40)]
    counts = spark.createDataFrame([(f"p{i}", ["a", f"t{i % 3}"], [1, 2]) for i in range(6)] + [("p3", ["b"], [1])],
                                   "paper_id string, terms array<string>, tfs array<int>")
    training = spark.createDataFrame(ratings, "user_id bigint, rating_id bigint, paper_id string, label int")
    folded = training.withColumn("fold", F.lit(1))
    got = {(r["user_id"], r["term"]): r for r in prefmodel.fitted_models(largefit.fit_large(folded, counts, [0], 80, False, 100, 1e-9, local)).collect()}
    want = {(r["user_id"], r["term"]): r for r in prefmodel.fit_models(training, counts, max_features=80, task_ratings=1000).collect()}
    assert got.keys() == want.keys() and {u for u, _ in got} == {1, 3}
    for k, r in want.items():
        assert (got[k]["coef"], got[k]["idf"], got[k]["n"]) == (pytest.approx(r["coef"], abs=1e-7), pytest.approx(r["idf"]), r["n"])


def many_ratings(spark, n):
    """One user with ``n`` ratings, the oldest ten of papers that no other rating has."""
    paper = "CASE WHEN id < 10 THEN 'old' ELSE concat('p', id % 50) END"
    training = spark.range(n).selectExpr("1L AS user_id", "id AS rating_id", f"{paper} AS paper_id", "cast(id % 3 = 0 OR id % 50 < 10 AS int) AS label")
    counts = spark.range(50).selectExpr("concat('p', id) AS paper_id", "array(concat('a', id % 7), concat('b', id % 5)) AS terms", "array(1, 2) AS tfs")
    return training, counts.unionByName(spark.sql("SELECT 'old' AS paper_id, array('ancient') AS terms, array(1) AS tfs"))


def test_old_ratings_of_a_busy_user_are_fitted(spark):
    fitted = prefmodel.fit_models(*many_ratings(spark, 5200)).collect()
    assert {r["n"] for r in fitted} == {5200} and "ancient" in {r["term"] for r in fitted}


def test_old_ratings_of_a_busy_user_are_cross_validated(spark):
    trained = prefmodel.train(*many_ratings(spark, 6400), fold_models=True)
    models = trained.where("term is not null").select("fold", "n").distinct().collect()
    assert sorted((r["fold"], r["n"]) for r in models) == [(0, 6400), *((f, 5120) for f in range(1, 6))]
    assert prefmodel.held_out(trained).count() == 6400


def test_old_ratings_of_a_busy_user_are_retrained(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    papers = stored_papers(spark, ["p0", "p1", "p2", "p3"]).withColumn("abstract", F.when(F.col("id") == "p0", F.lit("ancient scroll")).when(
        F.col("id") == "p1", F.lit("graph nets")).otherwise(F.lit("cooking soup")))
    copies = spark.range(5100).selectExpr("concat('q', id) AS new", "CASE WHEN id < 20 THEN 'p0' ELSE concat('p', 1 + id % 3) END AS id", "id AS place")
    many = papers.join(copies, "id")
    store.replace("papers", many.withColumn("id", F.col("new")).select(*papers.columns))
    store.replace("ratings", many.selectExpr("place AS id", "11L AS user_chat_id", "new AS paper_id",
                                             "cast(CASE WHEN id = 'p1' OR place % 4 = 0 THEN 10 ELSE 1 END AS smallint) AS score",
                                             "timestamp '2024-01-10' AS created_at"))
    store.replace("models", spark.createDataFrame([], schemas.MODELS))
    store.replace("model_meta", spark.createDataFrame([], schemas.MODEL_META))
    (row,) = retrain.retrain_all(store)[0].collect()
    assert (row["user_id"], row["n"]) == (1, 5100) and 0 < row["cv_auc_mean"] < 1
    terms = {r["term"] for r in retrain.load_models(store)[0].collect()}
    assert "ancient scroll" in terms and "graph nets" in terms
