"""Sums of given pairs of models and papers against a plain loop."""

import math

import numpy as np
import pytest

from dailyfolio.operators import pairs, prefmodel


@pytest.mark.parametrize("slice_papers, block_terms", [(10_000, 10_000), (6, 9)])
def test_pair_sums(spark, slice_papers, block_terms):
    """Repeated rows of papers and models count as often as they come; pairs without a shared term, model or paper give nothing."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    counts = [(f"p{i}", *(lambda t: (t, [int(x) for x in rng.integers(1, 5, len(t))]))(sorted(rng.choice(words, i % 6, replace=False).tolist())))
              for i in range(30)] + [("p5", ["w1"], [2])]
    models = [(u, f, t, 1 + float(rng.random()), float(rng.normal())) for u in range(4) for f in (1, 2)
              for t in rng.choice(words, 5, replace=False).tolist()] + [(0, 1, "w1", 1.5, None), (0, 1, "w1", 1.5, 2.0)]
    asked = [(int(rng.integers(0, 5)), int(rng.integers(1, 3)), f"p{rng.integers(0, 33)}") for _ in range(90)] + [(None, 1, "p5"), (0, 1, "p5")]
    want = {}
    for u, f, p in set(asked):
        for paper, terms, tfs in counts:
            for mu, mf, term, idf, coef in models:
                if (mu, mf, paper) == (u, f, p) and term in terms:
                    w = (1 + math.log(tfs[terms.index(term)])) * idf
                    dot, square = want.get((u, f, p), (0, 0))
                    want[u, f, p] = dot + w * (coef or 0), square + w * w
    got = pairs.pair_sums(spark.createDataFrame(asked, "user_id bigint, fold int, paper_id string"),
                          spark.createDataFrame(counts, "paper_id string, terms array<string>, tfs array<int>"),
                          spark.createDataFrame(models, "user_id bigint, fold int, term string, idf double, coef double"),
                          ["user_id", "fold"], slice_papers, block_terms)
    assert "explode(arrays_zip" not in got._jdf.queryExecution().toString()  # no row per pair and term
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        dot, square = want[r["user_id"], r["fold"], r["paper_id"]]
        assert r["_dot"] == pytest.approx(dot, abs=1e-9) and r["_norm"] == pytest.approx(math.sqrt(square))


def test_terms_of_a_rating_travel_once(spark, monkeypatch):
    """A user beyond the bound has six models, but each of their ratings is joined to its terms once."""
    joined = []
    own = prefmodel._with_terms
    monkeypatch.setattr(prefmodel, "_with_terms", lambda rows, counts: joined.append(rows) or own(rows, counts))
    training = spark.range(60).selectExpr("1L AS user_id", "id AS rating_id", "concat('p', id) AS paper_id", "cast(id % 3 = 0 AS int) AS label")
    counts = spark.range(60).selectExpr("concat('p', id) AS paper_id", "array(concat('a', id % 7), concat('b', id % 5)) AS terms", "array(1, 2) AS tfs")
    trained = prefmodel.train(training, counts, 5, max_train_rows=40)
    assert prefmodel.held_out(trained).count() == 60
    for rows in joined:
        assert rows.count() == rows.select("rating_id").distinct().count()
    assert joined[-1].count() <= 60


@pytest.mark.parametrize("slice_papers, block_terms", [(10_000, 10_000), (6, 9)])
def test_largest_gradient(spark, slice_papers, block_terms):
    """Against a plain loop: papers come twice, ratings repeat, papers are unknown, a model has no term."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    counts = [(f"p{i}", *(lambda t: (t, [int(x) for x in rng.integers(1, 5, len(t))]))(sorted(rng.choice(words, i % 6, replace=False).tolist())))
              for i in range(30)] + [("p5", ["w1"], [2])]
    models = {(u, f): {t: (1 + float(rng.random()), float(rng.normal())) for t in rng.choice(words, 5, replace=False).tolist()} for u in range(4) for f in (1, 2)}
    models[3, 2] = {}
    meta = {k: float(rng.normal()) for k in models}
    rated = [(int(rng.integers(0, 5)), int(rng.integers(1, 3)), f"p{rng.integers(0, 33)}", int(rng.integers(0, 2)), float(rng.random())) for _ in range(120)]
    rated += [*rated[:3], (0, 1, None, 1, 0.5), (3, 2, "p4", 0, 0.7)]
    want = {}
    for key, own in models.items():
        mine = [r for r in rated if r[:2] == key]
        slopes, bias = {}, 0.0
        for paper in {r[2] for r in mine}:
            again = [r for r in mine if r[2] == paper]
            cells = [(t, (1 + math.log(n)) * own[t][0]) for p, terms, tfs in counts if p == paper for t, n in zip(terms, tfs) if t in own]
            square = sum(w * w for _, w in cells)
            z = meta[key] + (sum(w * own[t][1] for t, w in cells) / math.sqrt(square) if square else 0)
            pull = sum(w * (1 / (1 + math.exp(-z)) - y) for *_, y, w in again)
            bias += pull
            for t, w in cells:
                slopes[t] = slopes.get(t, 0) + pull * w / math.sqrt(square * len(again))
        if mine:
            want[key] = max(abs(bias), *(abs(s + own[t][1]) for t, s in slopes.items()), 0)
    got = pairs.steepest(spark.createDataFrame(rated, "user_id bigint, fold int, paper_id string, label int, weight double"),
                         spark.createDataFrame(counts, "paper_id string, terms array<string>, tfs array<int>"),
                         spark.createDataFrame([(*k, t, *x) for k, own in models.items() for t, x in own.items()],
                                               "user_id bigint, fold int, term string, idf double, coef double"),
                         spark.createDataFrame([(*k, b) for k, b in meta.items()], "user_id bigint, fold int, intercept double"),
                         ["user_id", "fold"], slice_papers, block_terms)
    assert "explode(arrays_zip" not in got._jdf.queryExecution().toString()  # no row per rating, fold and term
    assert {(r["user_id"], r["fold"]): r["s"] for r in got.collect()} == {k: pytest.approx(x, abs=1e-9) for k, x in want.items()}
