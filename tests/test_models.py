"""Retrieval and preference models against plain numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dailyfolio.functions.text import ENGLISH_STOP_WORDS
from dailyfolio.operators import blocks, prefmodel, retrieval, sharedmodel

WORDS = [f"w{i:02d}" for i in range(60)] + ["the", "and", "été", "graph"]


def texts(n, seed=0, lo=0, hi=30):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(lo, hi))) for _ in range(n)]


def gram_counts(text):
    toks = [t for t in re.findall(r"\w\w+", text.lower()) if t not in set(ENGLISH_STOP_WORDS)]
    return Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])


class Vectoriser:
    def __init__(self, docs, cap):
        counted = [gram_counts(d) for d in docs]
        ctf, df = Counter(), Counter()
        for c in counted:
            ctf.update(c)
            df.update(c.keys())
        kept = sorted(ctf, key=lambda t: (-ctf[t], t))[:cap]
        self.idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}

    def __call__(self, text):
        w = {t: (1 + math.log(n)) * self.idf[t] for t, n in gram_counts(text).items() if t in self.idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}


def papers_frame(spark, docs):
    return spark.createDataFrame([(f"p{i:03d}", "", d) for i, d in enumerate(docs)], "id string, title string, abstract string")


@pytest.mark.parametrize("block_terms,slice_papers", [(10**6, 2048), (20, 2048), (20, 15)])
def test_profile_retrieval(spark, block_terms, slice_papers):
    docs, profiles = texts(70), texts(5, seed=3, lo=1, hi=4) + ["nothing known", "the"]
    index = retrieval.build_index(papers_frame(spark, docs), max_features=200)
    people = spark.createDataFrame(list(enumerate(profiles)), "user_id bigint, keyword_profile string")
    got = retrieval.top_n_for_profiles(index, people, 12, block_terms, slice_papers)
    vec = Vectoriser(docs, 200)
    vectors = [vec(d) for d in docs]
    want = []
    for u, p in enumerate(profiles):
        q = vec(p)
        sims = [(-round(sum(x * v.get(t, 0) for t, x in q.items()), 6), f"p{i:03d}") for i, v in enumerate(vectors)]
        want += [(u, r + 1, pid) for r, (_, pid) in enumerate(sorted(sims)[:12])]
    assert sorted((r["user_id"], r["rank"], r["paper_id"]) for r in got.collect()) == sorted(want)


def test_fewer_papers_than_asked(spark):
    index = retrieval.build_index(papers_frame(spark, ["graph nets", "other words"]))
    people = spark.createDataFrame([(1, "graph"), (2, "zzz")], "user_id bigint, keyword_profile string")
    got = [(r["user_id"], r["rank"], r["paper_id"]) for r in retrieval.top_n_for_profiles(index, people, 30).collect()]
    assert sorted(got) == [(1, 1, "p000"), (1, 2, "p001"), (2, 1, "p000"), (2, 2, "p001")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_do_not_grow_with_the_users(spark):
    index = retrieval.build_index(papers_frame(spark, texts(20))).materialize()
    sizes = {}
    for n in (1, 400):
        people = spark.range(n).selectExpr("id as user_id", "concat('graph nets ', id) as keyword_profile")
        models = spark.range(n).selectExpr("id as user_id", "'graph' as term", "1.5 as idf", "cast(id as double) as coef")
        meta = spark.range(n).selectExpr("id as user_id", "0.1D as intercept")
        for name, ranked in (("profiles", retrieval.top_n_for_profiles(index, people, block_terms=10)),
                             ("models", retrieval.top_n_for_models(index, models, meta, block_terms=10))):
            plan = plan_of(ranked)
            assert "Cartesian" not in plan and "CoGroups" in plan
            sizes.setdefault(name, set()).add(len(plan.splitlines()))
            assert ranked.count() == 20 * n
    assert all(len(s) == 1 for s in sizes.values())


def packed(rows, value):
    return pa.table({"paper_id": [f"p{i:04d}" for i in range(len(rows))], "codes": pa.array([list(r) for r in rows], pa.list_(pa.int64())),
                     value: pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))})


def test_bounds_skip_pairs_but_lose_none():
    rng = np.random.default_rng(7)
    for case in range(30):
        terms = 300
        # Frequent terms weigh little, rare ones much, as with idf; coarse values make ties.
        docs = [{int(t): float(np.round(rng.random() * (0.02 + t / terms), 2 if case % 2 else 6))
                 for t in np.unique((terms * rng.random(30) ** 2).astype(int))} for _ in range(400)]
        index = blocks.Impacts(packed(docs, "weights"))
        for q in range(4):
            query = {int(t): float(rng.random() * (0.05 + t / terms)) for t in np.unique((terms * rng.random(12) ** 2).astype(int))}
            index.added, n = 0, (1, 5, 30, 1000)[q]
            rows, scores = index.best(np.array(list(query)), np.array(list(query.values())), n)
            dots = [round(sum(w * d.get(t, 0) for t, w in query.items()), 6) for d in docs]
            want = sorted((-s, i) for i, s in enumerate(dots) if s > 0)[:n]
            assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in want] == list(zip(rows.tolist(), scores.tolist()))
            pairs = sum(len(d.keys() & query.keys()) for d in docs)
            assert index.added <= pairs and (n > 5 or index.added < 0.8 * pairs)


def test_empty_slices_blocks_and_papers():
    none = blocks.Impacts(packed([{}, {}], "weights"))
    assert len(none.best(np.array([1, 2]), np.array([0.5, 0.5]), 3)[0]) == 0
    assert len(blocks.Impacts(packed([], "weights")).best(np.array([1]), np.array([1.0]), 3)[0]) == 0
    papers = packed([{}, {5: 2.0}, {}], "tfs")
    models = pa.table({"user_id": [1, 2], "intercept": [0.0, 1.0], "codes": pa.array([[], [5]], pa.list_(pa.int64())),
                       "idfs": pa.array([[], [2.0]], pa.list_(pa.float64())), "coefs": pa.array([[], [3.0]], pa.list_(pa.float64()))})
    sigmoid = lambda z: round(1 / (1 + math.exp(-z)), 6)
    assert blocks.probabilities(papers, models).tolist() == [[0.5, sigmoid(1)], [0.5, sigmoid(4)], [0.5, sigmoid(1)]]
    assert blocks.best_by_models(1)(papers, models).to_pylist() == [
        {"user_id": 1, "paper_id": "p0000", "score": 0.5}, {"user_id": 2, "paper_id": "p0001", "score": sigmoid(4)}]


def training_case(spark, users=3, n=60, seed=5):
    docs = texts(40, seed, lo=3)
    docs[7] = "the and"
    rnd = random.Random(seed)
    rows, rating = [], 0
    for u in range(users):
        for i in range(n if u else n * 2):
            doc = rnd.randrange(len(docs))
            liked = ("graph" in docs[doc]) ^ (rnd.random() < 0.2)
            rows.append((u, rating, f"p{doc:03d}", int(liked)))
            rating += 1
    training = spark.createDataFrame(rows, "user_id bigint, rating_id bigint, paper_id string, label int")
    counts = retrieval.term_counts(papers_frame(spark, docs).withColumnRenamed("id", "paper_id"), ["paper_id"], F.col("abstract"))
    return docs, rows, training, counts


def reference_fit(docs, rows, cap):
    """Newton's method on the dense problem."""
    sample = [docs[int(p[1:])] for _, _, p, _ in rows]
    vec = Vectoriser(sample, cap)
    terms = sorted(vec.idf)
    at = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms) + 1))
    x[:, -1] = 1
    for i, d in enumerate(sample):
        for t, v in vec(d).items():
            x[i, at[t]] = v
    y = np.array([r[3] for r in rows], float)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    reg = np.append(np.ones(len(terms)), 0)
    w = np.zeros(len(terms) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (s * (p - y)) + reg * w
        w -= np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(reg), g)
    return vec, terms, w


def test_fit_models(spark):
    docs, rows, training, counts = training_case(spark)
    fitted = prefmodel.fit_models(training, counts, max_features=80).collect()
    for u in range(3):
        _, terms, w = reference_fit(docs, [r for r in rows if r[0] == u], 80)
        got = {r["term"]: r["coef"] for r in fitted if r["user_id"] == u}
        assert sorted(got) == sorted([*terms, ""])
        assert max(abs(got[t] - x) for t, x in zip([*terms, ""], w)) < 1e-6


def test_no_more_than_the_newest_ratings_are_fitted(spark):
    docs, rows, training, counts = training_case(spark, users=1)
    newest = sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])[-35:]
    fitted = prefmodel.fit_models(training, counts, max_features=80, max_train_rows=35).collect()
    assert {r["n"] for r in fitted} == {35}
    _, terms, w = reference_fit(docs, newest, 80)
    assert {r["term"]: pytest.approx(r["coef"], abs=1e-6) for r in fitted} == dict(zip([*terms, ""], w))


def test_a_fit_that_does_not_converge_gives_no_model(spark, monkeypatch):
    monkeypatch.setattr(prefmodel, "STEPS", 1)
    assert prefmodel._solve(np.array([0, 1]), np.array([0, 1]), np.ones(2), np.array([0.0, 1.0]), np.ones(2), 2) is None


def test_the_shared_model_is_the_fit_over_all_users(spark):
    docs, rows, training, counts = training_case(spark)
    fitted = sharedmodel.fit_shared(training, counts, max_features=80).collect()
    _, terms, w = reference_fit(docs, rows, 80)
    assert {r["n"] for r in fitted} == {len(rows)}
    assert {r["term"]: pytest.approx(r["coef"], abs=2e-4) for r in fitted} == dict(zip([*terms, ""], w))
    assert sharedmodel.fit_shared(training.where("label = 1"), counts).count() == 0


def test_gates(spark):
    _, rows, training, counts = training_case(spark)
    one_class = training.where("user_id = 1").withColumn("label", F.lit(1))
    few = training.where("user_id = 2").limit(29)
    mixed = training.where("user_id = 0").unionByName(one_class).unionByName(few)
    users = {r["user_id"] for r in prefmodel.fit_models(mixed, counts).select("user_id").collect()}
    assert users == {0}


def test_predictions(spark):
    docs, rows, training, counts = training_case(spark)
    models, meta = prefmodel.split_fitted(prefmodel.fit_models(training, counts, max_features=80))
    fresh = texts(25, seed=99) + ["unseen words only", ""]
    index = retrieval.build_index(papers_frame(spark, fresh))
    want = {}
    for u in range(3):
        vec, terms, w = reference_fit(docs, [r for r in rows if r[0] == u], 80)
        coef = dict(zip(terms, w))
        for i, d in enumerate(fresh):
            z = w[-1] + sum(x * coef[t] for t, x in vec(d).items())
            want[u, f"p{i:03d}"] = 1 / (1 + math.exp(-z))
    for block_terms, slice_papers in ((10**6, 2048), (100, 10)):
        got = {(r["user_id"], r["paper_id"]): r["score"] for r in retrieval.predict(index.counts, models, meta, block_terms, slice_papers).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5
    for block_terms, slice_papers in ((10**6, 2048), (100, 10)):
        top = retrieval.top_n_for_models(index, models, meta, 7, block_terms, slice_papers).collect()
        for u in range(3):
            ranked = sorted((-round(p, 6), i) for (v, i), p in want.items() if v == u)[:7]
            assert [(-s, i) for _, i, s in sorted((r["rank"], r["paper_id"], r["score"]) for r in top if r["user_id"] == u)] == [
                (pytest.approx(s), i) for s, i in ranked]
    pairs = spark.createDataFrame([(0, "p001"), (2, "p026")], "user_id bigint, paper_id string")
    prefs = prefmodel.pref_scores(pairs, index.counts, models, meta).collect()
    assert {(r["user_id"], r["paper_id"]): float(r["pref_score"]) for r in prefs} == {
        k: pytest.approx(want[k] * 10, abs=0.0051) for k in ((0, "p001"), (2, "p026"))}


def test_routing(spark):
    docs, rows, training, counts = training_case(spark)
    models, meta = prefmodel.split_fitted(prefmodel.fit_models(training, counts, max_features=80))
    index = retrieval.build_index(papers_frame(spark, docs))
    people = spark.createDataFrame([(0, "graph"), (9, "graph")], "user_id bigint, keyword_profile string")
    got = retrieval.candidates(index, people, models, meta, 10)
    assert sorted((r["user_id"], r["has_model"]) for r in got.select("user_id", "has_model").distinct().collect()) == [(0, True), (9, False)]
    assert got.count() == 20


def dealt_folds(labels, k):
    """Class-sorted labels dealt to the folds in turn; each class fills its blocks in order."""
    order = list(dict.fromkeys(labels))
    ranked = sorted(order.index(x) for x in labels)
    sizes = {c: [ranked[i::k].count(j) for i in range(k)] for j, c in enumerate(order)}
    blocks = {c: [f + 1 for f in range(k) for _ in range(sizes[c][f])] for c in order}
    return [blocks[x].pop(0) for x in labels]


@pytest.mark.parametrize("chunk_rows", [10**6, 9])
def test_assign_folds(spark, chunk_rows):
    _, rows, training, _ = training_case(spark, n=43)
    got = {r["rating_id"]: r["fold"] for r in prefmodel.assign_folds(training, 5, chunk_rows).collect()}
    for u in range(3):
        own = [r for r in rows if r[0] == u]
        assert [got[r[1]] for r in own] == dealt_folds([r[3] for r in own], 5)


def pair_auc(pred):
    pos, neg = [s for s, y in pred if y], [s for s, y in pred if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)


def test_auc_counts_pairs(spark):
    rnd = random.Random(1)
    rows = [(i % 3, 1 + i % 2, rnd.randrange(20) / 19, int(rnd.random() < 0.4)) for i in range(400)] + [(9, 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "user_id bigint, fold int, score double, label int")
    got = {(r["user_id"], r["fold"]): r["auc"] for r in prefmodel.roc_auc(df).collect()}
    for key in got:
        want = pair_auc([(s, y) for u, f, s, y in rows if (u, f) == key])
        assert got[key] == (None if want is None else pytest.approx(want))


def test_cross_validation(spark):
    docs, rows, training, counts = training_case(spark, users=2)
    got = {r["user_id"]: r for r in prefmodel.cross_validate(training, counts, 5, max_features=80).collect()}
    for u in range(2):
        own = [r for r in rows if r[0] == u]
        folds = dealt_folds([r[3] for r in own], 5)
        aucs = []
        for k in range(1, 6):
            vec, terms, w = reference_fit(docs, [r for r, f in zip(own, folds) if f != k], 80)
            coef = dict(zip(terms, w))
            held = [r for r, f in zip(own, folds) if f == k]
            aucs.append(pair_auc([(round(sum(x * coef[t] for t, x in vec(docs[int(p[1:])]).items()), 7), y) for _, _, p, y in held]))
        assert got[u]["cv_auc_mean"] == pytest.approx(np.mean(aucs), abs=2e-3)
        assert got[u]["cv_auc_std"] == pytest.approx(np.std(aucs), abs=2e-3)


def test_all_ratings_beyond_the_bound_are_cross_validated(spark):
    """User 0 has 120 ratings; with a bound of 70 each fold is fitted on the newest 70 of the others."""
    docs, rows, training, counts = training_case(spark, users=2)
    got = prefmodel.fold_scores(training, counts, 5, max_features=80, max_train_rows=70).collect()
    assert sorted((r["user_id"], r["rating_id"]) for r in got) == sorted((r[0], r[1]) for r in rows)
    own = [r for r in rows if r[0] == 0]
    folds = dealt_folds([r[3] for r in own], 5)
    of = {r["rating_id"]: r for r in got if r["user_id"] == 0}
    for k in range(1, 6):
        vec, terms, w = reference_fit(docs, [r for r, f in zip(own, folds) if f != k][-70:], 80)
        coef = dict(zip(terms, w))
        for _, rating, paper, label in (r for r, f in zip(own, folds) if f == k):
            z = sum(x * coef[t] for t, x in vec(docs[int(paper[1:])]).items()) + w[-1]
            assert (of[rating]["fold"], of[rating]["label"]) == (k, label)
            assert of[rating]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@pytest.mark.parametrize("bound", [1000, 70])
def test_one_pass_gives_models_and_scores(spark, bound):
    """Also of user 0, whose 120 ratings are beyond the bound of 70; fits start from each other and end at the same optimum."""
    docs, rows, training, counts = training_case(spark, users=2)
    trained = prefmodel.train(training, counts, 5, max_features=80, max_train_rows=bound, fold_models=True)
    trained = spark.createDataFrame(trained.collect(), trained.schema)
    alone = prefmodel.fit_models(training, counts, max_features=80, max_train_rows=bound).collect()
    got = {(r["user_id"], r["term"]): r for r in prefmodel.fitted_models(trained).collect()}
    assert got.keys() == {(r["user_id"], r["term"]) for r in alone}
    for r in alone:
        assert (got[r["user_id"], r["term"]]["coef"], got[r["user_id"], r["term"]]["n"]) == (pytest.approx(r["coef"], abs=1e-7), r["n"])
    own = [r for r in rows if r[0] == 0]
    folds = dealt_folds([r[3] for r in own], 5)
    for k in range(1, 6):
        _, terms, w = reference_fit(docs, [r for r, f in zip(own, folds) if f != k][-bound:], 80)
        model = {r["term"]: r["coef"] for r in trained.where(f"user_id = 0 and fold = {k} and term is not null").collect()}
        assert model == {t: pytest.approx(x, abs=1e-6) for t, x in zip([*terms, ""], w)}
    assert sorted(r["rating_id"] for r in prefmodel.held_out(trained).collect()) == sorted(r[1] for r in rows)
