"""Per-user preference models: training data, folds, fits, evaluation.

Spark joins ratings to packed term counts, gates, folds, groups and evaluates; a task then
fits one user's small model on Arrow data. Users with many ratings are fitted by ``operators.largefit``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.functions.scores import SCORE, like_label, pref_score
from dailyfolio.functions.text import ENGLISH_STOP_WORDS, doc_text
from dailyfolio.operators.grams import counted, paper_words
from dailyfolio.operators.largefit import FITTED, FOLD_SCORES, TRAINED, fit_large, newton, schema_of, solved, trained_rows
from dailyfolio.operators.papers import ratings_with_text, with_user_id
from dailyfolio.operators.ranking import CHUNK_ROWS, keep_ranked, numbered
from dailyfolio.operators.retrieval import BIAS, MAX_FEATURES, predict_pairs, term_counts
from dailyfolio.session import spread, written

MIN_RATINGS = 30
FOLDS = 5
# Ratings of one user whose texts one task takes. Users with more are fitted from packed entries, on all ratings too.
TASK_RATINGS = 500
# Newton steps and the gradient at which a fit has converged.
STEPS, GRADIENT = 100, 1e-9


def training_set(ratings: DataFrame, papers: DataFrame, users: DataFrame) -> DataFrame:
    """All ratings as (user_id, rating_id, paper_id, text, label); no date filter."""
    return with_user_id(ratings_with_text(ratings, papers), users).select(
        "user_id", F.col("id").alias("rating_id"), "paper_id",
        doc_text(F.col("title"), F.col("abstract")).alias("text"),
        like_label(F.col("score")).alias("label"))


def rated_counts(ratings: DataFrame, papers: DataFrame,
                 stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Packed term counts, once per rated paper however often it was rated.

    Partitioned by paper: the exchange also keeps a later join from counting the terms
    again for every rating of a paper.
    """
    rated = papers.join(ratings.select(F.col("paper_id").alias("id")), "id", "left_semi")
    counts = term_counts(rated.withColumnRenamed("id", "paper_id"), ["paper_id"],
                         doc_text(F.col("title"), F.col("abstract")), stop_words)
    return spread(counts, "paper_id")


def rated_words(ratings: DataFrame, papers: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Uncounted words, once per rated paper; see ``operators.grams``."""
    return paper_words(papers.join(ratings.select(F.col("paper_id").alias("id")), "id", "left_semi"), stop_words)


def class_counts(training: DataFrame) -> DataFrame:
    """Per user: ratings, classes present, rows of each class."""
    counted = training.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("n_liked"),
        F.count_if(F.col("label") == 0).alias("n_disliked"))
    return counted.withColumn(
        "classes", (F.col("n_liked") > 0).cast("int") + (F.col("n_disliked") > 0).cast("int"))


def trainable_users(training: DataFrame, min_ratings: int = MIN_RATINGS) -> DataFrame:
    return class_counts(training).where((F.col("n") >= min_ratings) & (F.col("classes") == 2))


def balanced_weights(training: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Each row with ``weight = n / (2 * rows of its class)`` within its key."""
    sizes = training.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("label") == 1).alias("_1"), F.count_if(F.col("label") == 0).alias("_0"))
    own = F.when(F.col("label") == 1, F.col("_1")).otherwise(F.col("_0"))
    return (
        training.join(sizes, list(keys))
        .withColumn("weight", F.col("_n") / (2 * own)).drop("_n", "_1", "_0")
    )


def assign_folds(training: DataFrame, k: int = FOLDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Stratified folds 1..k in contiguous blocks per (user, label), by rating id.

    Block sizes follow from dealing the class-sorted labels to the folds in turn, the class
    that was rated first leading.
    """
    sizes = training.groupBy("user_id").agg(
        F.min_by("label", "rating_id").alias("_lead"),
        F.count_if(F.col("label") == 1).alias("_1"), F.count_if(F.col("label") == 0).alias("_0"))
    placed = numbered(training, ["user_id", "label"], "rating_id", "_pos", chunk_rows)
    of = {1: F.col("_1"), 0: F.col("_0")}
    own = F.when(F.col("label") == 1, of[1]).otherwise(of[0])
    other = F.when(F.col("label") == 1, of[0]).otherwise(of[1])
    start = F.when(F.col("label") == F.col("_lead"), F.lit(0)).otherwise(other)

    def dealt(upto: Column, fold: int) -> Column:
        return F.floor((upto - fold + (k - 1)) / k)

    fold, size = F.lit(1), F.lit(0)
    for i in range(k - 1):
        size = size + dealt(start + own, i) - dealt(start, i)
        fold = fold + (F.col("_pos") > size).cast("int")
    return placed.join(sizes, "user_id").withColumn("fold", fold).drop("_lead", "_1", "_0", "_pos")


def _solve(rows, cols, vals, y, weight, p, start=None):
    """Minimise weighted logistic loss + |w|^2/2 by Newton steps with conjugate gradients.

    The matrix is given by its entries; the last coefficient is the unpenalised intercept.
    ``start`` saves steps where a similar fit is known; the optimum is the same.
    Returns None if the gradient does not vanish in ``STEPS`` steps.
    """
    n = len(y)

    def times(v):
        return np.bincount(rows, vals * v[cols], minlength=n) + v[p]

    def transposed(r):
        return np.append(np.bincount(cols, vals * r[rows], minlength=p), r.sum())

    curve = None

    def answer(kind, w, direction):
        nonlocal curve
        if kind == "bend":
            return transposed(curve * times(direction))
        z = times(w)
        if kind == "loss":
            return weight @ (np.logaddexp(0, z) - y * z)
        prob = 1 / (1 + np.exp(-z))
        curve = weight * prob * (1 - prob)
        return transposed(weight * (prob - y))

    return solved(newton(p + 1, start, STEPS, GRADIENT), answer)


class _UserTexts:
    """One user's rated papers as term occurrences: row, term code, count.

    Counts are taken once, per fold; a fit without a fold uses the totals less those of the fold.
    """

    def __init__(self, docs: pa.Table):
        docs = docs.sort_by("rating_id").combine_chunks()
        self.ids, self.papers = docs["rating_id"], docs["paper_id"]
        self.label = docs["label"].to_numpy().astype(float)
        self.fold = docs["fold"].to_numpy()
        lengths = pc.fill_null(pc.list_value_length(docs["terms"]), 0).to_numpy()
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        encoded = pc.list_flatten(docs["terms"]).combine_chunks().dictionary_encode()
        # Codes in term order, so that equal counts rank alphabetically.
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        self.terms = encoded.dictionary.take(pa.array(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.code = place[encoded.indices.to_numpy()]
        tf = pc.list_flatten(docs["tfs"]).to_numpy().astype(float)
        self.level = 1 + np.log(tf)
        self.counts = {f: self._counted(self.fold[self.row] == f, tf) for f in np.unique(self.fold)}
        self.total = sum(self.counts.values(), np.zeros((2, len(self.terms))))

    def _counted(self, use: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Occurrences and rows of each term."""
        size = len(self.terms)
        return np.array([np.bincount(self.code[use], tf[use], size), np.bincount(self.code[use], minlength=size)])

    def vocabulary(self, out: int | None, max_features: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the most frequent terms outside fold ``out``, and their idf."""
        ctf, df = self.total if out is None else self.total - self.counts[out]
        kept = np.sort(np.argsort(-ctf, kind="stable")[:max_features])
        kept = kept[ctf[kept] > 0]
        n = len(self.fold) - (0 if out is None else np.count_nonzero(self.fold == out))
        return kept, np.log((1 + n) / (1 + df[kept])) + 1

    def features(self, use: np.ndarray, kept: np.ndarray, idf_of: np.ndarray):
        """Entries (row, column, value) of the normalised TF-IDF matrix of the rows in use."""
        column = np.full(len(self.terms), -1)
        column[kept] = np.arange(len(kept))
        inside = use[self.row] & (column[self.code] >= 0)
        rows = (np.cumsum(use) - 1)[self.row[inside]]
        cols = column[self.code[inside]]
        vals = self.level[inside] * idf_of[cols]
        norm = np.sqrt(np.bincount(rows, vals * vals, minlength=use.sum()))
        return rows, cols, vals / norm[rows]

    def fit(self, out: int | None, max_features: int, near=None):
        """Vocabulary codes, idf and weights fitted on the rows outside fold ``out``; None with one class or without convergence.

        ``near`` is another fit of the user, from which this one starts.
        """
        use = np.ones(len(self.fold), bool) if out is None else self.fold != out
        y = self.label[use]
        liked = y.sum()
        if liked == 0 or liked == len(y):
            return None
        kept, idf_of = self.vocabulary(out, max_features)
        weight = len(y) / (2 * np.where(y == 1, liked, len(y) - liked))
        start = None
        if near is not None:
            known = np.zeros(len(self.terms))
            known[near[0]] = near[2][:-1]
            start = np.append(known[kept], near[2][-1])
        w = _solve(*self.features(use, kept, idf_of), y, weight, len(kept), start)
        return None if w is None else (kept, idf_of, w)


def _model_rows(user: int, fold: int, texts: _UserTexts, fitted, n: int) -> pa.Table:
    kept, idf_of, w = fitted
    return trained_rows(len(w), user_id=user, fold=fold, term=[*texts.terms.take(pa.array(kept)).to_pylist(), BIAS],
                 idf=np.append(idf_of, 0.0), coef=w, n=n)


def _whole_model(max_features: int):
    """The model of all given ratings of a user."""
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        return _fitted_rows(key[0].as_py(), 0, docs, max_features)

    return run


def _fitted_rows(user: int, fold: int, docs: pa.Table, max_features: int) -> pa.Table:
    texts = _UserTexts(docs)
    fitted = texts.fit(None, max_features)
    return schema_of(TRAINED).empty_table() if fitted is None else _model_rows(user, fold, texts, fitted, len(texts.label))


def _models_without(max_features: int):
    """A user's models, each of the ratings whose ``outs`` hold its fold, one after the other."""
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(docs["outs"]).to_numpy()
        row, out = np.repeat(np.arange(len(docs)), sizes), pc.list_flatten(docs["outs"]).to_numpy()
        docs = docs.drop_columns(["outs"])
        return pa.concat_tables([_fitted_rows(key[0].as_py(), int(f), docs.take(pa.array(row[out == f])), max_features) for f in np.unique(out)])

    return run


def _model_and_folds(max_features: int, fold_models: bool):
    """The model of a user, those without each fold if asked for, and the scores of the held-out ratings."""
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        user, texts = key[0].as_py(), _UserTexts(docs)
        whole = texts.fit(None, max_features)
        parts = [schema_of(TRAINED).empty_table() if whole is None else _model_rows(user, 0, texts, whole, len(texts.label))]
        for fold in np.unique(texts.fold):
            held = texts.fold == fold
            fitted = texts.fit(fold, max_features, whole)
            if fitted is None:
                continue
            kept, idf_of, w = fitted
            rows, cols, vals = texts.features(held, kept, idf_of)
            z = np.bincount(rows, vals * w[cols], minlength=held.sum()) + w[-1]
            pick = pa.array(held)
            parts.append(trained_rows(int(held.sum()), user_id=user, fold=int(fold), rating_id=texts.ids.filter(pick),
                                      paper_id=texts.papers.filter(pick), label=texts.label[held].astype(np.int32),
                                      score=1 / (1 + np.exp(-z))))
            if fold_models:
                parts.append(_model_rows(user, int(fold), texts, fitted, int((~held).sum())))
        return pa.concat_tables(parts)

    return run


def _trainable(training: DataFrame, min_ratings: int) -> DataFrame:
    keep = [c for c in ("user_id", "rating_id", "paper_id", "label", "fold") if c in training.columns]
    return training.select(*keep).join(
        trainable_users(training, min_ratings).select("user_id"), "user_id", "left_semi")


def _newest(rows: DataFrame, n: int, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """The ``n`` newest ratings of each user (or other key)."""
    return keep_ranked(rows, list(keys), [F.col("rating_id").desc()], n)


def _with_terms(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with their packed terms; a paper without any gets empty lists."""
    return counted(rows.join(counts, "paper_id", "left")).withColumns({
        "terms": F.coalesce("terms", F.array().cast("array<string>")),
        "tfs": F.coalesce("tfs", F.array().cast("array<int>"))})


def fit_models(training: DataFrame, counts: DataFrame, max_features: int = MAX_FEATURES,
               min_ratings: int = MIN_RATINGS, max_train_rows: int | None = None, task_ratings: int = TASK_RATINGS) -> DataFrame:
    """L2 logistic regressions (C=1, balanced classes) on each user's own TF-IDF features.

    Returns rows (user_id, term, idf, coef, n); the intercept is the row of the bias term.
    Users below the rating gate or with one class get no row, nor does a fit that did not
    converge, so that a stored model stays. All ratings are fitted, unless a caller asks for the newest ``max_train_rows`` of
    each user. The packed texts of at most ``task_ratings`` meet in one task; see ``operators.largefit`` for users with more.
    """
    rows = _trainable(training, min_ratings).withColumn("fold", F.lit(1))
    if max_train_rows is not None:
        rows = _newest(rows, max_train_rows)
    rows = written(rows, "fitted-ratings")
    large = _over(rows, task_ratings)
    texts = spread(_with_terms(rows.join(large, "user_id", "left_anti"), counts), "user_id")
    small = texts.groupBy("user_id").applyInArrow(_whole_model(max_features), TRAINED)
    if large.isEmpty():
        return fitted_models(small)
    return fitted_models(small.unionByName(fit_large(
        rows.join(large, "user_id", "left_semi"), counts, [0], max_features, False, STEPS, GRADIENT)))


def _over(rows: DataFrame, n: int) -> DataFrame:
    """Users with more than ``n`` rows."""
    return rows.groupBy("user_id").count().where(F.col("count") > n).select("user_id")


def train(training: DataFrame, counts: DataFrame, k: int = FOLDS, max_features: int = MAX_FEATURES, min_ratings: int = MIN_RATINGS,
          max_train_rows: int | None = None, fold_models: bool = False, task_ratings: int = TASK_RATINGS) -> DataFrame:
    """The models of ``fit_models`` and every rating scored by the model fitted without its fold (vocabulary included).

    One pass over a user's terms gives both: they are counted by fold, and a fold's vocabulary comes from the totals less its
    own. ``fitted_models`` and ``held_out`` take the result apart; ``fold_models`` adds the models of the folds to it.

    Folds cover all ratings, and each model is fitted on all ratings of the others; see ``operators.largefit`` for users with more than
    ``task_ratings``. Where a caller asks for ``max_train_rows``, a user with more has each model fitted on that many of the newest
    ratings of the others, and all ratings of the fold are scored in blocks.
    """
    rows = written(assign_folds(_trainable(training, min_ratings), k), "folds")
    large = _over(rows, task_ratings if max_train_rows is None else max_train_rows)
    whole = spread(_with_terms(rows.join(large, "user_id", "left_anti"), counts), "user_id").groupBy("user_id").applyInArrow(
        _model_and_folds(max_features, fold_models), TRAINED)
    if large.isEmpty():
        return whole
    hot = rows.join(large, "user_id", "left_semi")
    if max_train_rows is None:
        return whole.unionByName(fit_large(hot, counts, range(k + 1), max_features, fold_models, STEPS, GRADIENT))
    others = hot.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(k)))).where("fold <> _out")
    others = _newest(others.drop("fold").withColumnRenamed("_out", "fold"), max_train_rows, ["user_id", "fold"])
    # A rating is in most of a user's models: its terms travel once, with the list of them.
    met = others.groupBy("user_id", "rating_id", "paper_id", "label").agg(F.collect_list("fold").alias("outs"))
    fitted = written(spread(_with_terms(met, counts).withColumn("fold", F.lit(0)), "user_id").groupBy("user_id").applyInArrow(
        _models_without(max_features), TRAINED), "hot-fitted")
    terms = fitted.select("user_id", "fold", "term", "idf", "coef")
    scored = predict_pairs(
        hot, counts, terms.where(F.col("term") != BIAS),
        terms.where(F.col("term") == BIAS).withColumnRenamed("coef", "intercept"), ["user_id", "fold"], digits=None)
    kept = fitted if fold_models else fitted.where("fold = 0")
    return whole.unionByName(kept).unionByName(scored.select(*schema_of(FOLD_SCORES).names), allowMissingColumns=True)


def fitted_models(trained: DataFrame) -> DataFrame:
    """The models of all ratings, as ``fit_models`` gives them."""
    return trained.where("fold = 0 and term is not null").select(*schema_of(FITTED).names)


def held_out(trained: DataFrame) -> DataFrame:
    """The ratings scored by the model fitted without their fold."""
    return trained.where("rating_id is not null").select(*schema_of(FOLD_SCORES).names)


def fold_scores(training: DataFrame, counts: DataFrame, k: int = FOLDS, **fit) -> DataFrame:
    """Every rating of the trainable users scored by the model fitted without its fold; see ``train``."""
    return held_out(train(training, counts, k, **fit))


def split_fitted(fitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables ``models`` and ``model_meta`` (without scores) from fitted rows."""
    models = fitted.where(F.col("term") != BIAS).select("user_id", "term", "idf", "coef")
    meta = fitted.where(F.col("term") == BIAS).select("user_id", F.col("coef").alias("intercept"), "n")
    return models, meta


def _tie_groups(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per distinct score with their average rank within the key.

    Scores are in [0, 1]; ranks build up from 1,000 score ranges, so even a key with most of
    the rows is spread over many tasks.
    """
    groups = pred.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("label").cast("bigint")).alias("_pos"),
    ).withColumn("_range", F.floor(F.col("score") * 1000))
    upto = Window.unboundedPreceding
    over_ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(upto, -1)
    offsets = groups.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m")).withColumn(
        "_before", F.coalesce(F.sum("_m").over(over_ranges), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(upto, -1)
    return (
        groups.withColumn("_near", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn("average_rank",
                    F.col("_before") + F.col("_near") + (F.col("_n") + 1) / 2.0)
        .drop("_before", "_near", "_range")
    )


def average_rank(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its ascending rank by score within the key; ties share the mean."""
    ranks = _tie_groups(pred, keys).select(*keys, "score", "average_rank")
    return pred.join(ranks, [*keys, "score"])


def roc_auc(pred: DataFrame, keys: Sequence[str] = ("user_id", "fold")) -> DataFrame:
    """Area under the ROC curve per key, from rows (score, label); null with one class."""
    sums = _tie_groups(pred, list(keys)).groupBy(*keys).agg(
        F.sum("_pos").alias("_p"), (F.sum("_n") - F.sum("_pos")).alias("_q"),
        F.sum(F.col("_pos") * F.col("average_rank")).alias("_r"))
    p, q = F.col("_p"), F.col("_q")
    auc = F.when((p > 0) & (q > 0), (F.col("_r") - p * (p + 1) / 2) / (p * q))
    return sums.select(*keys, auc.alias("auc"))


def cv_summary(fold_aucs: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold AUCs per user."""
    return fold_aucs.groupBy("user_id").agg(
        F.avg("auc").alias("cv_auc_mean"), F.stddev_pop("auc").alias("cv_auc_std"))


def cross_validate(training: DataFrame, counts: DataFrame, k: int = FOLDS, **fit) -> DataFrame:
    """Mean and deviation of the AUC over k held-out folds; a report, not a gate."""
    scores = written(fold_scores(training, counts, k, **fit), "fold-scores")
    return cv_summary(roc_auc(scores))


def pref_scores(passed: DataFrame, counts: DataFrame, models: DataFrame,
                meta: DataFrame) -> DataFrame:
    """Preference scores 0-10 of passed (user_id, paper_id) rows whose user has a model."""
    return predict_pairs(passed.select("user_id", "paper_id"), counts, models, meta,
                         digits=None).select(
        "user_id", "paper_id", pref_score(F.col("score")).alias("pref_score"))


def attach_pref(scored: DataFrame, prefs: DataFrame | None) -> DataFrame:
    """Scored rows with their preference score, null for users without a model."""
    if prefs is None:
        return scored.withColumn("pref_score", F.lit(None).cast(SCORE))
    return scored.join(prefs, ["user_id", "paper_id"], "left")
