"""TF-IDF index over a paper batch and top-n retrieval for every user at once.

Layout: one packed row of term counts per paper, hash-partitioned by paper, in which weights and
norms are made. Rankings meet slices of these rows with blocks of users (``operators.blocks``); what is
shuffled afterwards are term totals and the top n of each meeting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from dailyfolio.functions.scores import sigmoid
from dailyfolio.functions.text import (
    ENGLISH_STOP_WORDS, doc_text, remove_stop_words, tokens)
from dailyfolio.operators.blocks import (
    BLOCK_TERMS, DIGITS, SLICE_PAPERS, best_by_models, best_by_profiles, codes, meet)
from dailyfolio.operators.pairs import pair_sums
from dailyfolio.operators.ranking import keep_ranked
from dailyfolio.operators.totals import top_terms
from dailyfolio.session import spread, written

MAX_FEATURES = 5000
TOP_N = 30
# Words that are counted at once, and documents at most.
COUNTED_WORDS = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words ``_w`` of each document as its sorted distinct 1- and 2-grams and their counts.

    Words never hold a space or anything before it, so grams sort like pairs of words, a word alone first.
    """
    for batch in batches:
        words = batch.column("_w")
        ends = np.cumsum(np.asarray(words.value_lengths().fill_null(0)), dtype=np.int64)
        at = 0
        while at < len(batch):
            upto = max(at + 1, min(at + COUNTED_WORDS, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED_WORDS, "right"))))
            part = batch.slice(at, upto - at)
            sizes, found = np.diff(ends[at:upto], prepend=ends[at - 1] if at else 0), part.column("_w").flatten()
            encoded = found.dictionary_encode()
            order = pc.sort_indices(encoded.dictionary)
            known = encoded.dictionary.take(order)
            place = np.empty(len(known), np.int64)
            place[np.asarray(order)] = np.arange(1, len(known) + 1)
            code, base = place[np.asarray(encoded.indices)], len(known) + 1
            row = np.repeat(np.arange(len(part)), sizes)
            one = (row * base + code) * base
            gram, tfs = np.unique(np.concatenate([one, (one[:-1] + code[1:])[row[:-1] == row[1:]]]), return_counts=True)
            row, first, second = gram // (base * base), gram // base % base, gram % base
            rest = pa.concat_arrays([pa.array([""], pa.string()), pc.binary_join_element_wise("", known, " ")])
            terms = pc.binary_join_element_wise(known.take(pa.array(first - 1)), rest.take(pa.array(second)), "")
            offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
            kept = [n for n in part.schema.names if n != "_w"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in kept), pa.ListArray.from_arrays(offsets, terms),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32)))], names=[*kept, "terms", "tfs"])
            at = upto


def term_counts(docs: DataFrame, keys: Sequence[str], text: Column,
                stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Per document the sorted distinct 1- and 2-grams with their counts, as arrays.

    Words are found by Spark and counted on Arrow data, many documents at once: no shuffle.
    """
    return counted_words(docs.select(*keys, remove_stop_words(tokens(text), stop_words).alias("_w")))


def counted_words(words: DataFrame) -> DataFrame:
    """Rows with the counts of ``_w``, the last column, as columns ``terms`` and ``tfs`` in its place."""
    schema = StructType([*words.schema.fields[:-1], StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))])
    return words.mapInArrow(_counted, schema)


def exploded(packed: DataFrame, keys: Sequence[str], values: str = "tfs",
             name: str = "tf") -> DataFrame:
    """One row per (document, term) from the packed arrays."""
    return packed.select(
        *keys, F.explode(F.arrays_zip(F.col("terms"), F.col(values))).alias("_t")
    ).select(*keys, F.col("_t.terms").alias("term"), F.col(f"_t.{values}").alias(name))


def document_frequency(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Documents per term, from one row per (document, term)."""
    return counts.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_term_frequency(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Occurrences per term."""
    return counts.groupBy(*keys, "term").agg(F.sum("tf").alias("ctf"))


def term_totals(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both of the above from one aggregation."""
    return counts.groupBy(*keys, "term").agg(
        F.sum("tf").alias("ctf"), F.count(F.lit(1)).alias("df"))


def cap_vocab(terms: DataFrame, max_features: int = MAX_FEATURES,
              keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent terms; ties go to the alphabetically first."""
    order = [F.col("ctf").desc(), F.col("term").asc()]
    if not keys:
        return terms.orderBy(*order).limit(max_features)
    return keep_ranked(terms, keys, order, max_features)


def idf(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def sublinear(tf: Column) -> Column:
    return 1 + F.log(tf)


def fit_vocab(counts: DataFrame, docs: DataFrame, max_features: int = MAX_FEATURES,
              keys: Sequence[str] = ()) -> DataFrame:
    """Vocabulary with df and idf, for the whole batch or one per key.

    ``counts`` holds a row per (key, document, term), ``docs`` a row per (key, document).
    """
    terms = cap_vocab(term_totals(counts, keys), max_features, keys)
    if keys:
        sizes = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
        terms = terms.join(sizes, list(keys))
    else:
        total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
        terms = terms.withColumn("n_docs", total.scalar())
    return terms.withColumn("idf", idf(F.col("n_docs"), F.col("df")))


def fit_user_vocab(rows: DataFrame, counts: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``fit_vocab`` with one vocabulary per user over rated papers, from rows (user_id, paper_id) and packed counts.

    No row per (user, paper, term) is shuffled; see ``operators.totals``.
    """
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_docs"))
    terms = top_terms(rows, counts, max_features).drop("lean").join(sizes, "user_id")
    return terms.withColumn("idf", idf(F.col("n_docs"), F.col("df")))


def l2_norm(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    return weights.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def tfidf(packed: DataFrame, vocab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed L2-normalised vectors (terms, weights); terms outside the vocabulary drop out.

    The vocabulary is bounded by its feature cap and therefore broadcast. When ``packed`` is
    partitioned by ``keys``, the regrouping per document needs no shuffle.
    """
    weight = (sublinear(F.col("tf")) * F.col("idf")).alias("weight")
    raw = (
        exploded(packed, keys).join(F.broadcast(vocab.select("term", "idf")), "term")
        .select(*keys, "term", weight)
    )
    grouped = raw.groupBy(*keys).agg(
        F.collect_list(F.struct("term", "weight")).alias("_v"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return grouped.select(
        *keys, F.col("_v.term").alias("terms"),
        F.transform("_v.weight", lambda w: w / F.col("_norm")).alias("weights"))


def _within(known: Sequence[str]):
    """Packed counts (paper_id, terms, tfs) with the known terms only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known, pa.string())
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            held = pc.is_in(terms.flatten(), value_set=wanted)
            row = np.repeat(np.arange(len(batch)), np.asarray(terms.value_lengths().fill_null(0)))[held.to_numpy(zero_copy_only=False)]
            first = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id"), *(pa.ListArray.from_arrays(first, x.flatten().filter(held)) for x in (terms, tfs))],
                names=["paper_id", "terms", "tfs"])

    return run


@dataclass(frozen=True)
class PaperIndex:
    """``papers(paper_id)``, ``counts(paper_id, terms, tfs)``, ``vocab(term, df, idf)`` and
    ``vectors(paper_id, terms, weights)``."""

    papers: DataFrame
    counts: DataFrame
    vocab: DataFrame
    vectors: DataFrame
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS
    max_features: int = MAX_FEATURES
    unspread: DataFrame | None = None  # the counts before their shuffle

    def postings(self) -> DataFrame:
        return exploded(self.vectors, ["paper_id"], "weights", "weight")

    def materialize(self) -> PaperIndex:
        """The index written to the scratch folder, for use by several jobs: one packed row a paper.

        Counts are written where they are made, and only those inside the vocabulary are shuffled.
        """
        counts = written(self.counts if self.unspread is None else self.unspread, "index-counts")
        vocab = written(fit_vocab(exploded(counts, ["paper_id"]), counts, self.max_features),
                        "index-vocab")
        known = [r["term"] for r in vocab.select("term").collect()]  # max_features rows
        inside = counts.mapInArrow(_within(known), counts.schema)
        vectors = written(tfidf(spread(inside, "paper_id"), vocab, ["paper_id"]), "index-vectors")
        return PaperIndex(counts.select("paper_id"), counts, vocab, vectors, self.stop_words, self.max_features)


def build_index(papers: DataFrame, max_features: int = MAX_FEATURES,
                stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> PaperIndex:
    """One index over the whole batch, shared by all users.

    Texts are reduced to packed counts before the only document shuffle; both readers of
    the counts (vocabulary and vectors) reuse that exchange.
    """
    text = doc_text(F.col("title"), F.col("abstract"))
    named = papers.withColumnRenamed("id", "paper_id")
    unspread = term_counts(named, ["paper_id"], text, stop_words)
    counts = spread(unspread, "paper_id")
    vocab = fit_vocab(exploded(counts, ["paper_id"]), papers, max_features)
    return PaperIndex(papers.select(F.col("id").alias("paper_id")), counts, vocab,
                      tfidf(counts, vocab, ["paper_id"]), stop_words, max_features, unspread)


def sparse_dot(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Sum over shared terms of weight products, per (user, paper) that share a term.

    Rows for every such pair: for small sets and checks. Rankings use ``top_n_for_profiles``.
    """
    return (
        postings.join(queries, "term").groupBy("paper_id", "user_id")
        .agg(F.sum(F.col("weight") * F.col("query_weight")).alias("dot"))
    )


def packed_profiles(index: PaperIndex, users: DataFrame) -> DataFrame:
    """Profiles in the index's vocabulary, one packed row (terms, weights) per user."""
    packed = term_counts(users, ["user_id"], F.col("keyword_profile"), index.stop_words)
    return tfidf(packed, index.vocab, ["user_id"])


def profile_vectors(index: PaperIndex, users: DataFrame) -> DataFrame:
    """Profiles in the index's vocabulary, one row per (user, term)."""
    return exploded(packed_profiles(index, users), ["user_id"], "weights", "query_weight")


def fill_to_n(hits: DataFrame, users: DataFrame, papers: DataFrame, n: int) -> DataFrame:
    """Complete each user's ranked hits to ``n`` papers with unmatched ones in id order.

    ``hits`` has at most ``n`` ranked rows per user. The papers missing from fewer than
    ``n`` hits are among the first ``2n`` ids, so one short array serves every user.
    """
    first = papers.select("paper_id").orderBy("paper_id").limit(2 * n)
    first_ids = first.agg(F.sort_array(F.collect_list("paper_id")).alias("ids")).scalar()
    found = hits.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "paper_id", "score"))).alias("_hits"))
    listed = users.select("user_id").join(found, "user_id", "left").select(
        "user_id",
        F.coalesce(F.transform("_hits", lambda h: F.struct(
            h["paper_id"].alias("paper_id"), h["score"].alias("score"))),
            F.array().cast("array<struct<paper_id:string,score:double>>")).alias("_hits"))
    missing = F.greatest(F.lit(n) - F.size("_hits"), F.lit(0))
    padded = listed.withColumn("_first", first_ids).withColumn(
        "_rest", F.slice(F.array_except("_first", "_hits.paper_id"), F.lit(1), missing))
    filled = F.concat("_hits", F.transform("_rest", lambda p: F.struct(
        p.alias("paper_id"), F.lit(0.0).alias("score"))))
    return padded.select("user_id", F.posexplode(filled).alias("_pos", "_p")).select(
        "user_id", F.col("_p.paper_id").alias("paper_id"), F.col("_p.score").alias("score"),
        (F.col("_pos") + 1).alias("rank"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """Best ``n`` papers per user; ties go to the smaller paper id."""
    return keep_ranked(scored, ["user_id"], [F.col("score").desc(), F.col("paper_id").asc()],
                       n, rank="rank")


def top_n_for_profiles(index: PaperIndex, users: DataFrame, n: int = TOP_N,
                       block_terms: int = BLOCK_TERMS, slice_papers: int = SLICE_PAPERS) -> DataFrame:
    """Top papers per user by cosine similarity to the profile: (user_id, paper_id, score, rank).

    ``users`` has ``user_id`` and ``keyword_profile``. The result has min(n, papers) rows per
    user; papers without any shared term score 0. Exact, but only pairs that can reach a user's best are added up.
    """
    queries = written(packed_profiles(index, users).select("user_id", codes(F.col("terms")).alias("codes"), "weights"), "profiles")
    papers = written(index.vectors.select("paper_id", codes(F.col("terms")).alias("codes"), "weights"), "impacts")
    rows = queries.agg(F.sum(F.size("codes"))).first()[0] or 0
    hits = meet(papers, queries, rows, best_by_profiles(n), slice_papers=slice_papers, block_terms=block_terms)
    return fill_to_n(top_n(hits, n), users, index.papers, n)


# The intercept travels as the weight of this term, which every paper carries once.
BIAS = ""


def _met_with_models(counts: DataFrame, models: DataFrame, meta: DataFrame, n: int | None,
                     block_terms: int, slice_papers: int) -> DataFrame:
    """Every paper slice with every block of models; a model is one packed row."""
    packed = models.groupBy("user_id").agg(F.collect_list(F.struct(
        F.xxhash64("term").alias("code"), F.col("idf").cast("double").alias("idf"), F.col("coef").cast("double").alias("coef"))).alias("_m"))
    none = F.array().cast("array<struct<code:bigint,idf:double,coef:double>>")
    usable = meta.where(F.col("intercept").isNotNull()).select("user_id", F.col("intercept").cast("double").alias("intercept"))
    queries = written(usable.join(packed, "user_id", "left").withColumn("_m", F.coalesce("_m", none)).select(
        "user_id", "intercept", F.col("_m.code").alias("codes"), F.col("_m.idf").alias("idfs"), F.col("_m.coef").alias("coefs")),
        "packed-models")
    rows = queries.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    papers = written(counts.select("paper_id", codes(F.col("terms")).alias("codes"), "tfs"), "packed-papers")
    return meet(papers, queries, rows, best_by_models(n), slice_papers=slice_papers, block_terms=block_terms)


def predict(counts: DataFrame, models: DataFrame, meta: DataFrame, block_terms: int = BLOCK_TERMS,
            slice_papers: int = SLICE_PAPERS) -> DataFrame:
    """Like-probability of every paper for every model: (user_id, paper_id, score).

    Papers without a known term score sigmoid(intercept). Rows for all pairs: for small sets and checks. ``predict_pairs``
    scores given pairs, ``top_n_for_models`` keeps the best of each slice before anything is shuffled.
    """
    return _met_with_models(counts, models, meta, None, block_terms, slice_papers)


def predict_pairs(pairs: DataFrame, counts: DataFrame, models: DataFrame, meta: DataFrame,
                  keys: Sequence[str] = ("user_id",), digits: int | None = DIGITS) -> DataFrame:
    """Like-probability of given (model, paper) pairs, as column ``score``.

    Papers meet the models that ask for them in blocks, see ``operators.pairs``: no row per (model, paper, term).
    """
    keys = list(keys)
    sums = pair_sums(pairs, counts, models.select(*keys, "term", "idf", "coef"), keys)
    score = sigmoid(F.col("intercept") + F.coalesce(F.col("_dot") / F.col("_norm"), F.lit(0.0)))
    return (
        pairs.join(meta.select(*keys, "intercept"), keys)
        .join(sums, [*keys, "paper_id"], "left")
        .withColumn("score", score if digits is None else F.round(score, digits))
        .drop("_dot", "_norm", "intercept")
    )


def top_n_for_models(index: PaperIndex, models: DataFrame, meta: DataFrame, n: int = TOP_N,
                     block_terms: int = BLOCK_TERMS, slice_papers: int = SLICE_PAPERS) -> DataFrame:
    """Top papers per user by like-probability: (user_id, paper_id, score, rank).

    Blocks of models meet slices of papers as dense products; a meeting returns the best ``n`` of each user, so at most
    users x n rows per slice are shuffled. The last rank over those is exact.
    """
    return top_n(_met_with_models(index.counts, models, meta, n, block_terms, slice_papers), n)


def route_users(users: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with a usable model, and the others."""
    ids = meta.where(F.col("intercept").isNotNull()).select("user_id")
    return users.join(ids, "user_id", "left_semi"), users.join(ids, "user_id", "left_anti")


def candidates(index: PaperIndex, users: DataFrame, models: DataFrame, meta: DataFrame,
               n: int = TOP_N) -> DataFrame:
    """Model ranking for users with a usable model, profile ranking for the others.

    ``has_model`` tells which: only those rows get a preference score later.
    """
    modelled, cold = route_users(users, meta)
    usable = meta.join(modelled.select("user_id"), "user_id", "left_semi") \
        .where(F.col("intercept").isNotNull())
    theirs = models.join(usable.select("user_id"), "user_id", "left_semi")
    a = top_n_for_models(index, theirs, usable, n).withColumn("has_model", F.lit(True))
    b = top_n_for_profiles(index, cold, n).withColumn("has_model", F.lit(False))
    return a.unionByName(b)
