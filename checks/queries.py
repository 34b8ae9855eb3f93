"""One query per operator, over the whole given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import AS_OF, DAYS_BACK, Views, views
from dailyfolio.functions import bot, messages, papers as paper_fn, scores as score_fn, text
from dailyfolio.operators import (
    digest, grams, pairs, papers, prefmodel, ranking, retrieval, scoring, settings, sharedmodel, totals, upserts, users)
from dailyfolio.plans import daily, feedback, retrain
from dailyfolio.plans.ingest import ingest as run_ingest
from dailyfolio.plans.summary import run_summary
from dailyfolio.session import scratch_path, shuffles_dropped, spread, written
from dailyfolio.sources import feeds
from dailyfolio.sources.tables import TableStore
from dailyfolio.sources.updates import read_updates
from dailyfolio.streaming import dead_letters as dead_letter_jobs
from dailyfolio.streaming import ratings as rating_jobs
from dailyfolio.streaming import settings as settings_jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STAMP = dt.datetime(2024, 1, 30)


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(views(spark, sf_dir))
    return fn


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- text and papers ---------------------------------------------------------------------

@query
def normalize_title(v):
    return v["papers_fx"].select("id", text.normalize_title(F.col("title")).alias("norm"))


@query
def title_hash(v):
    return v["papers_fx"].select("id", text.title_hash(F.col("title")).alias("title_hash"))


@query
def clean_line(v):
    return v["conversations"].select("conv_id", "turn", text.clean_line(F.col("text")).alias("line"))


@query
def doc_text(v):
    joined = text.doc_text(F.col("title"), F.col("abstract"))
    return v["papers_fx"].select("id", F.sha2(joined, 256).alias("text_hash"))


@query
def truncate_ellipsis(v):
    return v["papers_fx"].select("id", text.truncate_ellipsis(F.col("abstract"), 400).alias("short"))


@query
def first_k_authors(v):
    return v["papers_fx"].select(
        "id", F.array_join(paper_fn.first_k(F.col("authors")), "; ").alias("authors"))


@query
def format_authors(v):
    return v["papers_fx"].select("id", paper_fn.format_authors(F.col("authors")).alias("line"))


@query
def prompt_item(v):
    item = messages.prompt_item(
        F.col("doc_id") % 10 + 1, F.col("title"), F.col("authors"), F.col("abstract"))
    return v["papers_fx"].select("id", item.alias("item"))


@query
def paper_links(v):
    # Document and page addresses as entry ids, some with a version suffix.
    entry = F.concat(F.lit("http://feed.example/abs/"), F.col("doc_id").cast("string"),
                     F.when(F.col("doc_id") % 2 == 0, F.lit("v12")).otherwise(F.lit("")))
    number = paper_fn.arxiv_number(entry)
    return v["documents"].select(
        "doc_id", paper_fn.paper_id(paper_fn.ARXIV_PREFIX, number).alias("id"),
        F.concat(F.lit(paper_fn.ARXIV_PAGE), number).alias("url"),
        F.concat(F.lit(paper_fn.ARXIV_PDF), number).alias("pdf_url"))


@query
def tokens(v):
    kept = text.remove_stop_words(text.tokens(F.col("text")))
    return v["benchmark"].select("item_id", F.array_join(kept, " ").alias("kept"))


@query
def ngrams(v):
    grams = text.ngrams(text.remove_stop_words(text.tokens(F.col("text"))))
    return v["conversations"].select("conv_id", "turn", F.array_join(grams, "|").alias("grams"))


# --- dedup, sets and references ----------------------------------------------------------

def _hashed(df):
    return df.withColumn("title_hash", text.title_hash(F.col("title")))


@query
def title_hash_dedup(v):
    return ranking.dedup_first(v["papers_fx"]).select("id", "title_hash")


@query
def dedup_last_by_id(v):
    half = F.col("doc_id") % F.ceil(v["documents"].agg(F.count("*")).scalar() / 2)
    batch = _hashed(v["papers_fx"]).withColumn("id", F.concat(F.lit("arxiv:"), half.cast("string")))
    return ranking.dedup_last_by_id(batch).select("id", "doc_id")


@query
def new_papers_anti(v):
    old = F.col("published_date") < "2024-01-15"
    batch = ranking.dedup_first(v["papers_fx"].where(~old))
    return papers.new_papers(batch, _hashed(v["papers_fx"].where(old))).select("id", "title_hash")


@query
def combine_sources(v):
    def part(name):
        return v["papers_fx"].where(F.col("source") == name)

    ordered = [part(n).withColumn("arrival", F.struct(F.lit(i).alias("source_pos"), "arrival"))
               for i, n in enumerate(("arxiv", "semantic_scholar", "pubmed"))]
    return feeds.combine(*ordered).select("id", "source")


@query
def newest_per_feed(v):
    feeds = v["papers_fx"].withColumn("feed", F.coalesce("venue", F.lit("")))
    return ranking.newest_per_feed(feeds, ["feed"], 100).select("feed", "id", *big("feed_pos"))


@query
def since_cutoff(v):
    return papers.since(v["papers_fx"], AS_OF, DAYS_BACK).select("id", "published_date")


@query
def canonical_ids(v):
    old = F.col("published_date") < "2024-01-15"
    stored = ranking.dedup_first(v["papers_fx"].where(old))
    batch = ranking.dedup_first(v["papers_fx"].where(~old))
    return papers.canonical_ids(batch, stored).select("doc_id", "id")


def _rated(v):
    return v["ratings_fx"].join(
        v["users_fx"].select(F.col("chat_id").alias("user_chat_id"), "user_id"),
        "user_chat_id", "left")


@query
def valid_refs(v):
    return papers.valid_refs(_rated(v), v["papers_fx"], v["users_fx"]).select("id", "user_id", "paper_id")


@query
def rejected_refs(v):
    return papers.valid_refs(_rated(v), v["papers_fx"], v["users_fx"], rejected=True).select(
        "id", "user_id", "paper_id")


@query
def ratings_with_text(v):
    return papers.ratings_with_text(v["ratings_fx"], v["papers_fx"]).select(
        "id", "paper_id", "title", F.length("abstract").cast("bigint").alias("chars"))


@query
def with_user_id(v):
    return papers.with_user_id(v["ratings_fx"], v["users_fx"]).select("id", "user_id")


# --- users -------------------------------------------------------------------------------

@query
def due_users(v):
    return users.due_users(users.active_users(v["users_fx"]), AS_OF).select("user_id", "next_digest_date")


@query
def has_profile(v):
    return users.has_profile(v["users_fx"]).select("user_id")


@query
def user_by_chat(v):
    return users.user_by_chat(v["users_fx"], 1007).select("user_id", "chat_id")


@query
def resolve_settings(v):
    return users.resolve_settings(v["users_fx"]).select(
        "user_id", "max_papers", "digest_frequency", "min_rating", "keyword_profile")


@query
def advance_schedule(v):
    return users.advance_schedule(users.due_users(v["users_fx"], AS_OF), AS_OF)


@query
def update_users(v):
    due = users.due_users(v["users_fx"], AS_OF)
    stray = due.withColumn("chat_id", F.col("chat_id") + 1_000_000)
    changes = users.advance_schedule(due.unionByName(stray), AS_OF)
    return upserts.update_users(v["users_fx"], changes).select("chat_id", "next_digest_date", "active")


@query
def next_weekday(v):
    name = F.element_at(F.array(*[F.lit(x) for x in (
        "Monday", "TUESDAY", " wednesday ", "Thursday", "friday", "Saturday", "sunday", "Mon", "")]),
        (F.col("event_id") % 9 + 1).cast("int"))
    day = F.to_date("ts")
    return v["events"].select("event_id", bot.next_weekday_on_or_after(day, name).alias("day"))


# --- feedback ----------------------------------------------------------------------------

@query
def parse_rating_callback(v):
    return v["ratings_raw_fx"].select(
        "update_id", bot.parse_rating_callback(F.col("data")).alias("r")).select(
        "update_id", "r.paper_id", F.col("r.score").cast("int").alias("score"), "r.reason")


@query
def parse_command(v):
    return v["updates_fx"].select("update_id", bot.parse_command(F.col("text")).alias("c")).select(
        "update_id", "c.*")


def _accepted(v):
    return rating_jobs.accepted_ratings(
        rating_jobs.parsed_ratings(v["ratings_raw_fx"]), v["papers_fx"])


def _stored_and_batch(v):
    """Ratings of the first half of the month as the store, the rest as a batch."""
    accepted = _accepted(v)
    early = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    return (upserts.new_ratings(accepted.where("1 = 0"), accepted.where(early)),
            accepted.where(~early))


@query
def insert_ratings_first(v):
    stored, batch = _stored_and_batch(v)
    return upserts.insert_ratings(stored, batch).select(
        "id", "user_chat_id", "paper_id", F.col("score").cast("int").alias("score"))


@query
def insert_ratings_last(v):
    stored, batch = _stored_and_batch(v)
    return upserts.insert_ratings(stored, batch, keep="last").select(
        "id", "user_chat_id", "paper_id", F.col("score").cast("int").alias("score"))


@query
def refused_ratings(v):
    parsed = rating_jobs.parsed_ratings(v["ratings_raw_fx"])
    accepted = rating_jobs.accepted_ratings(parsed, v["papers_fx"])
    added = upserts.new_ratings(accepted.limit(0), accepted)
    return rating_jobs.refused_ratings(parsed, v["papers_fx"]).unionByName(
        rating_jobs.repeated_ratings(accepted, added)).select("update_id", "reason")


@query
def rating_counts(v):
    return digest.rating_counts(v["ratings_fx"], v["users_fx"]).select(
        "user_id", "chat_id", *big("rating_count"))


@query
def digest_header(v):
    counts = digest.rating_counts(v["ratings_fx"], v["users_fx"])
    return counts.select(
        "user_id", messages.digest_header(F.col("rating_count")).alias("header"),
        messages.is_milestone(F.col("rating_count")).alias("milestone"))


@query
def settings_last_value(v):
    return settings.settings_last_value(v["updates_fx"])


@query
def settings_from_log(v):
    log = v["updates_fx"].withColumn("ts", F.col("ts").cast("timestamp"))
    return settings.settings_from_log(log, v["users_fx"].drop("user_id")).select(
        "chat_id", "keyword_profile", "active", "max_papers", "digest_frequency",
        "next_digest_date", "min_rating", "pending_action")


# --- scores and digests ------------------------------------------------------------------

@query
def like_label(v):
    return v["parsed_fx"].select("id", score_fn.like_label(F.col("score")).alias("label"))


@query
def pref_score(v):
    return v["events"].select("event_id", score_fn.pref_score(
        score_fn.sigmoid(F.col("value") / 100 - 1)).alias("pref_score"))


@query
def final_score(v):
    return v["score_events_fx"].select(
        "event_id", score_fn.final_score(F.col("llm_score"), F.col("pref_score")).alias("final_score"))


@query
def upsert_scores(v):
    events = v["score_events_fx"].withColumnRenamed("event_id", "arrival")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    newest = [F.col("arrival").desc()]
    stored = ranking.keep_ranked(events.where(early), ["user_id", "paper_id"], newest).select(
        "paper_id", "user_id", "llm_score", "pref_score",
        score_fn.final_score(F.col("llm_score"), F.col("pref_score")).alias("final_score"),
        "llm_explanation", F.lit(dt.datetime(2024, 1, 15)).alias("scored_at"))
    batch = ranking.keep_ranked(events.where(~early), ["user_id", "paper_id"], newest)
    return upserts.upsert_scores(stored, batch, STAMP).withColumn(
        "scored_at", F.to_date("scored_at"))


@query
def upsert_papers(v):
    n = v["documents"].agg(F.count("*")).scalar()
    base = _hashed(v["papers_fx"])
    store = base.where("published_date < date '2024-01-15'").withColumn(
        "fetched_at", F.lit(dt.datetime(2024, 1, 15)))
    moved = F.concat(F.lit("arxiv:"), ((F.col("doc_id") * 3) % n).cast("string"))
    batch = base.where("published_date >= date '2024-01-15'").withColumn("id", moved)
    return upserts.upsert_papers(store.drop("doc_id", "arrival"), batch, STAMP).select(
        "id", "title_hash", F.to_date("fetched_at").alias("fetched_on"))


@query
def log_sent(v):
    sent = v["scores_fx"].where("event_type in ('view', 'click')")
    return upserts.log_sent(v["digest_log_fx"], sent, STAMP).select(
        "user_id", "paper_id", F.to_date("sent_at").alias("sent_on"))


def _settings(v):
    return users.resolve_settings(v["users_fx"])


@query
def passes_final(v):
    return digest.passes_final(v["scores_fx"], _settings(v)).select(
        "user_id", "paper_id", "final_score", "max_papers")


@query
def recent_pool(v):
    pool = digest.recent_pool(digest.passes_final(v["scores_fx"], _settings(v)))
    return pool.select("user_id", "paper_id")


@query
def unsent_scores(v):
    return digest.unsent(v["scores_fx"], v["digest_log_fx"]).select("user_id", "paper_id")


@query
def scored_with_paper(v):
    return digest.scored_with_paper(v["scores_fx"], v["papers_fx"], AS_OF, DAYS_BACK).select(
        "user_id", "paper_id", "title", "published_date")


def _digest(v, **options):
    return digest.unsent_digest(v["scores_fx"], v["digest_log_fx"], v["papers_fx"],
                                _settings(v), AS_OF, DAYS_BACK, **options)


@query
def unsent_digest(v):
    return _digest(v).select("user_id", "paper_id", "final_score", *big("position"))


@query
def unsent_digest_clean_pool(v):
    return _digest(v, pool_before_anti=False).select(
        "user_id", "paper_id", "final_score", *big("position"))


def _ranked(v):
    """Scores as ranked candidates: 30 per user, newest events first."""
    rows = v["scores_fx"].withColumn("score", F.coalesce("pref_score", F.lit(0)).cast("double"))
    return retrieval.top_n(rows, 30).select("user_id", "paper_id", "rank", "llm_score", "llm_explanation")


@query
def top_n(v):
    return _ranked(v).select("user_id", "paper_id", *big("rank"))


@query
def dry_run_digest(v):
    scored = scoring.passes_minimum(_ranked(v), _settings(v))
    return digest.dry_run_digest(scored, v["papers_fx"], _settings(v)).select(
        "user_id", "paper_id", F.col("final_score"), *big("position"))


@query
def render_message(v):
    joined = digest.scored_with_paper(v["scores_fx"], v["papers_fx"], AS_OF, DAYS_BACK)
    return joined.select("user_id", "paper_id", messages.render_message(
        F.col("title"), F.col("url"), F.col("authors"), F.col("source"), F.col("venue"),
        F.col("llm_explanation"), F.col("final_score")).alias("text"))


@query
def rating_actions(v):
    listed = F.transform(bot.rating_actions(F.col("id")),
                         lambda a: F.concat(a["label"], F.lit("="), a["data"]))
    return v["papers_fx"].select("id", F.array_join(listed, " ").alias("actions"))


@query
def digest_messages(v):
    counts = digest.rating_counts(v["ratings_fx"], v["users_fx"])
    return digest.digest_messages(_digest(v), counts).select(
        "user_id", "chat_id", *big("position"), "kind", "paper_id", "text",
        F.coalesce(F.size("actions"), F.lit(0)).cast("bigint").alias("buttons"))


@query
def delivered_to_log(v):
    counts = digest.rating_counts(v["ratings_fx"], v["users_fx"])
    outbox = digest.digest_messages(_digest(v), counts)
    receipts = outbox.select("user_id", "position", (F.col("position") != 2).alias("delivered"))
    return digest.delivered_to_log(outbox, receipts, v["digest_log_fx"], STAMP).select(
        "user_id", "paper_id")


# --- scorer job --------------------------------------------------------------------------

@query
def batch_of(v):
    return scoring.batch_of(_ranked(v)).select(
        "user_id", "paper_id", *big("batch_no", "pos_in_batch"))


def _requests(v):
    return scoring.score_requests(_ranked(v), v["papers_fx"], users.has_profile(v["users_fx"]))


@query
def score_requests(v):
    return _requests(v).select("user_id", *big("batch_no", "n"), "request")


def _replies(v):
    """Replies built from stored scores: fenced, malformed and short ones among them."""
    numbered = scoring.batch_of(_ranked(v))
    item = F.concat(
        F.lit('{"score": '), F.coalesce(F.col("llm_score").cast("string"), F.lit("null")),
        F.lit(', "reason": "'), F.coalesce("llm_explanation", F.lit("")), F.lit('"}'))
    listed = F.sort_array(F.collect_list(F.struct("pos_in_batch", item.alias("item"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda s: s["item"]), ", "), F.lit("]"))
    texts = numbered.groupBy("user_id", "batch_no").agg(body.alias("body"))
    kind = (F.col("user_id") + F.col("batch_no")) % 5
    return texts.where(kind != 4).select(
        "user_id", "batch_no",
        F.when(kind == 0, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```")))
        .when(kind == 1, F.col("body"))
        .when(kind == 2, F.concat(F.lit("Sure: "), F.col("body")))
        .otherwise(F.lit('[{"score": 9, "reason": "one"}]')).alias("reply"))


@query
def reply_outcomes(v):
    return scoring.reply_outcomes(_requests(v), _replies(v)).select(
        "user_id", *big("batch_no"), "status")


@query
def score_replies(v):
    ranked = _ranked(v).drop("llm_score", "llm_explanation")
    return scoring.score_replies(ranked, _requests(v), _replies(v), _settings(v)).select(
        "user_id", "paper_id", "llm_score", "llm_explanation")


@query
def apply_scorer(v):
    return scoring.apply_scorer(_requests(v), scoring.overlap_scorer)


@query
def strip_code_fence(v):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```  "))
    return v["conversations"].select("conv_id", "turn", messages.strip_code_fence(
        F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text"))).alias("text"))


@query
def parse_score_reply(v):
    return _replies(v).select(
        "user_id", "batch_no", F.posexplode(messages.parse_score_reply(F.col("reply"))).alias("pos", "item")
    ).select("user_id", *big("batch_no", "pos"), "item.score", "item.reason")


# --- retrieval ---------------------------------------------------------------------------

def _index(v):
    return retrieval.build_index(v["papers_fx"])


def _profiles(v):
    return users.has_profile(v["users_fx"]).select("user_id", "keyword_profile")


@query
def document_frequency(v):
    counts = retrieval.exploded(_index(v).counts, ["paper_id"])
    return retrieval.document_frequency(counts).select("term", *big("df"))


@query
def corpus_term_frequency(v):
    counts = retrieval.exploded(_index(v).counts, ["paper_id"])
    return retrieval.corpus_term_frequency(counts).select("term", *big("ctf"))


@query
def vocab_topk(v):
    return _index(v).vocab.select("term", *big("ctf", "df"), r6("idf"))


@query
def tfidf_weights(v):
    return _index(v).postings().select("paper_id", "term", r6("weight"))


@query
def l2_norm(v):
    raw = retrieval.exploded(_index(v).counts, ["paper_id"]).withColumn(
        "weight", retrieval.sublinear(F.col("tf")))
    return retrieval.l2_norm(raw, ["paper_id"]).select("paper_id", r6("norm"))


@query
def sparse_dot(v):
    index = _index(v)
    queries = retrieval.profile_vectors(index, _profiles(v))
    return retrieval.sparse_dot(queries, index.postings()).select("user_id", "paper_id", r6("dot"))


@query
def top_n_profiles(v):
    return retrieval.top_n_for_profiles(_index(v).materialize(), _profiles(v)).select(
        "user_id", "paper_id", "score", *big("rank"))


def _training(v):
    return prefmodel.training_set(v["ratings_fx"], v["papers_fx"], v["users_fx"])


def _words(v):
    """Uncounted words of all papers: the joins with ratings leave the rated ones."""
    return grams.paper_words(v["papers_fx"])


_lifted: dict[tuple[str, str], tuple] = {}


def _lift_models(v):
    """Linear models that SQL can state: per user and term, idf on the user's rated papers
    and the lean of the term towards liked ones; the intercept is the user's like rate - 1/2.

    Models are tables that retraining has written before, so they are written here once for a session and folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _lifted:
        _lifted[key] = _made_lift_models(v)
    return _lifted[key]


def _made_lift_models(v):
    rows = written(_training(v).select("user_id", "rating_id", "paper_id", "label"), "rated")
    top = totals.top_terms(rows, _words(v), retrieval.MAX_FEATURES, 2 * F.col("label") - 1)
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("label") - 0.5).alias("intercept"))
    models = top.join(sizes, "user_id").select(
        "user_id", "term", retrieval.idf(F.col("n"), F.col("df")).alias("idf"),
        (F.col("lean") / (F.col("df") + 1)).alias("coef"))
    return written(models, "lift-models"), written(sizes.select("user_id", "intercept"), "lift-meta")


@query
def keyed_vocab(v):
    rows = written(_training(v).select("user_id", "rating_id", "paper_id"), "rated")
    return retrieval.fit_user_vocab(rows, _words(v)).select(
        "user_id", "term", *big("ctf", "df"), r6("idf"))


@query
def predict_linear(v):
    return retrieval.predict(grams.counted(_words(v)), *_lift_models(v))


@query
def top_n_models(v):
    return retrieval.top_n_for_models(_index(v).materialize(), *_lift_models(v)).select(
        "user_id", "paper_id", "score", *big("rank"))


@query
def candidates(v):
    models, meta = _lift_models(v)
    meta = meta.where(F.col("intercept") > 0)
    return retrieval.candidates(_index(v).materialize(), _profiles(v), models, meta).select(
        "user_id", "paper_id", "score", *big("rank"), "has_model")


@query
def route_users(v):
    _, meta = _lift_models(v)
    modelled, cold = retrieval.route_users(_profiles(v), meta.where(F.col("intercept") > 0))
    return modelled.withColumn("route", F.lit("model")).unionByName(
        cold.withColumn("route", F.lit("profile"))).select("user_id", "route")


@query
def pref_scores(v):
    passed = v["scores_fx"].where("llm_score >= 6").select("user_id", "paper_id", "llm_score")
    models, meta = _lift_models(v)
    prefs = prefmodel.pref_scores(passed, _words(v), models, meta)
    return prefmodel.attach_pref(passed, prefs).select("user_id", "paper_id", "llm_score", "pref_score")


# --- preference models -------------------------------------------------------------------

@query
def training_set(v):
    return _training(v).select("user_id", "rating_id", "paper_id", "label",
                               F.sha2("text", 256).alias("text_hash"))


@query
def class_counts(v):
    return prefmodel.class_counts(_training(v)).select(
        "user_id", *big("n", "n_liked", "n_disliked", "classes"))


@query
def trainable_users(v):
    return prefmodel.trainable_users(_training(v)).select("user_id", *big("n"))


@query
def balanced_weights(v):
    return prefmodel.balanced_weights(_training(v)).select("rating_id", r6("weight"))


@query
def balanced_weights_labels(v):
    rows = v["labels"].select("doc_id", F.col("quality").alias("label"), "toxic")
    return prefmodel.balanced_weights(rows, ["toxic"]).select("doc_id", r6("weight"))


@query
def fold_assignment(v):
    return prefmodel.assign_folds(_training(v)).select("rating_id", *big("fold"))


def _predictions(v):
    rows = prefmodel.assign_folds(_training(v)).drop("text")
    return rows.withColumn("score", ((F.col("rating_id") * 37) % 101) / 100.0)


@query
def average_rank(v):
    return prefmodel.average_rank(_predictions(v), ["user_id", "fold"]).select(
        "rating_id", F.col("average_rank").cast("double").alias("average_rank"))


@query
def auc_per_fold(v):
    return prefmodel.roc_auc(_predictions(v)).select("user_id", *big("fold"), F.round("auc", 12).alias("auc"))


@query
def cv_summary(v):
    return prefmodel.cv_summary(prefmodel.roc_auc(_predictions(v))).select(
        "user_id", F.round("cv_auc_mean", 9).alias("cv_auc_mean"),
        F.round("cv_auc_std", 9).alias("cv_auc_std"))


@query
def fit_models(v):
    return prefmodel.fit_models(_training(v), _words(v))


def _at_the_optimum(rows, counts, models, meta, keys: list[str]):
    """Per model the number of its terms, the sum of their idf, and its largest absolute gradient, which is zero at the optimum.

    ``rows`` are what each model is fitted on."""
    weighted = prefmodel.balanced_weights(rows.join(meta.select(*keys), keys, "left_semi"), keys)
    steepest = pairs.steepest(weighted, counts, models, meta, keys)
    sizes = models.groupBy(*keys).agg(F.count("*").alias("terms"), F.sum("idf").alias("idf"))
    return meta.join(sizes, keys).join(steepest, keys).select(
        *big(*keys, "n", "terms"), F.round("idf", 4).alias("idf"), F.round("s", 6).alias("steepest"))


@query
def fit_models_optimum(v):
    """The size of each model, and its largest absolute gradient."""
    training, counts = _training(v).drop("text"), _words(v)
    models, meta = prefmodel.split_fitted(written(prefmodel.fit_models(training, counts), "fitted"))
    return _at_the_optimum(training, counts, models, meta, ["user_id"])


@query
def cross_validate_optimum(v):
    """Of each model without a fold the rows it was fitted on, its size and largest gradient, and the ratings it scored."""
    training, counts = _training(v).drop("text"), _words(v)
    trained = written(prefmodel.train(training, counts, fold_models=True), "trained")
    rows = trained.where("fold > 0 and term is not null").select("user_id", "fold", "term", "idf", "coef", "n")
    models = rows.where(F.col("term") != retrieval.BIAS).drop("n")
    meta = rows.where(F.col("term") == retrieval.BIAS).select("user_id", "fold", "n", F.col("coef").alias("intercept"))
    folds = F.explode(F.sequence(F.lit(1), F.lit(prefmodel.FOLDS)))
    others = prefmodel.assign_folds(training).withColumn("out", folds).where("fold <> out").drop("fold").withColumnRenamed("out", "fold")
    held = prefmodel.held_out(trained).groupBy("user_id", "fold").agg(F.count("*").alias("held"), F.sum("label").alias("liked"))
    return _at_the_optimum(others, counts, models, meta, ["user_id", "fold"]).join(held, ["user_id", "fold"])


def _labelled(v):
    """The given labels as ratings of one and all."""
    papers = v["papers_fx"].select("doc_id", F.col("id").alias("paper_id"))
    return v["labels"].select("doc_id", F.col("quality").alias("label")).join(papers, "doc_id").select(
        F.col("doc_id").alias("rating_id"), "paper_id", "label")


@query
def fit_shared_optimum(v):
    """The size of the model over all labels, and its largest absolute gradient, which is zero at the optimum."""
    rows = _labelled(v)
    counts = written(prefmodel.rated_counts(rows, v["papers_fx"]), "labelled-counts")
    fitted = written(sharedmodel.fit_shared(rows, counts), "shared-fitted").withColumn("user_id", F.lit(0).cast("bigint"))
    models, meta = prefmodel.split_fitted(fitted)
    weighted = sharedmodel.class_weights(rows).withColumn("user_id", F.lit(0).cast("bigint"))
    pulls = retrieval.predict_pairs(weighted, counts, models, meta, digits=None).withColumn(
        "pull", F.col("weight") * (F.col("score") - F.col("label")))
    keys = ["rating_id", "pull"]
    entries = retrieval.exploded(pulls.join(counts, "paper_id").select(*keys, "terms", "tfs"), keys).join(
        models, "term").withColumn("w", retrieval.sublinear(F.col("tf")) * F.col("idf"))
    norms = entries.groupBy("rating_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    slopes = entries.join(norms, "rating_id").groupBy("term").agg(
        F.abs(F.sum(F.col("pull") * F.col("w") / F.col("norm")) + F.first("coef")).alias("s"))
    steepest = slopes.select("s").unionByName(pulls.agg(F.abs(F.sum("pull")).alias("s"))).agg(F.max("s").alias("s"))
    sizes = models.agg(F.count("*").alias("terms"), F.sum("idf").alias("idf"))
    return meta.select("n").join(sizes).join(steepest).select(
        *big("n", "terms"), F.round("idf", 4).alias("idf"), F.round("s", 3).alias("steepest"))


@query
def cross_validate(v):
    return prefmodel.cross_validate(_training(v), _words(v))


@query
def summary(v):
    parsed = rating_jobs.parsed_ratings(v["ratings_raw_fx"])
    return run_summary({
        "fetched": v["papers_fx"], "new": ranking.dedup_first(v["papers_fx"]),
        "due": users.due_users(v["users_fx"], AS_OF),
        "ratings": parsed.withColumn("status", F.coalesce("reason", F.lit("ok"))),
    }).select("stage", "part", *big("rows"))


# --- landed payloads ---------------------------------------------------------------------

def _land_atom(v) -> str:
    """The papers as Atom entries, one feed per source, some with an unreadable date."""
    path = scratch_path(v.spark, "atom")
    clock = lambda n: F.lpad((F.col("doc_id") % n).cast("string"), 2, "0")
    day = F.concat(F.col("published_date").cast("string"), F.lit("T"), clock(24), F.lit(":"), clock(60), F.lit(":00Z"))
    number = F.col("doc_id").cast("string")
    v["papers_fx"].select(
        F.col("source").alias("category"),
        F.concat(F.lit("http://arxiv.org/abs/"), number, F.lit("v2")).alias("id"),
        F.when(F.col("doc_id") % 50 == 7, F.lit("some day")).otherwise(day).alias("published"),
        "title", F.col("abstract").alias("summary"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"),
        F.array(
            F.struct(F.concat(F.lit("https://papers.example/"), number).alias("_href"),
                     F.lit("text/html").alias("_type")),
            F.struct(F.concat(F.lit("https://papers.example/pdf/"), number).alias("_href"),
                     F.when(F.col("doc_id") % 3 == 0, F.lit("application/pdf"))
                     .otherwise(F.lit("text/plain")).alias("_type"))).alias("link"),
    ).write.partitionBy("category").format("xml").options(
        rowTag="entry", rootTag="feed", compression="gzip").save(path)
    return path


def _land_search(v) -> str:
    """The papers as search responses of up to 100 items, one response per line."""
    path = scratch_path(v.spark, "search")
    d, number = F.col("doc_id"), F.col("doc_id").cast("string")
    item = F.struct(
        (d % 100).alias("_place"),
        F.when(d % 11 != 3, F.concat(F.lit("h"), number)).alias("paperId"), "title", "abstract",
        F.lit(2024).alias("year"),
        F.when(d % 13 == 5, F.lit("2024-13-45")).when(d % 5 != 0, F.col("published_date").cast("string"))
        .alias("publicationDate"),
        F.coalesce("venue", F.lit("  ")).alias("venue"),
        F.struct(F.concat(F.lit("Journal "), (d % 7).cast("string")).alias("name")).alias("journal"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
        F.struct(F.when(d % 3 == 0, number).alias("ArXiv")).alias("externalIds"),
        F.struct(F.when(d % 3 == 1, F.concat(F.lit("https://papers.example/pdf/"), number)).alias("url"))
        .alias("openAccessPdf"))
    pages = v["papers_fx"].select(F.floor(d / 100).alias("page"), item.alias("item")).groupBy("page").agg(
        F.sort_array(F.collect_list("item")).alias("data"))
    with shuffles_dropped(v.spark):
        pages.select("data").write.json(path, compression="gzip")
    return path


def _land_pubmed(v) -> str:
    """The papers as article records, some without a year."""
    path = scratch_path(v.spark, "pubmed")
    d, day = F.col("doc_id"), F.col("published_date")
    article = F.struct(
        F.col("title").alias("ArticleTitle"),
        F.struct(F.array(
            F.struct(F.col("title").alias("_VALUE"), F.lit("BACKGROUND").alias("_Label")),
            F.struct(F.col("abstract").alias("_VALUE"), F.lit("").alias("_Label"))).alias("AbstractText"))
        .alias("Abstract"),
        F.struct(F.transform("authors", lambda a: F.struct(
            F.when(a != "In", a).alias("LastName"), F.lit("A.").alias("ForeName"))).alias("Author"))
        .alias("AuthorList"),
        F.struct(
            F.concat(F.lit("Journal of "), F.col("source")).alias("Title"),
            F.struct(F.struct(
                F.when(d % 17 != 2, F.year(day).cast("string")).alias("Year"),
                F.when(d % 2 == 0, F.date_format(day, "MMM")).otherwise(F.date_format(day, "M")).alias("Month"),
                F.date_format(day, "d").alias("Day")).alias("PubDate")).alias("JournalIssue"))
        .alias("Journal"))
    v["papers_fx"].select(F.struct(
        F.struct(d.cast("string").alias("_VALUE"), F.lit(1).alias("_Version")).alias("PMID"),
        article.alias("Article")).alias("MedlineCitation")
    ).write.format("xml").options(rowTag="PubmedArticle", rootTag="PubmedArticleSet", compression="gzip").save(path)
    return path


def _paper_out(batch):
    return batch.select(
        "id", "title", F.sha2("abstract", 256).alias("abstract_hash"),
        F.array_join("authors", "; ").alias("authors"), "published_date", "venue", "url", "pdf_url")


CATEGORIES = ("arxiv", "semantic_scholar", "pubmed")


@query
def read_atom(v):
    return _paper_out(feeds.read_atom(v.spark, _land_atom(v), AS_OF, DAYS_BACK, CATEGORIES))


@query
def read_search_json(v):
    return _paper_out(feeds.read_search_json(v.spark, _land_search(v), AS_OF, DAYS_BACK, multi_line=False))


@query
def read_pubmed(v):
    return _paper_out(feeds.read_pubmed(v.spark, _land_pubmed(v), AS_OF, DAYS_BACK))


# --- streams and whole jobs --------------------------------------------------------------

def _store(v, *names: str) -> TableStore:
    """A table store holding the derived tables."""
    store = TableStore(v.spark, scratch_path(v.spark, "store"))
    content = {
        "papers": lambda: ranking.dedup_first(v["papers_fx"]).withColumn("fetched_at", F.lit(STAMP)),
        "all_papers": lambda: _hashed(v["papers_fx"]).withColumn("fetched_at", F.lit(STAMP)),
        "half_papers": lambda: ranking.dedup_first(v["papers_fx"].where("doc_id % 2 = 0")).withColumn("fetched_at", F.lit(STAMP)),
        "users": lambda: v["users_fx"],
        "ratings": lambda: v["ratings_fx"].withColumn("created_at", F.col("created_at").cast("timestamp")),
        "paper_scores": lambda: v["scores_fx"],
        "digest_log": lambda: v["digest_log_fx"],
    }
    for name in names:
        store.replace(name.removeprefix("all_").removeprefix("half_"), content[name]())
    return store


def _land_updates(v) -> str:
    """Rating callbacks and messages as one update feed."""
    path = scratch_path(v.spark, "updates")
    nobody = F.lit(None)
    callback = F.struct(
        F.col("update_id").cast("string").alias("id"),
        F.struct(F.col("user_chat_id").alias("id")).alias("from"), "data")
    message = F.struct(
        F.struct(F.col("chat_id").alias("id")).alias("chat"),
        F.struct(F.col("chat_id").alias("id")).alias("from"), "text")
    kinds = [
        v["ratings_raw_fx"].select("update_id", F.col("ts").cast("timestamp").alias("ts"),
                                   F.to_json(callback).alias("c"), nobody.cast("string").alias("m")),
        v["updates_fx"].select("update_id", F.col("ts").cast("timestamp").alias("ts"),
                               nobody.cast("string").alias("c"), F.to_json(message).alias("m"))]
    feed = papers.union_all(*kinds)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    line = F.concat(
        F.lit('{"update_id": '), F.col("update_id").cast("string"), F.lit(', "ts": "'), stamp, F.lit('", '),
        F.when(F.col("c").isNotNull(), F.concat(F.lit('"callback_query": '), F.col("c")))
        .otherwise(F.concat(F.lit('"message": '), F.col("m"))), F.lit("}"))
    feed.select(line.alias("value")).write.text(path)
    return path


ALL_FILES = 1_000_000


@query
def read_updates_kinds(v):
    return read_updates(v.spark, _land_updates(v), stream=False).select("update_id", "kind")


@query
def load_tables(v):
    """Scans of stored tables with filters and columns pushed into the files."""
    store = _store(v, "users", "ratings", "paper_scores")
    scores = store.load("paper_scores").where(F.col("final_score") >= 6).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scores"))
    rated = store.load("ratings").groupBy(F.col("user_chat_id").alias("chat_id")).agg(
        F.count(F.lit(1)).alias("ratings"))
    people = users.active_users(store.load("users")).select(F.col("id").alias("user_id"), "chat_id")
    return people.join(scores, "user_id", "left").join(rated, "chat_id", "left").select(
        "user_id", "chat_id", "scores", "ratings")


@query
def rating_stream(v):
    store = _store(v, "all_papers")
    updates = read_updates(v.spark, _land_updates(v), max_files=ALL_FILES)
    rating_jobs.rating_stream(updates, store, scratch_path(v.spark, "checkpoint")).awaitTermination()
    return store.load("ratings").select(
        "id", "user_chat_id", "paper_id", F.col("score").cast("int").alias("score"))


@query
def settings_stream(v):
    store = _store(v, "users")
    updates = read_updates(v.spark, _land_updates(v), max_files=ALL_FILES)
    settings_jobs.settings_stream(updates, store, scratch_path(v.spark, "checkpoint")).awaitTermination()
    return store.load("users").select(
        "chat_id", "keyword_profile", "active", "max_papers", "digest_frequency",
        "next_digest_date", "min_rating", "pending_action")


@query
def rating_counts_stream(v):
    """Counts of ratings that arrive in several files, merged batch by batch."""
    store, path = _store(v), scratch_path(v.spark, "landed-ratings")
    v["ratings_fx"].repartition(4, "id").write.parquet(path)
    source = v.spark.readStream.schema(v["ratings_fx"].schema).option("maxFilesPerTrigger", 2).parquet(path)
    rating_jobs.keep_rating_counts(source, store, scratch_path(v.spark, "checkpoint")).awaitTermination()
    return store.load("rating_counts")


@query
def dead_letters(v):
    """A feed in which some lines are cut short and some updates are of no known kind."""
    path = scratch_path(v.spark, "updates")
    lines = v["ratings_raw_fx"].select("update_id")
    whole = F.concat(F.lit('{"update_id": '), F.col("update_id").cast("string"))
    lines.select(F.when(F.col("update_id") % 3 == 0, F.concat(whole, F.lit("}")))
                 .when(F.col("update_id") % 3 == 1, whole)
                 .otherwise(F.concat(whole, F.lit(', "message": {"chat": {"id": 1}, "text": "x"}}'))).alias("value")).write.text(path)
    store, checkpoint = _store(v), scratch_path(v.spark, "checkpoint")
    for _ in range(2):  # a second start finds nothing new
        letters = dead_letter_jobs.dead_letter_stream(read_updates(v.spark, path, max_files=ALL_FILES), store, checkpoint)
        letters.awaitTermination()
    return store.load("dead_letters").select("reason", F.when(F.col("reason") == "ignored", F.col("update_id")).alias("update_id"),
                                             F.when(F.col("reason") == "bad json", F.col("line")).alias("line"))


@query
def feedback_stream(v):
    store = _store(v, "all_papers", "users")
    for running in feedback.feedback_stream(store, _land_updates(v), scratch_path(v.spark, "checkpoint")):
        running.awaitTermination()
    rated = store.load("ratings").groupBy("user_chat_id").agg(F.count("*").alias("ratings"))
    return store.load("users").join(
        rated, F.col("chat_id") == F.col("user_chat_id"), "left").drop("user_chat_id", "id", "user_id", "created_at")


def _landing(v) -> dict[str, str]:
    return {"atom": _land_atom(v), "search_lines": _land_search(v), "pubmed": _land_pubmed(v)}


@query
def ingest(v):
    store = TableStore(v.spark, scratch_path(v.spark, "store"))
    run_ingest(store, _landing(v), dt.date.fromisoformat(AS_OF), STAMP, DAYS_BACK, CATEGORIES)
    return store.load("papers").select("id", "title_hash", "source")


@query
def daily_digest(v):
    """A run over a store with half of the papers, models of some users, old scores and a log of sent papers."""
    # Several steps read these: derived once, not by sorting all events for each of them.
    v["ratings_fx"], v["scores_fx"] = written(v["ratings_fx"], "ratings"), written(v["scores_fx"], "scores")
    store = _store(v, "users", "ratings", "half_papers", "paper_scores", "digest_log")
    models, meta = _lift_models(v)
    none = F.lit(None).cast("double")
    usable = meta.where(F.col("intercept") > 0).withColumns({"n": F.lit(0).cast("bigint"), "cv_auc_mean": none, "cv_auc_std": none})
    retrain.save_models(store, models.join(usable.select("user_id"), "user_id", "left_semi"), usable)
    run = daily.daily_digest(store, _landing(v), dt.date.fromisoformat(AS_OF), scoring.overlap_scorer,
                             days_back=DAYS_BACK, categories=CATEGORIES)
    return run.outbox.select("user_id", "chat_id", *big("position"), "kind", "paper_id", "text")


@query
def retrain_all(v):
    report, _ = retrain.retrain_all(_store(v, "users", "ratings", "papers"))
    return report


@query
def retrain_all_optimum(v):
    """The stored models of the active users after a run, with the ratings that count for each, and whether an AUC is stored."""
    store = _store(v, "users", "ratings", "all_papers")
    retrain.retrain_all(store)
    models, meta = retrain.load_models(store)
    found = _at_the_optimum(_training(v).drop("text"), _words(v), models, meta, ["user_id"])
    return found.join(meta.select("user_id", F.col("cv_auc_mean").between(0, 1).alias("has_auc")), "user_id")
