"""The daily digest for all users that are due."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.operators.digest import (
    POOL_FACTOR, delivered_to_log, digest_messages, dry_run_digest, rating_counts, recent_first, unsent_digest)
from dailyfolio.operators.papers import canonical_ids
from dailyfolio.operators.prefmodel import attach_pref, pref_scores
from dailyfolio.operators.ranking import keep_ranked
from dailyfolio.operators.retrieval import TOP_N, build_index, candidates
from dailyfolio.operators.scoring import (
    BATCH_SIZE, Scorer, ask, reply_outcomes, score_replies, score_requests)
from dailyfolio.operators.upserts import update_users, upsert_scores
from dailyfolio.operators.users import (
    active_users, advance_schedule, due_users, has_profile, resolve_settings, user_by_chat)
from dailyfolio.plans.ingest import fetch, store_new
from dailyfolio.plans.retrain import load_models
from dailyfolio.plans.summary import run_summary
from dailyfolio.session import scratch_path, written
from dailyfolio.sources.log import Snapshot
from dailyfolio.sources.tables import Staged, TableStore, Write


@dataclass(frozen=True)
class DigestRun:
    """What a run produced: the messages to send and its counters."""

    outbox: DataFrame
    summary: DataFrame


# Newest scores of a user that the pool holds: enough for the largest digest.
POOL_ROWS = POOL_FACTOR * 50 + 100


def pool_is_fresh(at: Snapshot) -> bool:
    """Whether the pool was kept in every commit of scores, as ``store_scores`` does."""
    return 0 < at.changed.get("paper_scores", 0) == at.changed.get("score_pool", 0)


def _pool(store: TableStore, at: Snapshot, rows: DataFrame, pool_rows: int) -> Write:
    """The pool after ``rows`` have been stored: of each of their users the newest scores, old and new.

    Written for these users only; made from all scores where it was not kept before.
    """
    fresh = pool_is_fresh(at)
    held = store.load("score_pool", at=at).join(rows.select("user_id").distinct(), "user_id", "left_semi") \
        if fresh else store.load("paper_scores", at=at)
    others = held.join(rows.select("paper_id", "user_id"), ["paper_id", "user_id"], "left_anti")
    newest = keep_ranked(others.unionByName(rows), ["user_id"], recent_first(), pool_rows)
    return Write("score_pool", "delta" if fresh else "full", newest)


def recent_scores(store: TableStore, at: Snapshot, settings: DataFrame, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Scores of the users in ``settings`` that hold their latest ``POOL_FACTOR * max_papers`` passing ones.

    They come from the pool. A full pool may lack scores of its oldest moment or before, so only what is newer counts; users
    for whom that is too little, which takes many scores below their minimum, are looked up among all scores.
    """
    if not pool_is_fresh(at):
        return store.load("paper_scores", at=at)
    users = settings.select("user_id", "min_rating", "max_papers")
    pool = store.load("score_pool", at=at).join(users.select("user_id"), "user_id", "left_semi")
    sizes = pool.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.min("scored_at").alias("_oldest"))
    usable = pool.join(sizes, "user_id").where((F.col("_n") < pool_rows) | (F.col("scored_at") > F.col("_oldest")))
    passing = usable.join(users, "user_id").groupBy("user_id").agg(
        F.count_if(F.col("final_score") >= F.col("min_rating")).alias("_passing"))
    short = written(sizes.where(F.col("_n") >= pool_rows).join(users, "user_id").join(passing, "user_id", "left")
                    .where(F.coalesce("_passing", F.lit(0)) < POOL_FACTOR * F.col("max_papers")).select("user_id"), "short-pools")
    usable = usable.drop("_n", "_oldest")
    if short.isEmpty():
        return usable
    return usable.join(short, "user_id", "left_anti").unionByName(
        store.load("paper_scores", at=at).join(short, "user_id", "left_semi"))


def store_scores(store: TableStore, scored: DataFrame, as_of: dt.date, pool_rows: int = POOL_ROWS) -> None:
    """Upsert scores. Only the scored pairs are written, and the pools of their users; days that hold none of them are not
    read in full."""
    now = dt.datetime.combine(as_of, dt.time())
    pairs = scored.select("paper_id", "user_id")

    def make(at: Snapshot) -> list[Write]:
        days = store.parts_with("paper_scores", pairs, at)
        known = store.load("paper_scores", days, at).join(pairs, pairs.columns, "left_semi")
        rows = written(upsert_scores(known, scored, now), "new-scores")
        return [Write("paper_scores", "delta", rows), _pool(store, at, rows, pool_rows)]

    store.update(["paper_scores", "score_pool"], make)


def daily_digest(store: TableStore, landing: Mapping[str, str], as_of: dt.date, scorer: Scorer,
                 dry_run: bool = False, chat_id: int | None = None, days_back: int = 1,
                 top_n: int = TOP_N, categories: Sequence[str] = (),
                 defaults: dict | None = None) -> DigestRun | None:
    """Ingest, retrieve, re-score, select and render for every due user.

    Returns None when nobody is due or nothing was fetched; the schedule then stays as it
    is. A dry run writes to no table.
    """
    now = dt.datetime.combine(as_of, dt.time())
    users = store.load("users")
    chosen = active_users(users) if chat_id is None else user_by_chat(users, chat_id)
    due = due_users(chosen, as_of)
    if due.isEmpty():
        return None
    batch = fetch(store.spark, landing, as_of, days_back, categories)
    if batch is None:
        return None
    batch = written(batch, "batch")
    if batch.isEmpty():
        return None
    stages = {"fetched": batch, "users due": due}
    if not dry_run:
        stages["new"] = store_new(store, batch, now)
        batch = canonical_ids(batch, store.load("papers"))

    due = resolve_settings(written(due, "due"), defaults).withColumn("user_id", F.col("id"))
    settings = has_profile(due)
    index = build_index(batch).materialize()
    models, meta = load_models(store)
    ranked = written(candidates(index, settings, models, meta, top_n), "candidates")
    requests = written(score_requests(ranked, batch, settings), "requests")
    # The day's ledger outlives this run: a second one asks only for what the first did not get.
    ledger = scratch_path(store.spark, "replies") if dry_run else f"{store.root}/_replies/{as_of.isoformat()}"
    replies = written(ask(requests, scorer, ledger), "replies")
    scored = written(score_replies(ranked, requests, replies, settings, BATCH_SIZE), "scored")
    stages["requests"] = reply_outcomes(requests, replies)
    stages["passed"] = scored

    if dry_run:
        digest = dry_run_digest(scored, batch, settings)
    else:
        prefs = pref_scores(scored.where("has_model"), index.counts, models, meta)
        full = attach_pref(scored, prefs)
        store_scores(store, written(full, "full-scores"), as_of)
        at = store.snapshot()
        since_day = (as_of - dt.timedelta(days=days_back)).isoformat()
        recent = [p for p in at.parts("papers") if p >= since_day and p != "none"]
        digest = unsent_digest(recent_scores(store, at, settings), store.load("digest_log", at=at),
                               store.load("papers", recent, at), settings, as_of, days_back)
    counts = rating_counts(store.load("ratings"), settings)
    outbox = digest_messages(digest, counts, dry_run)
    if dry_run:
        outbox = written(outbox, "outbox")
    else:
        ready, schedule = store.stage("outbox", "full", outbox), advance_schedule(due, as_of)

        def make(at: Snapshot) -> list[Write | Staged]:
            # Messages and schedule stand or fall together; settings that changed meanwhile are kept.
            theirs = store.load("users", at=at).join(schedule.select("chat_id"), "chat_id", "left_semi")
            return [ready, Write("users", "delta", update_users(theirs, schedule))]

        store.update(["users"], make)
        outbox = store.load("outbox")
    stages["messages"] = outbox
    return DigestRun(outbox, run_summary(stages))


def confirm_delivery(store: TableStore, receipts: DataFrame, sent_at: dt.datetime) -> None:
    """Log the papers that were delivered, so that they are never sent again."""
    store.update(["digest_log"], lambda at: [Write("digest_log", "add", delivered_to_log(
        store.load("outbox", at=at), receipts, store.load("digest_log", at=at), sent_at))])
