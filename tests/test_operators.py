"""Operators on small frames, against plain Python."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dailyfolio import schemas
from dailyfolio.operators import digest, papers, ranking, scoring, settings, upserts, users
from dailyfolio.plans.summary import run_summary

DAY = dt.date(2024, 1, 30)
NOW = dt.datetime(2024, 1, 30)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def hot_rows(n=3000, keys=40, seed=1):
    """(key, id, x): a third of the rows share key 0, the ids are shuffled."""
    rnd = random.Random(seed)
    ids = list(range(n))
    rnd.shuffle(ids)
    return [(0 if i % 3 == 0 else rnd.randrange(1, keys), ids[i], rnd.randrange(50)) for i in range(n)]


def test_top_n_by_equals_plain_ranking(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "k int, id int, x int")
    got = ranking.top_n_by(df, ["k"], [F.col("x").desc(), F.col("id").asc()], F.col("k") % 7 + 1, rank="r")
    want = []
    groups = defaultdict(list)
    for k, i, x in data:
        groups[k].append((-x, i))
    for k, g in groups.items():
        want += [(k, i, pos + 1) for pos, (_, i) in enumerate(sorted(g)[: k % 7 + 1])]
    assert rows(got, "k", "id", "r") == sorted(want)


def test_keep_ranked_beyond_the_pruning_limit(spark):
    df = spark.createDataFrame(hot_rows(4000), "k int, id int, x int")
    got = ranking.keep_ranked(df, ["k"], [F.col("id").asc()], 1200)
    want = defaultdict(list)
    for k, i, _ in sorted(hot_rows(4000), key=lambda r: r[1]):
        if len(want[k]) < 1200:
            want[k].append(i)
    assert rows(got, "k", "id") == sorted((k, i) for k, g in want.items() for i in g)


@pytest.mark.parametrize("chunk", [7, 100, 10**6])
def test_numbered_and_last_before(spark, chunk):
    data = hot_rows(800)
    df = spark.createDataFrame(data, "k int, id int, x int")
    numbered = rows(ranking.numbered(df, ["k"], "id", "pos", chunk), "k", "id", "pos")
    last = rows(ranking.last_before(df, ["k"], "id", F.when(F.col("x") > 40, F.col("x")), "near", chunk)
                .fillna(-1, ["near"]), "k", "id", "near")
    want_n, want_l, count, seen = [], [], defaultdict(int), {}
    for k, i, x in sorted(data, key=lambda r: r[1]):
        count[k] += 1
        want_n.append((k, i, count[k]))
        want_l.append((k, i, seen.get(k, -1)))
        if x > 40:
            seen[k] = x
    assert numbered == sorted(want_n)
    assert last == sorted(want_l)


def test_dedup_first_prefers_earlier_sources(spark):
    data = [("s2:1", "A Title", 1, 0), ("arxiv:1", "a title!", 0, 9), ("pm:1", "Other", 2, 0), ("pm:2", "", 2, 1), ("pm:3", "?", 2, 2)]
    df = spark.createDataFrame(data, "id string, title string, s int, p int").withColumn("arrival", F.struct("s", "p"))
    assert rows(ranking.dedup_first(df), "id") == [("arxiv:1",), ("pm:1",), ("pm:2",)]


def test_new_papers_and_canonical_ids(spark):
    batch = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, title_hash string")
    stored = spark.createDataFrame([("z", "h1"), ("y", "h9")], "id string, title_hash string")
    assert rows(papers.new_papers(batch, stored), "id") == [("b",)]
    assert rows(papers.canonical_ids(batch, stored), "id", "title_hash") == [("b", "h2"), ("z", "h1")]


def test_resolve_settings_zero_and_null(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (2, 0, 0, Decimal("0.0"), "p"), (3, 7, 3, Decimal("4.5"), "")],
        "id int, max_papers int, digest_frequency int, min_rating decimal(3,1), keyword_profile string")
    assert rows(users.resolve_settings(df), "id", "max_papers", "digest_frequency", "min_rating", "keyword_profile") == [
        (1, 10, 1, Decimal("6.0"), ""), (2, 10, 1, Decimal("0.0"), "p"), (3, 7, 3, Decimal("4.5"), "")]
    assert rows(users.has_profile(df), "id") == [(2,)]


def test_due_users_and_schedule(spark):
    df = spark.createDataFrame(
        [(1, None, 0), (2, DAY, 3), (3, DAY + dt.timedelta(1), 1)], "chat_id int, next_digest_date date, digest_frequency int")
    due = users.due_users(df, DAY)
    assert rows(users.advance_schedule(due, DAY), "chat_id", "next_digest_date") == [
        (1, DAY + dt.timedelta(1)), (2, DAY + dt.timedelta(3))]


def test_upsert_scores_keeps_time_and_old_values(spark):
    store = spark.createDataFrame(
        [("p", 1, Decimal("5"), Decimal("9"), Decimal("6.6"), "old", dt.datetime(2024, 1, 1))], schemas.PAPER_SCORES)
    batch = spark.createDataFrame([("p", 1, 8.0, None, None), ("q", 1, 7.125, None, "new")],
                                  "paper_id string, user_id bigint, llm_score double, pref_score double, llm_explanation string")
    once = upserts.upsert_scores(store, batch, NOW)
    want = [("p", Decimal("8.00"), Decimal("9.00"), Decimal("8.40"), "old", dt.datetime(2024, 1, 1)),
            ("q", Decimal("7.13"), None, Decimal("7.13"), "new", NOW)]
    cols = ("paper_id", "llm_score", "pref_score", "final_score", "llm_explanation", "scored_at")
    assert sorted(map(tuple, once.select(*cols).collect())) == want
    assert sorted(map(tuple, upserts.upsert_scores(once, batch, dt.datetime(2025, 1, 1)).select(*cols).collect())) == want


def test_upsert_papers_last_wins_and_fetched_at_survives(spark):
    store = spark.createDataFrame([("a", "t", "", [], DAY, "s", None, "u", None, "h", dt.datetime(2024, 1, 1))], schemas.PAPERS)
    batch = spark.createDataFrame(
        [("a", "t1", "h1", 1), ("a", "t2", "h2", 2), ("b", "t3", "h3", 3)], "id string, title string, title_hash string, arrival int",
    ).selectExpr("*", "'' abstract", "array('x') authors", "date'2024-01-30' published_date", "'s' source",
                 "cast(null as string) venue", "'u' url", "cast(null as string) pdf_url")
    got = upserts.upsert_papers(store, batch, NOW)
    assert rows(got, "id", "title", "fetched_at") == [("a", "t2", dt.datetime(2024, 1, 1)), ("b", "t3", NOW)]


def test_ratings_first_and_last(spark):
    make = lambda data: spark.createDataFrame([(i, c, p, s, NOW) for i, c, p, s in data], schemas.RATINGS)
    store, batch = make([(1, 7, "p", 5)]), make([(2, 7, "p", 1), (3, 7, "q", 10), (4, 7, "q", 1)])
    assert rows(upserts.insert_ratings(store, batch), "id") == [(1,), (3,)]
    assert rows(upserts.insert_ratings(store, batch, keep="last"), "id") == [(2,), (4,)]


def test_log_sent_is_idempotent(spark):
    store = spark.createDataFrame([(1, "p", dt.datetime(2024, 1, 1))], schemas.DIGEST_LOG)
    sent = spark.createDataFrame([(1, "p"), (1, "q"), (1, "q")], "user_id bigint, paper_id string")
    once = upserts.log_sent(store, sent, NOW)
    assert rows(once, "paper_id", "sent_at") == [("p", dt.datetime(2024, 1, 1)), ("q", NOW)]
    assert once.count() == upserts.log_sent(once, sent, NOW).count()


def _digest_case(spark):
    scores = [(1, f"p{i:02d}", Decimal("7") + Decimal(i) / 100, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(20)]
    df = spark.createDataFrame(scores, "user_id bigint, paper_id string, final_score decimal(4,2), scored_at timestamp") \
        .withColumn("llm_explanation", F.lit(""))
    log = spark.createDataFrame([(1, f"p{i:02d}", NOW) for i in range(10, 20)], schemas.DIGEST_LOG)
    items = spark.createDataFrame([(f"p{i:02d}", DAY - dt.timedelta(days=i % 2 * 5)) for i in range(20)], "id string, published_date date") \
        .selectExpr("*", "id title", "'' abstract", "array('A') authors", "'u' url", "'' pdf_url", "'' venue", "'arxiv' source")
    config = spark.createDataFrame([(1, Decimal("6.0"), 1)], "user_id bigint, min_rating decimal(3,1), max_papers int")
    return df, log, items, config


def test_sent_rows_use_up_the_pool(spark):
    df, log, items, config = _digest_case(spark)
    # The pool of 10 holds exactly the sent papers, so nothing is left to send ...
    assert digest.unsent_digest(df, log, items, config, DAY).count() == 0
    # ... unless sent papers are removed first; the newest recent one is then picked.
    clean = digest.unsent_digest(df, log, items, config, DAY, pool_before_anti=False)
    assert rows(clean, "paper_id", "position") == [("p08", 1)]


def test_digest_is_bounded_and_never_resent(spark):
    df, log, items, config = _digest_case(spark)
    config = config.withColumn("max_papers", F.lit(3))
    first = digest.unsent_digest(df, log.limit(0), items, config, DAY)
    assert rows(first, "position", "paper_id") == [(1, "p18"), (2, "p16"), (3, "p14")]
    sent = upserts.log_sent(log.limit(0), first, NOW)
    second = digest.unsent_digest(df, sent, items, config, DAY)
    assert second.count() == 3 and not set(rows(first, "paper_id")) & set(rows(second, "paper_id"))


def test_scorer_job(spark):
    ranked = spark.createDataFrame([(1, f"p{i:02d}", i + 1) for i in range(12)], "user_id bigint, paper_id string, rank int")
    items = spark.createDataFrame([(f"p{i:02d}", f"graph topic {i}", ["A"], "x" * 500) for i in range(12)],
                                  "id string, title string, authors array<string>, abstract string")
    people = spark.createDataFrame([(1, "graph", Decimal("1.0"))], "user_id bigint, keyword_profile string, min_rating decimal(3,1)")
    requests = scoring.score_requests(ranked, items, people)
    assert rows(requests, "batch_no", "n") == [(0, 10), (1, 2)]
    text = requests.where("batch_no = 1").first()["request"]
    assert text.startswith("Researcher interests: graph\n\nPapers to evaluate:\n[1] graph topic 10\nAuthors: A\nAbstract: xxx")
    assert "...\n\n[2] graph topic 11" in text and text.endswith("a JSON array with 2 elements, one per paper, in the same order.")

    def flaky(request):
        if "with 2 elements" in request:
            raise RuntimeError("unavailable")
        return scoring.overlap_scorer(request)

    assert rows(scoring.apply_scorer(requests, flaky), "batch_no") == [(0,)]
    replies = scoring.apply_scorer(requests, scoring.overlap_scorer)
    assert scoring.score_replies(ranked, requests, replies, people).count() == 12
    short = replies.withColumn("reply", F.when(F.col("batch_no") == 0, F.lit('[{"score": 9}]')).otherwise(F.col("reply")))
    assert rows(scoring.reply_outcomes(requests, short), "status") == [("ok",), ("wrong length",)]
    assert scoring.score_replies(ranked, requests, short, people).count() == 2


def test_milestone_and_empty_digest(spark):
    df, log, items, config = _digest_case(spark)
    found = digest.unsent_digest(df, log.limit(0), items, config, DAY)
    counts = spark.createDataFrame([(1, 11, 30), (2, 12, 30)], "user_id bigint, chat_id bigint, rating_count bigint")
    got = digest.digest_messages(found, counts)
    assert rows(got, "user_id", "position", "kind") == [(1, 0, "header"), (1, 1, "paper"), (1, 2, "milestone")]
    receipts = spark.createDataFrame([(1, 0, True), (1, 1, False)], "user_id bigint, position int, delivered boolean")
    assert digest.delivered_to_log(got, receipts, log, NOW).count() == 0
    assert rows(digest.digest_messages(found, counts, dry_run=True), "kind") == [("header",), ("paper",)]


def test_run_summary(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "source string")
    assert rows(run_summary({"s": a, "t": a.select(F.lit(1).alias("z"))}), "stage", "part", "rows") == [
        ("s", "x", 2), ("s", "y", 1), ("t", "all", 3)]


# --- settings ----------------------------------------------------------------------------

DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def fold_by_hand(start, log):
    """The state machine one update at a time."""
    state = {c: dict(u) for c, u in start.items()}
    for _, ts, chat, text in sorted(log):
        user = state.get(chat)
        if text.startswith("/start"):
            if user is None:
                state[chat] = dict(profile=None, active=True, papers=10, freq=1, next=ts.date(), min=6.0, pending="awaiting_topics")
            continue
        if user is None or text.startswith("/help"):
            continue
        arg = (text.split() + ["", ""])[1]
        if text.startswith("/topics"):
            user["pending"] = "awaiting_topics"
        elif text.startswith("/pause"):
            user["active"] = False
        elif text.startswith("/resume"):
            user["active"] = True
        elif text.startswith("/frequency"):
            n = int(arg) if arg.isdigit() else 0
            if n == 1:
                user.update(freq=1, next=ts.date(), pending=None)
            elif 1 < n <= 365:
                user["pending"] = f"awaiting_frequency_start_day|{n}"
        elif text.startswith("/limit"):
            n = int(arg) if arg.isdigit() else 0
            if 1 <= n <= 50:
                user["papers"] = n
        elif text.startswith("/rating"):
            if arg and 0 <= float(arg) <= 10:
                user["min"] = float(arg)
        elif user["pending"] == "awaiting_topics":
            user.update(profile=text.strip(), pending=None, active=True)
        elif user["pending"] and text.strip().lower() in DAYS:
            ahead = (DAYS.index(text.strip().lower()) - ts.isoweekday() % 7) % 7
            user.update(freq=int(user["pending"].split("|")[1]), next=ts.date() + dt.timedelta(days=ahead), pending=None)
    return state


def random_log(n, seed):
    rnd = random.Random(seed)
    texts = ["/start", "/topics", "/pause", "/resume", "/help", "/frequency 1", "/frequency 7", "/frequency 400", "/frequency 30",
             "/limit 5", "/limit 99", "/rating 7.5", "/rating 11", "Monday", " friday ", "someday", "graph learning", "/what"]
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 0 if i % 3 == 0 else rnd.randrange(1, 12), rnd.choice(texts))
            for i in range(n)]


def user_frame(spark, state):
    data = [(i, c, u["profile"], u["active"], u["papers"], u["freq"], u["next"], Decimal(str(u["min"])), u["pending"], NOW)
            for i, (c, u) in enumerate(sorted(state.items()))]
    return spark.createDataFrame(data, schemas.USERS)


def state_of(df):
    return {r["chat_id"]: dict(profile=r["keyword_profile"], active=r["active"], papers=r["max_papers"], freq=r["digest_frequency"],
                               next=r["next_digest_date"], min=float(r["min_rating"]), pending=r["pending_action"]) for r in df.collect()}


START = {c: dict(profile="p", active=True, papers=10, freq=1, next=DAY, min=6.0, pending=p)
         for c, p in ((0, None), (1, "awaiting_topics"), (2, "awaiting_frequency_start_day|3"))}


@pytest.mark.parametrize("seed,chunk", [(1, 10**6), (2, 11), (3, 50)])
def test_settings_fold_matches_the_state_machine(spark, seed, chunk):
    log = random_log(400, seed)
    updates = spark.createDataFrame(log, "update_id bigint, ts timestamp, chat_id bigint, text string")
    got = settings.settings_from_log(updates, user_frame(spark, START), chunk)
    assert state_of(got) == fold_by_hand(START, log)
    ids = [r["id"] for r in got.collect()]
    assert len(set(ids)) == len(ids) and None not in ids


def test_settings_fold_in_pieces(spark):
    log = random_log(300, 9)
    table = user_frame(spark, START)
    for piece in (log[:80], log[80:81], log[81:]):
        updates = spark.createDataFrame(piece, "update_id bigint, ts timestamp, chat_id bigint, text string")
        table = spark.createDataFrame(settings.settings_from_log(updates, table).collect(), schemas.USERS)
    assert state_of(table) == fold_by_hand(START, log)
