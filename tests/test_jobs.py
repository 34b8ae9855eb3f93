"""Landing files, table store, streams and whole jobs."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from dailyfolio import schemas
from dailyfolio.operators import prefmodel, scoring
from dailyfolio.operators.settings import settings_from_log
from dailyfolio.plans import daily, feedback, retrain
from dailyfolio.plans.ingest import fetch
from dailyfolio.sources import feeds
from dailyfolio.sources.tables import ConcurrentWrite, TableStore, Write
from dailyfolio.sources.updates import message_updates, read_updates
from dailyfolio.streaming.ratings import keep_rating_counts, rating_counts_stream, rating_stream
from dailyfolio.streaming.settings import settings_stream

DAY = dt.date(2024, 1, 30)
NOW = dt.datetime(2024, 1, 30)

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/2401.00001v3</id><published>2024-01-30T23:30:00Z</published>
<title> Graph
 Nets </title><summary>All
about graphs.</summary><author><name>A</name></author><author><name>B</name></author><author><name>C</name></author>
<author><name>D</name></author><author><name>E</name></author><author><name>F</name></author>
<link href="http://arxiv.org/abs/x" type="text/html"/><link href="http://arxiv.org/pdf/x" type="application/pdf"/></entry>
<entry><id>http://arxiv.org/abs/2401.00002v1</id><published>2024-01-29T01:00:00Z</published><title>Second</title><summary>s</summary>
<author><name>A</name></author><link href="u" type="text/html"/></entry>
<entry><id>http://arxiv.org/abs/2401.00003v1</id><published>2024-01-20T01:00:00Z</published><title>Too old</title><summary>s</summary></entry>
<entry><id>http://arxiv.org/abs/2401.00004v1</id><published>soon</published><title>No date</title><summary>s</summary></entry>
<entry><id>http://arxiv.org/abs/2401.00005v1</id><title>No date either</title><summary>s</summary></entry>
<entry><id>http://arxiv.org/abs/2401.00006v1</id><published>2024-01-29T00:00:00Z</published><title>graph nets!</title><summary>copy</summary></entry>
</feed>"""

SEARCH = {"data": [
    {"paperId": "aa", "title": " Graph nets ", "abstract": None, "publicationDate": "2024-01-30", "venue": " ",
     "journal": {"name": " J "}, "authors": [{"name": n} for n in "ABCDEF"], "externalIds": None, "openAccessPdf": {"url": "http://p"}},
    {"paperId": "bb", "title": "Linked", "abstract": "x", "publicationDate": "2024-01-30", "venue": "V", "authors": None,
     "externalIds": {"ArXiv": "2401.7"}, "openAccessPdf": None},
    {"paperId": "cc", "title": "Bad date", "publicationDate": "2024-02-31"},
    {"paperId": "dd", "title": "Year only", "year": 2024},
    {"paperId": "ee", "title": "No date"},
    {"paperId": "", "title": "No id", "publicationDate": "2024-01-30"},
    {"title": "Id missing", "publicationDate": "2024-01-30"},
    {"paperId": "ff", "title": "Short date", "publicationDate": "2024"},
    {"paperId": "gg", "title": None, "publicationDate": "2024-01-29", "journal": None},
]}


def article(pmid, title, date, extra=""):
    return f"""<PubmedArticle><MedlineCitation>{f'<PMID Version="1">{pmid}</PMID>' if pmid else ''}
<Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue><Title> Journal A </Title></Journal>
<ArticleTitle>{title}</ArticleTitle>{extra}</Article></MedlineCitation></PubmedArticle>"""


PUBMED = "<?xml version='1.0'?><PubmedArticleSet>" + "".join([
    article(1, "First", "<Year>2024</Year><Month>Jan</Month><Day>30</Day>",
            "<Abstract><AbstractText Label='AIM'>why</AbstractText><AbstractText>how</AbstractText></Abstract>"
            "<AuthorList><Author><LastName>Li</LastName><ForeName>Bo</ForeName></Author><Author><ForeName>X</ForeName></Author>"
            "<Author><LastName>Solo</LastName></Author><Author><CollectiveName>G</CollectiveName></Author>"
            "<Author><LastName>Five</LastName></Author><Author><LastName>Six</LastName></Author></AuthorList>"),
    article(2, "Role of <i>BRCA1</i> in cancer", "<Year>2024</Year><Month>01</Month><Day>29</Day>"),
    article(3, "No day", "<Year>2024</Year><Month>february</Month>"),
    article(4, "Bad month", "<Year>2024</Year><Month>Xyz</Month>"),
    article(5, "No year", "<MedlineDate>2024 Jan</MedlineDate>"),
    article(6, "", "<Year>2024</Year><Month>1</Month><Day>30</Day>"),
    article(None, "No id", "<Year>2024</Year><Month>1</Month><Day>30</Day>"),
    article(7, "Bad day", "<Year>2024</Year><Month>2</Month><Day>31</Day>"),
]) + "</PubmedArticleSet>"


@pytest.fixture()
def landing(tmp_path):
    atom = tmp_path / "atom" / "category=cs.LG"
    atom.mkdir(parents=True)
    (atom / "feed.xml").write_text(ATOM)
    (tmp_path / "search").mkdir()
    (tmp_path / "search" / "page.json").write_text(json.dumps(SEARCH, indent=1))
    (tmp_path / "pubmed").mkdir()
    (tmp_path / "pubmed" / "set.xml").write_text(PUBMED)
    return {k: str(tmp_path / k) for k in ("atom", "search", "pubmed")}


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_atom(spark, landing):
    got = by_id(feeds.read_atom(spark, landing["atom"], DAY, 1, ["cs.LG"]))
    assert sorted(got) == ["arxiv:2401.00001", "arxiv:2401.00002"]
    first = got["arxiv:2401.00001"]
    assert (first["title"], first["abstract"], first["authors"]) == ("Graph  Nets", "All about graphs.", list("ABCDE"))
    assert (first["published_date"], first["pdf_url"]) == (DAY, "http://arxiv.org/pdf/x")
    assert got["arxiv:2401.00002"]["pdf_url"] == "https://arxiv.org/pdf/2401.00002"


def test_a_busy_day_is_read_whole_and_newest_first(spark, tmp_path):
    entry = ("<entry><id>http://arxiv.org/abs/2401.{0:05d}v1</id><published>2024-01-30T{1:02d}:{2:02d}:00Z</published>"
             "<title>Title {0}</title><summary>s</summary></entry>")
    (tmp_path / "feed.xml").write_text(
        "<feed>" + "".join(entry.format(i, i // 60, i % 60) for i in range(1, 131)) + "</feed>")
    assert feeds.read_atom(spark, str(tmp_path), DAY, 1).count() == 130
    newest = feeds.read_atom(spark, str(tmp_path), DAY, 1, per_feed=5)
    assert sorted(r["id"] for r in newest.collect()) == [f"arxiv:2401.{i:05d}" for i in range(126, 131)]


def test_pubmed_responses_are_not_cut(spark, tmp_path):
    one = ("<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T {0}</ArticleTitle><Journal>"
           "<JournalIssue><PubDate><Year>2024</Year><Month>Jan</Month><Day>30</Day></PubDate></JournalIssue>"
           "</Journal></Article></MedlineCitation></PubmedArticle>")
    for k in range(2):
        (tmp_path / f"{k}.xml").write_text("<PubmedArticleSet>" + "".join(
            one.format(i) for i in range(100 * k, 100 * k + 100)) + "</PubmedArticleSet>")
    assert feeds.read_pubmed(spark, str(tmp_path), DAY, 1).count() == 200


def test_a_folder_that_has_not_landed_is_an_empty_feed(spark, landing):
    whole = fetch(spark, landing, DAY, 1)
    assert fetch(spark, landing | {"pubmed": "/nowhere/at/all"}, DAY, 1).count() < whole.count()
    assert fetch(spark, {"atom": "/nowhere/at/all"}, DAY, 1) is None


def test_search(spark, landing):
    got = by_id(feeds.read_search_json(spark, landing["search"], DAY, 1))
    assert sorted(got) == ["arxiv:2401.7", "s2:aa", "s2:gg"]
    assert (got["s2:aa"]["title"], got["s2:aa"]["abstract"], got["s2:aa"]["venue"]) == ("Graph nets", "", "J")
    assert got["s2:aa"]["authors"] == list("ABCDE") and got["s2:aa"]["pdf_url"] == "http://p"
    assert got["arxiv:2401.7"]["url"] == "https://arxiv.org/abs/2401.7" and got["arxiv:2401.7"]["authors"] == []
    assert got["s2:gg"]["title"] == "" and got["s2:gg"]["venue"] is None
    assert "s2:dd" in by_id(feeds.read_search_json(spark, landing["search"], DAY, 29))


def test_pubmed(spark, landing):
    got = by_id(feeds.read_pubmed(spark, landing["pubmed"], DAY, 1))
    assert sorted(got) == ["pm:1", "pm:2", "pm:3"]
    assert got["pm:1"]["abstract"] == "AIM: why how" and got["pm:1"]["venue"] == "Journal A"
    assert got["pm:1"]["authors"] == ["Bo Li", "Solo", "Five"]
    assert got["pm:2"]["title"] == "Role of" and got["pm:3"]["published_date"] == dt.date(2024, 2, 1)


def test_combined_sources_keep_the_first_title(spark, landing):
    batches = [feeds.read_atom(spark, landing["atom"], DAY), feeds.read_search_json(spark, landing["search"], DAY),
               feeds.read_pubmed(spark, landing["pubmed"], DAY)]
    got = by_id(feeds.combine(*batches))
    assert "arxiv:2401.00001" in got and "s2:aa" not in got and len(got) == 7


def test_store_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    row = lambda p: spark.createDataFrame([(1, p, NOW)], schemas.DIGEST_LOG)
    assert store.load("digest_log").count() == 0
    store.append("digest_log", row("a"))
    store.append("digest_log", row("b"), "b7")
    store.append("digest_log", row("c"), "b7")
    (tmp_path / "digest_log" / "left-by-a-failed-job").mkdir()
    assert sorted(r["paper_id"] for r in store.load("digest_log").collect()) == ["a", "b"]
    store.compact("digest_log")
    store.append("digest_log", row("d"))
    store.append("digest_log", row("e"), "b7")
    assert sorted(r["paper_id"] for r in store.load("digest_log").collect()) == ["a", "b", "d"]


def write_updates(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def rate(i, chat, data):
    return {"update_id": i, "ts": "2024-01-30T10:00:00Z", "callback_query": {"id": str(i), "from": {"id": chat}, "data": data}}


def say(i, chat, text):
    return {"update_id": i, "ts": "2024-01-30T10:00:00Z", "message": {"chat": {"id": chat}, "from": {"id": chat}, "text": text}}


def stored_papers(spark, ids):
    return spark.createDataFrame([(i, i, "graph text", ["A"], DAY, "arxiv", None, "u", None, i, NOW) for i in ids], schemas.PAPERS)


def test_feedback_stream(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.replace("papers", stored_papers(spark, ["p", "q"]))
    feed, checkpoint = tmp_path / "feed", str(tmp_path / "check")
    write_updates(feed / "1.json", [
        say(1, 7, "/start"), say(2, 7, " graphs "), rate(3, 7, "rate|p|5"), rate(4, 7, "rate|p|1"), rate(5, 7, "rate|zz|5"),
        rate(6, 7, "rate|p|7"), "not json", {"update_id": 8}, {**rate(9, 7, "rate|q|10"), **{"message": say(9, 7, "/pause")["message"]}}])
    for q in feedback.feedback_stream(store, str(feed), checkpoint):
        q.awaitTermination()
    write_updates(feed / "2.json", [rate(11, 7, "rate|q|1"), say(12, 7, "/frequency 7"), rate(13, 8, "rate|q|1"), say(14, 9, "/limit 3")])
    for q in feedback.feedback_stream(store, str(feed), checkpoint):
        q.awaitTermination()
    write_updates(feed / "3.json", [say(15, 7, "Monday")])
    for q in feedback.feedback_stream(store, str(feed), checkpoint):
        q.awaitTermination()
    assert sorted((r["id"], r["user_chat_id"], r["paper_id"], r["score"]) for r in store.load("ratings").collect()) == [
        (3, 7, "p", 5), (9, 7, "q", 10), (13, 8, "q", 1)]
    assert sorted((r["update_id"], r["reason"]) for r in store.load("rejected_ratings").collect()) == [
        (4, "Already rated"), (5, "Unknown paper"), (6, "Invalid score"), (11, "Already rated")]
    (user,) = store.load("users").collect()
    assert (user["chat_id"], user["keyword_profile"], user["active"], user["digest_frequency"], user["next_digest_date"],
            user["pending_action"]) == (7, "graphs", True, 7, dt.date(2024, 2, 5), None)
    kinds = {r["kind"]: r["count"] for r in read_updates(spark, str(feed), stream=False).groupBy("kind").count().collect()}
    assert kinds == {"rating": 7, "message": 5, "bad json": 1, "ignored": 1}
    replayed = settings_from_log(message_updates(read_updates(spark, str(feed), stream=False)), store.empty("users"))
    assert [r["keyword_profile"] for r in replayed.collect()] == ["graphs"]


def test_a_second_feed_with_its_own_checkpoint_loses_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.replace("papers", stored_papers(spark, ["p", "q"]))
    for k, lines in enumerate(([say(1, 7, "/start"), rate(2, 7, "rate|p|5")], [say(11, 8, "/start"), rate(12, 8, "rate|q|1")])):
        write_updates(tmp_path / f"feed{k}" / "1.json", lines)
        for _ in range(2):  # the second start finds nothing new
            for q in feedback.feedback_stream(store, str(tmp_path / f"feed{k}"), str(tmp_path / f"check{k}")):
                q.awaitTermination()
    assert sorted(r["id"] for r in store.load("ratings").collect()) == [2, 12]
    assert sorted(r["chat_id"] for r in store.load("users").collect()) == [7, 8]


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, 7, "p", 5, NOW)], schemas.RATINGS)
    for _ in range(2):
        store.append("ratings", rows, "abc.0")
    assert store.load("ratings").count() == 1


def test_competing_writers_and_failed_writes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), compact_after=3)
    row = lambda i: spark.createDataFrame([(i, 7, f"p{i}", 5, NOW)], schemas.RATINGS)
    store.replace("ratings", row(0))
    base = store.version("ratings")
    store.append("ratings", row(1))
    with pytest.raises(ConcurrentWrite):
        store.replace("ratings", row(9), base=base)
    broken = row(2).withColumn("id", F.raise_error(F.lit("stop")).cast("bigint"))
    with pytest.raises(Exception, match="stop"):
        store.append("ratings", broken, "t.1")
    assert sorted(r["id"] for r in store.load("ratings").collect()) == [0, 1]
    store.append("ratings", row(2), "t.1")  # the replay of the failed batch is written
    for i in (3, 4, 5):
        store.append("ratings", row(i))
    assert sorted(r["id"] for r in store.load("ratings").collect()) == [0, 1, 2, 3, 4, 5]
    assert len(store.snapshot().segments("ratings")) <= 3
    store.append("ratings", row(2), "t.1")  # still known after compaction
    assert store.load("ratings").count() == 6


def meta_row(spark, user, intercept):
    return spark.createDataFrame([(user, intercept, 30, None, None)], schemas.MODEL_META)


def model_row(spark, user, *terms):
    return spark.createDataFrame([(user, t, 1.0, 1.0) for t in terms], schemas.MODELS)


def test_a_crash_between_two_tables_leaves_both_as_they_were(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    retrain.save_models(store, model_row(spark, 1, "old", "older"), meta_row(spark, 1, 0.1))
    retrain.save_models(store, model_row(spark, 2, "other"), meta_row(spark, 2, 0.2))
    stage = TableStore.stage

    def dies(self, name, kind, rows):
        if name == "model_meta":
            raise RuntimeError("lost")
        return stage(self, name, kind, rows)

    monkeypatch.setattr(TableStore, "stage", dies)
    with pytest.raises(RuntimeError, match="lost"):
        retrain.save_models(store, model_row(spark, 1, "new"), meta_row(spark, 1, 0.9))
    monkeypatch.undo()
    state = lambda: tuple(sorted(map(tuple, t.select(*c).collect())) for t, c in zip(
        retrain.load_models(store), (("user_id", "term"), ("user_id", "intercept"))))
    assert state() == ([(1, "old"), (1, "older"), (2, "other")], [(1, 0.1), (2, 0.2)])
    retrain.save_models(store, model_row(spark, 1, "new"), meta_row(spark, 1, 0.9))
    assert state() == ([(1, "new"), (2, "other")], [(1, 0.9), (2, 0.2)])
    store.compact("models")
    assert state() == ([(1, "new"), (2, "other")], [(1, 0.9), (2, 0.2)])


def test_an_update_is_made_again_when_another_writer_comes_between(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    other, seen = TableStore(spark, str(tmp_path / "store")), []

    def pause(at):
        users = store.load("users", at=at)
        seen.append(at.number)
        if len(seen) < 3:  # the other writer changes another column of the same row, twice
            other.merge("users", other.load("users").withColumn("max_papers", F.lit(len(seen) + 4)))
        return [Write("users", "delta", users.withColumn("active", F.lit(False)))]

    store.update(["users"], pause)
    (user,) = store.load("users").collect()
    assert len(seen) == 3 and (user["active"], user["max_papers"]) == (False, 6)


def test_appends_of_many_writers_all_count(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "store")
    row = lambda i: spark.createDataFrame([(i, i % 5, f"p{i}", 5, NOW)], schemas.RATINGS)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: TableStore(spark, root, compact_after=8).append("ratings", row(i), f"feed{i}.0"), range(24)))
    store = TableStore(spark, root)
    assert sorted(r["id"] for r in store.load("ratings").collect()) == list(range(24))


def test_parts_are_pruned_and_merged_rows_replace_older_ones_in_any_part(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    old = stored_papers(spark, ["a", "b", "c"])
    store.append("papers", old)
    moved = stored_papers(spark, ["b"]).withColumn("published_date", F.lit(DAY + dt.timedelta(days=3)))
    files = set((tmp_path / "store" / "papers").rglob("*.parquet"))
    store.merge("papers", moved)
    assert len(set((tmp_path / "store" / "papers").rglob("*.parquet")) - files) == 1
    assert {r["id"]: r["published_date"] for r in store.load("papers").collect()} == {
        "a": DAY, "c": DAY, "b": DAY + dt.timedelta(days=3)}
    assert sorted(r["id"] for r in store.load("papers", [DAY.isoformat()]).collect()) == ["a", "c"]
    assert [r["id"] for r in store.load("papers", ["2024-02-02"]).collect()] == ["b"]
    assert store.load("papers", ["1999-01-01"]).count() == 0
    read = store.load("papers", ["2024-02-02"])._jdf.queryExecution().optimizedPlan().toString()
    assert store.snapshot().parts("papers") == ["2024-01-30", "2024-02-02"] and "Relation" in read
    snapshot = store.snapshot()
    store.replace("papers", stored_papers(spark, ["z"]))
    assert store.load("papers", at=snapshot).count() == 3 and store.load("papers").count() == 1


def test_scores_of_a_day_stay_readable_and_only_scored_pairs_are_written(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    scored = lambda rows: spark.createDataFrame(rows, "paper_id string, user_id bigint, llm_score double, pref_score double, llm_explanation string")
    daily.store_scores(store, scored([("p", 1, 7.0, None, "x"), ("q", 1, 6.0, 5.0, "y")]), DAY)
    begun = store.load("paper_scores")
    daily.store_scores(store, scored([("p", 1, None, 9.0, None), ("r", 2, 8.0, None, "z")]), DAY + dt.timedelta(days=1))
    rows = {(r["paper_id"], r["user_id"]): r for r in store.load("paper_scores").collect()}
    assert {k: (float(r["llm_score"]), r["scored_at"].date()) for k, r in rows.items()} == {
        ("p", 1): (7.0, DAY), ("q", 1): (6.0, DAY), ("r", 2): (8.0, DAY + dt.timedelta(days=1))}
    assert float(rows["p", 1]["pref_score"]) == 9.0 and begun.count() == 2
    assert store.snapshot().parts("paper_scores") == ["2024-01-30", "2024-01-31"]
    assert sum(spark.read.parquet(f"{store.root}/{s.path}").count() for s in store.snapshot().segments("paper_scores")) == 4


def test_the_pool_gives_the_digest_of_a_full_scan(spark, tmp_path):
    import random
    from decimal import Decimal

    from dailyfolio.operators.digest import unsent_digest

    store, rng = TableStore(spark, str(tmp_path / "store")), random.Random(3)
    ids = [f"p{i:03d}" for i in range(120)]
    papers = stored_papers(spark, ids)
    users = spark.createDataFrame([(1, Decimal("1.0"), 2), (2, Decimal("6.0"), 1), (3, Decimal("9.0"), 2), (4, Decimal("1.0"), 5), (9, Decimal("1.0"), 5)],
                                  "user_id bigint, min_rating decimal(3,1), max_papers int")
    log = spark.createDataFrame([(1, "p001", NOW), (4, "p002", NOW)], schemas.DIGEST_LOG)
    kind = "paper_id string, user_id bigint, llm_score double, pref_score double, llm_explanation string"
    for day in range(4):  # more scores than a pool of 25 holds; some pairs again, with other scores
        rows = {(rng.choice(ids), u): (float(rng.randint(1, 10)), None, "x") for u in (1, 2, 3, 4) for _ in range(3 if u == 4 else 14)}
        daily.store_scores(store, spark.createDataFrame([(*k, *r) for k, r in rows.items()], kind), DAY + dt.timedelta(days=day), 25)
        at = store.snapshot()
        assert daily.pool_is_fresh(at)
        pick = lambda scores: sorted((r["user_id"], r["position"], r["paper_id"]) for r in unsent_digest(
            scores, log, papers, users, DAY, 1).collect())
        whole = pick(store.load("paper_scores", at=at))
        assert pick(daily.recent_scores(store, at, users, 25)) == whole and whole
    sizes = {r["user_id"]: r["count"] for r in store.load("score_pool").groupBy("user_id").count().collect()}
    assert max(sizes.values()) == 25 and set(sizes) == {1, 2, 3, 4}
    store.append("paper_scores", store.load("paper_scores").limit(0))  # a writer that knows no pool
    assert not daily.pool_is_fresh(store.snapshot())
    assert pick(daily.recent_scores(store, store.snapshot(), users, 25)) == whole


def test_one_message_writes_one_row(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    for i in range(3):
        put = dict(id=i + 1, chat_id=11 + i)
        store.append("users", spark.createDataFrame([(put["id"], put["chat_id"], "x", True, None, None, None, None, None, NOW)], schemas.USERS))
    write_updates(tmp_path / "feed" / "1.json", [say(1, 12, "/limit 7")])
    feed = read_updates(spark, str(tmp_path / "feed"))
    settings_stream(feed, store, str(tmp_path / "check")).awaitTermination()
    last = store.snapshot().segments("users")[-1]
    assert last.delta and spark.read.parquet(f"{store.root}/{last.path}").count() == 1
    assert {r["chat_id"]: r["max_papers"] for r in store.load("users").collect()} == {11: None, 12: 7, 13: None}


def test_a_batch_of_ratings_reads_only_the_buckets_of_its_chats(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.replace("papers", stored_papers(spark, ["p"]))
    store.replace("ratings", spark.createDataFrame([(i, i, "p", 5, NOW) for i in range(1, 400)], schemas.RATINGS))
    write_updates(tmp_path / "feed" / "1.json", [rate(1001, 7, "rate|p|5"), rate(1002, 900, "rate|p|5")])
    read, load = [], TableStore.load

    def watched(self, name, parts=None, at=None):
        if name == "ratings":
            read.append(parts)
        return load(self, name, parts, at)

    TableStore.load = watched
    try:
        rating_stream(read_updates(spark, str(tmp_path / "feed")), store, str(tmp_path / "check")).awaitTermination()
    finally:
        TableStore.load = load
    assert len(read) == 1 and len(read[0]) <= 2 < len(store.snapshot().parts("ratings"))
    assert store.load("ratings").count() == 400
    assert [(r["update_id"], r["reason"]) for r in store.load("rejected_ratings").collect()] == [(1001, "Already rated")]


def test_dead_letters_are_kept_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    write_updates(tmp_path / "feed" / "1.json", ["not json", {"update_id": 8}, say(9, 7, "/start")])
    for _ in range(2):
        for q in feedback.feedback_stream(store, str(tmp_path / "feed"), str(tmp_path / "check")):
            q.awaitTermination()
    rows = {r["reason"]: r for r in store.load("dead_letters").collect()}
    assert store.load("dead_letters").count() == 2 and set(rows) == {"bad json", "ignored"}
    assert rows["bad json"]["line"] == "not json" and rows["ignored"]["update_id"] == 8
    assert all(r["file"].endswith("1.json") for r in rows.values())


def test_running_counts_are_merged(spark, tmp_path):
    store, source = TableStore(spark, str(tmp_path / "store")), str(tmp_path / "ratings")
    for k in range(2):
        spark.createDataFrame([(i, i % 2, f"p{i}", 5, NOW) for i in range(5 * k, 5 * k + 5)] + [(90 + k, 7 + k, "p", 5, NOW)], schemas.RATINGS) \
            .coalesce(1).write.mode("append").parquet(source)
        keep_rating_counts(spark.readStream.schema(schemas.RATINGS).parquet(source), store, str(tmp_path / "c")).awaitTermination()
    assert {r["user_chat_id"]: r["rating_count"] for r in store.load("rating_counts").collect()} == {0: 5, 1: 5, 7: 1, 8: 1}
    last = store.snapshot().segments("rating_counts")[-1]
    assert spark.read.parquet(f"{store.root}/{last.path}").count() == 3  # the chat without news is not written again


def test_running_counts(spark, tmp_path):
    source, out = str(tmp_path / "ratings"), []
    spark.createDataFrame([(i, i % 2, f"p{i}", 5, NOW) for i in range(5)], schemas.RATINGS).write.parquet(source)
    counts = rating_counts_stream(spark.readStream.schema(schemas.RATINGS).parquet(source))
    counts.writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(df.collect())).trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(map(tuple, out)) == [(0, 3), (1, 2)]


def put_user(store, spark, **change):
    row = dict(id=1, chat_id=11, keyword_profile="graph nets", active=True, max_papers=None, digest_frequency=None,
               next_digest_date=None, min_rating=1, pending_action=None, created_at=NOW) | change
    from decimal import Decimal
    row["min_rating"] = Decimal(row["min_rating"])
    store.replace("users", spark.createDataFrame([tuple(row.values())], schemas.USERS))


def test_daily_digest_end_to_end(spark, tmp_path, landing):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    dry = daily.daily_digest(store, landing, DAY, scoring.overlap_scorer, dry_run=True)
    assert {r["kind"] for r in dry.outbox.collect()} == {"header", "paper"}
    assert store.load("papers").count() == 0 and store.load("paper_scores").count() == 0

    run = daily.daily_digest(store, landing, DAY, scoring.overlap_scorer)
    sent = run.outbox.where("kind = 'paper'").collect()
    assert [r["paper_id"] for r in sent] == ["arxiv:2401.00001"]
    assert store.load("papers").count() == 7
    assert store.load("users").first()["next_digest_date"] == DAY + dt.timedelta(days=1)
    assert {(r["stage"], r["part"]): r["rows"] for r in run.summary.collect()}["requests", "ok"] == 1
    assert daily.daily_digest(store, landing, DAY, scoring.overlap_scorer) is None

    receipts = run.outbox.select("user_id", "position", F.lit(True).alias("delivered"))
    daily.confirm_delivery(store, receipts, NOW)
    put_user(store, spark)
    again = daily.daily_digest(store, landing, DAY, scoring.overlap_scorer)
    assert again.outbox.where("kind = 'paper'").count() == 0
    assert store.load("papers").count() == 7 and store.load("digest_log").count() == 1


def test_a_digest_with_models_earlier_scores_and_a_sent_log(spark, tmp_path, landing):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    batch = ["arxiv:2401.00001", "arxiv:2401.00002", "arxiv:2401.7", "s2:gg", "pm:1", "pm:2"]
    # A model that likes one word and nothing else: sigmoid(-2 + 4 * weight).
    store.commit(Write("models", "delta", spark.createDataFrame([(1, "graph", 1.0, 4.0), (1, "second", 1.0, 4.0)], schemas.MODELS)),
                 Write("model_meta", "delta", meta_row(spark, 1, -2.0)))
    early = DAY - dt.timedelta(days=1)
    scored = spark.createDataFrame([(p, 1, 9.0, None, "before") for p in (batch[1], batch[4])],
                                   "paper_id string, user_id bigint, llm_score double, pref_score double, llm_explanation string")
    daily.store_scores(store, scored, early)
    store.append("digest_log", spark.createDataFrame([(1, batch[4], NOW)], schemas.DIGEST_LOG))
    scorer = lambda request: json.dumps([{"score": 8, "reason": "r"}] * request.count("\nAuthors: "))
    run = daily.daily_digest(store, landing, DAY, scorer)
    scores = {r["paper_id"]: r for r in store.load("paper_scores").collect()}
    assert len(scores) == 7 and all(r["pref_score"] is not None for r in scores.values())
    again = scores[batch[1]]
    assert (again["scored_at"].date(), float(again["llm_score"])) == (early, 8.0)  # scored again, first time kept
    assert scores["arxiv:2401.00001"]["scored_at"].date() == DAY
    assert float(scores["pm:1"]["pref_score"]) == pytest.approx(10 / (1 + math.exp(2)), abs=0.006)  # no known word
    assert float(scores["arxiv:2401.00001"]["pref_score"]) > float(scores["pm:1"]["pref_score"])
    sent = [r["paper_id"] for r in run.outbox.where("kind = 'paper'").orderBy("position").collect()]
    assert batch[4] not in sent and set(sent[:2]) == {batch[0], batch[1]}
    assert store.load("users").first()["next_digest_date"] == DAY + dt.timedelta(days=1)


def counting(folder, bad=0, dies_on=None):
    """A scorer that notes every call in a file, since tasks run in other processes."""

    def scorer(request, folder=str(folder)):
        import hashlib
        import os

        path = f"{folder}/{hashlib.sha256(request.encode()).hexdigest()}"
        with open(path, "a") as f:
            f.write("x")
        if dies_on and dies_on in request:
            os._exit(1)  # no ordinary failure: the worker is gone
        calls = os.path.getsize(path)
        if calls <= bad:
            if calls % 2:
                raise ValueError("busy")
            return "no json"
        return '[{"score": 1}, {"score": 2}]' if "two" in request else f'[{{"score": {len(request) % 10}}}]'

    return scorer


def calls(folder):
    return sorted(x.stat().st_size for x in folder.iterdir())


def requests_of(spark, texts):
    return spark.createDataFrame([(i, i % 3, 1, t) for i, t in enumerate(texts)], "user_id bigint, batch_no int, n int, request string")


def test_failed_and_unreadable_replies_are_asked_again_and_never_twice(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    scorer, ledger = counting(tmp_path / "calls", bad=2), str(tmp_path / "ledger")
    requests = requests_of(spark, [f"request {'y' * i}" for i in range(30)] + ["request ", "two"])
    got = {(r["user_id"], r["batch_no"]): r["reply"] for r in scoring.ask(requests, scorer, ledger, pause=0.01).collect()}
    assert len(got) == 32 and got[31, 1] == '[{"score": 1}, {"score": 2}]' and got[0, 0] == got[30, 0] == '[{"score": 8}]'
    assert calls(tmp_path / "calls") == [3] * 31  # two equal requests are one
    assert scoring.ask(requests, scorer, ledger, pause=0.01).count() == 32 and calls(tmp_path / "calls") == [3] * 31
    outcomes = {r["user_id"]: r["status"] for r in scoring.reply_outcomes(requests, scoring.ask(requests, scorer, ledger)).collect()}
    assert outcomes.pop(31) == "wrong length" and set(outcomes.values()) == {"ok"}  # not asked again


def test_three_tries_and_no_more(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    scorer = counting(tmp_path / "calls", bad=9)
    replies = scoring.ask(requests_of(spark, ["a", "b"]), scorer, str(tmp_path / "ledger"), pause=0.01)
    assert [r["reply"] for r in replies.collect()] == ["no json"] * 2 and calls(tmp_path / "calls") == [3, 3]


def test_replies_of_finished_tasks_outlive_a_job_that_dies(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    monkeypatch.setattr(scoring, "TASK_REQUESTS", 1)
    requests, ledger = requests_of(spark, [f"request {i}" for i in range(20)] + ["the one that dies"]), str(tmp_path / "ledger")
    with pytest.raises(Exception):
        scoring.ask(requests, counting(tmp_path / "calls", dies_on="dies"), ledger)
    before = scoring.ledger_rows(spark, ledger).count()
    assert before > 0
    scorer = counting(tmp_path / "calls")
    assert scoring.ask(requests, scorer, ledger).count() == 21
    assert calls(tmp_path / "calls").count(1) >= before


def test_settings_that_change_during_a_digest_are_kept(spark, tmp_path, landing, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    write_updates(tmp_path / "feed" / "1.json", [say(1, 11, "/limit 7"), say(2, 12, "/start")])
    messages = daily.digest_messages

    def meanwhile(*args):
        if store.version("outbox") == 0 and store.load("users").count() == 1:
            settings_stream(read_updates(spark, str(tmp_path / "feed")), store, str(tmp_path / "check")).awaitTermination()
        return messages(*args)

    monkeypatch.setattr(daily, "digest_messages", meanwhile)
    daily.daily_digest(store, landing, DAY, scoring.overlap_scorer)
    users = {r["chat_id"]: r for r in store.load("users").collect()}
    assert (users[11]["max_papers"], users[11]["next_digest_date"]) == (7, DAY + dt.timedelta(days=1))
    assert sorted(users) == [11, 12] and store.load("outbox").count() > 0


def test_stored_title_keeps_its_id(spark, tmp_path, landing):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    from dailyfolio.functions.text import title_hash
    old = stored_papers(spark, ["s2:old"]).withColumn("title", F.lit("GRAPH NETS")).withColumn("title_hash", title_hash(F.col("title")))
    store.replace("papers", old)
    run = daily.daily_digest(store, landing, DAY, scoring.overlap_scorer)
    assert [r["paper_id"] for r in run.outbox.where("kind = 'paper'").collect()] == ["s2:old"]


def test_retrain_keeps_models_of_others(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    papers = stored_papers(spark, [f"p{i}" for i in range(40)]).withColumn(
        "abstract", F.when(F.expr("cast(substr(id, 2) as int) % 2 = 0"), F.lit("graph nets")).otherwise(F.lit("cooking soup")))
    store.replace("papers", papers)
    store.replace("ratings", spark.createDataFrame([(i, 11, f"p{i}", 10 if i % 2 == 0 else 1, NOW) for i in range(40)], schemas.RATINGS))
    store.replace("models", spark.createDataFrame([(5, "x", 1.0, 1.0), (1, "old", 1.0, 1.0)], schemas.MODELS))
    store.replace("model_meta", spark.createDataFrame([(5, 0.1, 30, None, None), (1, 0.0, 30, None, None)], schemas.MODEL_META))
    meta, summary = retrain.retrain_all(store)
    (row,) = meta.collect()
    assert (row["user_id"], row["n"], row["cv_auc_mean"], row["cv_auc_std"]) == (1, 40, 1.0, 0.0)
    models, stored = retrain.load_models(store)
    terms = {(r["user_id"], r["term"]) for r in models.collect()}
    assert (5, "x") in terms and (1, "old") not in terms and (1, "graph nets") in terms
    assert sorted(r["user_id"] for r in stored.collect()) == [1, 5]
    assert {(r["stage"], r["rows"]) for r in summary.collect()} == {("active users", 1), ("trained", 1)}
    assert prefmodel.MIN_RATINGS == 30


def test_retrain_counts_ratings_beyond_the_bound(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    put_user(store, spark)
    store.replace("papers", stored_papers(spark, [f"p{i}" for i in range(40)]).withColumn(
        "abstract", F.when(F.expr("cast(substr(id, 2) as int) % 2 = 0"), F.lit("graph nets")).otherwise(F.lit("cooking soup"))))
    store.replace("ratings", spark.createDataFrame([(i, 11, f"p{i}", 10 if i % 2 == 0 else 1, NOW) for i in range(40)], schemas.RATINGS))
    store.replace("models", spark.createDataFrame([], schemas.MODELS))
    store.replace("model_meta", spark.createDataFrame([], schemas.MODEL_META))
    (row,) = retrain.retrain_all(store, max_train_rows=31)[0].collect()
    assert (row["user_id"], row["n"], row["cv_auc_mean"], row["cv_auc_std"]) == (1, 40, 1.0, 0.0)
