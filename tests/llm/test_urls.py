import duckdb

from dailyfolio.llm import urls


def pages(spark, links):
    return spark.createDataFrame([(i, u, "v", "x") for i, u in enumerate(links)], "page_id bigint, url string, verdict string, canonical string")


LINKS = ["https://a.com/x", "http://Example.COM/en/1", "https://www.example.com/en/1?q#f", "https://b.net/es/", "b.net/es/",
         "https://net/fr/x", "https://xnet/fr/x", None, "", "x://", "://h/p", "https://h.org?x=/y", "https://free-bets.x.org/a/",
         "http://www.free-bets.x.org/a#top", "http://m.free-bets.x.org/a.html", "https://other.org/a", "https://e.com",
         "https://e.com/en/", "a://b://c/d", "https://sub.www.example.com/en/z", "https://e.net/es/?a", "https://other.org/a", "https://free-bets.x.org/" + "a/" * 50_000 + "?" + "q" * 50_000,
         "HTTPS://" + "Sub." * 20_000 + "E.net/es/x"]


def test_rules_and_list_equal_sql(spark):
    docs = pages(spark, LINKS)
    got = urls.judge(docs, urls.listed_by_words(urls.parsed(docs))).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(LINKS)))
    want = con.execute(urls.sql()).fetchall()
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0])
    by = {r["page_id"]: r for r in got}
    assert [by[i]["rule"] for i in (0, 1, 2, 3, 4, 6, 16, 19)] == [
        "com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, "www.example.com/en/"]
    assert [by[i]["verdict"] for i in (12, 13, 14, 15)] == ["block", "block", "block", "allow"]


def test_filter_has_no_false_negative_and_the_join_removes_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/p') AS canonical")
    asked = pages(spark, [f"https://h{i}.org/p" for i in range(0, 9000, 3)])
    full, urls.MOST_BLOCKS = urls.MOST_BLOCKS, 2  # so full that nearly all passes
    try:
        small = {r["page_id"]: r["verdict"] for r in urls.judge(asked, listed).collect()}
    finally:
        urls.MOST_BLOCKS = full
    large = {r["page_id"]: r["verdict"] for r in urls.judge(asked, listed).collect()}
    assert small == large == {i: "block" if 3 * i < 3000 else "allow" for i in range(3000)}


def test_empty_tables(spark):
    none = pages(spark, LINKS).limit(0)
    assert urls.judge(none, urls.listed_by_words(urls.parsed(none))).count() == 0
    assert {r["verdict"] for r in urls.judge(pages(spark, ["https://x.org/a"]), urls.listed_by_words(urls.parsed(none))).collect()} == {"allow"}
