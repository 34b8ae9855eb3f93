"""Expressions on literal rows."""

import datetime as dt
from decimal import Decimal

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from dailyfolio.functions import bot, messages, papers, scores, text


def test_stop_words_are_those_of_spark_ml(spark):
    assert list(text.ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_normalize_title(one):
    got = one(["  Deep\tLearning: A  Survey! ", "Éléphants & co", "", "!!!", None, "a\x1fb\nC"],
              "string", text.normalize_title)
    assert got == ["deep learning a survey", "lphants co", "", "", None, "a b c"]


def test_empty_titles_share_a_hash(one):
    a, b, c = one(["", "???", "x"], "string", text.title_hash)
    assert a == b != c


def test_clean_line(one):
    assert one(["\n a\nb  ", "x"], "string", text.clean_line) == ["a b", "x"]


def test_truncate(one):
    assert one(["abcd", "abcde", None], "string", lambda c: text.truncate_ellipsis(c, 4)) == [
        "abcd", "abcd...", None]


def test_tokens_and_ngrams(one):
    def run(c):
        return text.ngrams(text.remove_stop_words(text.tokens(c)))

    got = one(["The cat and the Hat x été_1", "one", "", "the"], "string", run)
    assert got[0] == ["cat", "hat", "été_1", "cat hat", "hat été_1"]
    assert got[1:] == [["one"], [], []]


def test_doc_text(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), (None, None), ("a ", "b")], "t string, s string")
    got = [r[0] for r in df.select(text.doc_text(F.col("t"), F.col("s"))).collect()]
    assert got == ["a", "b", "", "a  b"]


def test_authors(one):
    values = [[], None, ["A"], ["A", "B", "C"], ["A", "B", "C", "D"]]
    assert one(values, "array<string>", papers.format_authors) == [
        "Unknown", "Unknown", "A", "A, B, C", "A, B, C et al."]
    assert one([list("abcdef")], "array<string>", papers.first_k) == [list("abcde")]


def test_arxiv_number(one):
    got = one(["http://arxiv.org/abs/2403.1v2", "http://arxiv.org/abs/solv-int/9701001v1", "x"],
              "string", papers.arxiv_number)
    assert got == ["2403.1", "solv-int/9701001", "x"]


def test_final_score(spark):
    cases = [("7", "8.33", "7.53"), ("7", None, "7.00"), (None, "3.5", "3.50"), (None, None, None),
             ("0.01", "0.01", "0.01"), ("7.125", "1", "4.68")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(
        scores.final_score(F.col("a").cast("double"), F.col("b").cast("double")).alias("s"))
    assert [r["s"] for r in df.collect()] == [None if c is None else Decimal(c) for *_, c in cases]


def test_pref_score_and_label(one):
    assert one([0.71249, 0.7125, 1.0], "double", scores.pref_score) == [
        Decimal("7.12"), Decimal("7.13"), Decimal("10.00")]
    assert one([1, 5, 10, None], "int", scores.like_label) == [0, 1, 1, 0]


def test_next_weekday(spark):
    monday = dt.date(2024, 1, 1)
    names = ["Monday", " tuesday ", "WEDNESDAY", "Thursday", "Friday", "Saturday", "Sunday", "Mon", ""]
    df = spark.createDataFrame([(i, monday, n) for i, n in enumerate(names)], "i int, d date, n string")
    got = [r["x"] for r in df.orderBy("i").select(
        bot.next_weekday_on_or_after(F.col("d"), F.col("n")).alias("x")).collect()]
    assert got == [monday + dt.timedelta(days=i) for i in range(7)] + [None, None]


def test_parse_rating_callback(one):
    got = one(["rate|arxiv:1|10", "rate|a|5x", "rate|a| 1", "rate|a|7", "rate|a", "rate|a|5|", "vote|a|5", "rate|a|", None],
              "string", bot.parse_rating_callback)
    assert [(r["score"], r["reason"]) for r in got] == [
        (10, None), (5, None), (1, None), (None, "Invalid score"), (None, "Unknown action"),
        (None, "Unknown action"), (None, "Unknown action"), (None, "Invalid score"), (None, "Unknown action")]


def test_parse_command(one):
    texts = ["/start", "/startle", "/frequency 7 x", "/frequency 0", "/frequency 366", "/limit 50.9",
             "/limit 51", "/limit", "/rating 7.25", "/rating 1e1x", "/rating .5", "/rating ten", "/rating -1",
             "hello", "/what", "", None, " /start", "/frequency 3"]
    got = one(texts, "string", bot.parse_command)
    assert [r["command"] for r in got] == [
        "start", "start", "frequency", "frequency", "frequency", "limit", "limit", "limit", "rating",
        "rating", "rating", "rating", "rating", "text", "text", None, None, "text", "frequency"]
    assert [r["days"] for r in got][2:5] + [got[18]["days"]] == [7, None, None, 3]
    assert [r["papers"] for r in got][5:8] == [50, None, None]
    assert [r["min_rating"] for r in got][8:13] == [
        Decimal("7.3"), Decimal("10.0"), Decimal("0.5"), None, None]


def test_reply_parsing(one):
    good = '[{"score": 7, "reason": "r"}, {"score": "8.5"}, {"reason": "x"}, {"score": null}]'
    got = one([good, "```json\n" + good + "\n```", "nope", '[{"score": 1}', "[]"], "string",
              messages.parse_score_reply)
    assert [tuple(x) for x in got[0]] == [(7.0, "r"), (8.5, ""), (0.0, "x"), (0.0, "")]
    assert got[1] == got[0]
    assert got[2] is None and got[3] is None and got[4] == []


def test_reply_must_be_one_json_array(one):
    assert one(['[{"score": 1}] and more', '{"score": 1}'], "string", messages.parse_score_reply) == [None, None]


def test_render_rounds_like_the_binary_value(spark):
    df = spark.createDataFrame([("3.15",), ("3.25",), ("6.35",), ("10.00",), (None,)], "s string")
    got = [r[0] for r in df.select(messages.render_message(
        F.lit("T"), F.lit("u"), F.array(F.lit("A")), F.lit("semantic_scholar"), F.lit("V"), F.lit(""),
        F.col("s").cast("decimal(4,2)"))).collect()]
    assert got[0] == "*[T](u)*\n_A_\nsemantic\\_scholar · V\n\n🔢 Relevance: 3.1/10"
    assert [g[-6:-3] for g in got] == [f"{x:.1f}"[-3:] for x in (3.15, 3.25, 6.35, 10.0, 0.0)]


def test_header_and_milestone(one):
    got = one([29, 30, 31], "int", messages.digest_header)
    assert got == [messages.INTRO_COLD, messages.INTRO_PERSONAL, messages.INTRO_PERSONAL]
    assert one([29, 30, 31], "int", messages.is_milestone) == [False, True, False]


def test_rating_actions(one):
    (got,) = one(["pm:1"], "string", bot.rating_actions)
    assert [a["data"] for a in got] == ["rate|pm:1|1", "rate|pm:1|5", "rate|pm:1|10"]
