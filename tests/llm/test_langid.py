import math
import zlib
from collections import Counter

import pytest

from dailyfolio.llm import langid
from dailyfolio.llm.words import table
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_split(spark):
    docs = table(spark, SF, "documents")
    found = langid.identify(docs, langid.fit(docs))
    rows = docs.select("doc_id", "lang").join(found, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_foreign_scripts_and_letterless_texts_are_rejected(spark):
    model = langid.fit(table(spark, SF, "documents"))
    docs = frame(spark, ["это совсем другой язык и другие буквы", "12345 !!!", None, "", "the and of that with for was are"])
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert [rows[i]["rejected"] for i in range(5)] == [True, True, True, True, False]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [4]


def test_predictions_equal_plain_cosines(spark):
    """N-grams counted by a dictionary, weighted and compared with every centroid one by one."""
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect() + docs.orderBy(docs["n_chars"].desc()).limit(2).collect():
        text = "".join(c.lower() if c.isalpha() else " " for c in (r["text"] or ""))
        text = " " * text.startswith(" ") + " ".join(text.split()) + " " * text.endswith(" ")
        grams = Counter(text[i:i + n] for n in langid.ORDERS for i in range(len(text) - n + 1))
        del grams[" "]
        counts = Counter()
        for gram, n in grams.items():
            code = 0
            for c in gram:
                code = code * 0x1FFFFF + min(ord(c), 0x20000)
            counts[((code + len(gram)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - langid.FEATURE_BITS] += n
        weight = {f: math.log1p(n) * float(model.idf[f]) for f, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        near = [sum(w * float(c[f]) for f, w in weight.items()) / norm for c in model.centroids]
        best = max(near)
        assert found[r["doc_id"]]["score"] == pytest.approx(best, abs=1e-4)
        assert found[r["doc_id"]]["lang_pred"] in {lang for lang, x in zip(model.langs, near) if x > best - 1e-5}


def test_odd_and_empty_tables(odd, nothing):
    assert langid.identify(odd, langid.fit(odd)).count() == odd.count()
    empty = langid.fit(nothing)
    assert langid.identify(nothing, empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_floors_come_from_all_training_rows(spark):
    import numpy as np

    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    learned = [r["text"] for r in docs.filter(langid.is_training(docs["doc_id"])).select("text", "lang").collect() if r["text"] and r["lang"]]
    counts = np.zeros((langid.LENGTHS, langid.STEPS + 1), np.int64)
    for at in range(0, len(learned), 20):
        x, letters = langid._vectors(learned[at:at + 20], model.idf)
        for cosine, n in zip((x @ model.centroids.T).max(1), letters):
            if n:
                counts[langid._length(np.array([n]))[0], int(min(1, max(0, cosine)) * langid.STEPS)] += 1
    assert np.abs(langid._floors(counts) - model.floors).max() <= 1 / langid.STEPS
    rejected = model.predict(learned[:400])["rejected"].mean()
    assert rejected <= 0.01


def test_neighbouring_languages_are_rejected_more_often_than_known_ones(spark):
    model = langid.fit(table(spark, "/root/testdata/sf0.1", "documents"))
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem",
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa, wote wamejaliwa akili na dhamiri", "qwrtpsdfg zxcvbnm hjklp trwqzx " * 5]
    found = model.predict(foreign)["rejected"].tolist()
    assert sum(found) >= 2, found
