import re
from collections import Counter

import numpy as np
import pytest

from dailyfolio.llm import quality
from tests.llm.conftest import SCHEMA, frame, prose


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) for d in range(3) if windows[tuple(words[k:k + 3])] > 1}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_counts_equal_plain_ones(spark, odd):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab #\n\t"), rng.integers(0, 60))) for _ in range(150)]
    texts += [prose(1, 500), "a b c " * 40, "x\n" * 9, "é ß 漢 é ß 漢", "a\x0bb\x0cc\rd"]
    docs = frame(spark, texts).unionByName(odd)
    want = Counter((r["doc_id"], *plain_counts(r["text"])) for r in docs.collect())
    got = quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == want


def test_consistency_factor():
    x = np.sort((np.random.default_rng(0).normal(size=(200_000, 4)) ** 2).sum(1))
    assert quality.consistency() == pytest.approx(4 / x[:150_000].mean(), rel=0.02)


def plain_step(x, mean, cov):
    y = x - mean
    d = (y * np.linalg.solve(cov, y.T).T).sum(1)
    grade = np.floor(np.log2(d + 2.0 ** -10) * quality.CLASSES)
    counts = Counter(grade)
    before, chosen = 0, set()
    for g in sorted(counts):
        if before < np.ceil(len(x) * quality.SUBSET):
            chosen.add(g)
        before += counts[g]
    near = x[[g in chosen for g in grade]]
    cov = np.cov(near.T, bias=True) * quality.consistency() + np.diag(quality.FLOORS)
    return near.mean(0), cov


def test_a_step_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    start = quality._starts(rows).filter("start = 0")
    (got,) = quality._step(rows, start).collect()
    mean, cov = plain_step(x, x.mean(0), np.cov(x.T, bias=True) + np.diag(quality.FLOORS))
    factor = np.linalg.cholesky(cov)
    assert [got[f"m{i}"] for i in range(4)] == pytest.approx(mean.tolist())
    assert [got[f"l{i}{j}"] for i, j in quality._PAIRS] == pytest.approx([factor[i, j] for i, j in quality._PAIRS])


def plain_distances(x):
    """Squared distances from the best of two starts after all steps, with numpy alone."""
    floors = np.diag(quality.FLOORS)
    middle = lambda v: np.sort(v, axis=0)[-(-len(v) // 2) - 1]
    median = middle(x)
    found = []
    for mean, cov in ((x.mean(0), np.cov(x.T, bias=True) + floors),
                      (median, np.diag((1.4826 * middle(np.abs(x - median))) ** 2) + floors)):
        for _ in range(quality.STEPS):
            mean, cov = plain_step(x, mean, cov)
        y = x - mean
        found.append((np.linalg.slogdet(cov)[1], (y * np.linalg.solve(cov, y.T).T).sum(1)))
    return min(found, key=lambda f: f[0])[1]


def test_verdicts_equal_plain_estimates(spark):
    """The whole query on two groups with texts between clean and odd, against numpy."""
    rng = np.random.default_rng(5)
    texts, sources = [], []
    for i in range(420):
        words = prose(i, 60 + i % 70).split()
        for k in range(len(words)):
            words[k] += "#$*%"[k % 4] * (rng.random() < (i % 21) ** 3 / 9000) + "x" * int(rng.integers(0, 2 + i % 3 * (i % 50 == 0) * 9))
        texts.append("\n".join([" ".join(words), *["same line"] * int(rng.integers(0, 4)), *["again"] * (40 * (i % 60 == 1))]))
        sources.append("ab"[i % 3 > 1])
    docs = spark.createDataFrame([(i, t, "en", s, 0, "f", 1, "x") for i, (t, s) in enumerate(zip(texts, sources))], SCHEMA)
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    counts = [plain_counts(t) for t in texts]
    failed = [n < 50 or 100 * again > 50 * n for n, _, _, _, again in counts]
    assert [got[i]["base_failed"] for i in range(len(texts))] == failed
    for source in "ab":
        own = [i for i in range(len(texts)) if sources[i] == source and not failed[i]]
        assert len(own) >= quality.LEAST_GROUP
        lines = [sum(bool(line.strip()) for line in texts[i].split("\n")) for i in own]
        x = np.array([(np.log(c / n), np.sqrt(y / c), np.sqrt(d / k), np.sqrt(a / n))
                      for (n, c, y, d, a), k in zip((counts[i] for i in own), lines)])
        want = plain_distances(x)
        assert [got[i]["distance"] for i in own] == pytest.approx(want.tolist(), rel=1e-6)
        assert [got[i]["kept"] for i in own] == (want <= quality.REJECT).tolist()
        assert 0 < (want > quality.REJECT).sum() < 0.2 * len(own)


def test_outliers_go_and_clean_texts_stay(spark):
    clean = [prose(i, 80 + i % 90) for i in range(300)]
    junk = [" ".join(w + "###$$$" for w in prose(900 + i, 80).split()) for i in range(8)]
    lined = [(prose(950 + i, 12) + "\n") * 2 + "\n".join([prose(960, 12)] * 9) for i in range(3)]
    rows = {r["doc_id"]: r for r in quality.judged(frame(spark, clean + junk + lined + ["short"])).collect()}
    assert all(rows[i]["kept"] for i in range(300))
    assert not any(rows[i]["kept"] for i in range(300, 312)) and rows[311]["base_failed"]


def test_small_groups_are_pooled_and_empty_tables_pass(spark, odd, nothing):
    assert quality.judged(nothing).count() == 0
    rows = [(i, prose(i, 90), f"l{i % 2}", f"s{i % 7}", 0, "f", 1, "x") for i in range(70)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = {r["grp"] for r in quality.grouped(quality.statistics(docs), 20).select("grp").distinct().collect()}
    assert names == {'["l0"]', '["l1"]'}
    assert {r["grp"] for r in quality.grouped(quality.statistics(docs), 60).select("grp").distinct().collect()} == {"[]"}
    few = quality.judged(docs, least=1000).collect()
    assert all(r["kept"] and r["distance"] is None for r in few)
