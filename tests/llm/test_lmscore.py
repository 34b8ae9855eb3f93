import math

import numpy as np
import pytest

from dailyfolio.llm import lmscore
from dailyfolio.llm.words import words_of
from tests.llm.conftest import frame, prose


def test_losses_equal_plain_ones():
    text = prose(1, 60)
    w = words_of([text, prose(2, 30)])
    size = 1 << lmscore.WORD_BITS
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (2, size)).astype(np.float32)
    pairs = rng.integers(0, 3, (2, 1 << lmscore.PAIR_BITS)).astype(np.float32)
    got = lmscore.Pair(words, pairs).losses(w)
    word, pair, follows = lmscore._classes(w)
    for m in range(2):
        for k in range(len(word)):
            p = (words[m][word[k]] + lmscore.ADDED) / (words[m].sum() + lmscore.ADDED * size)
            if follows[k] and words[m][word[k - 1]] > 0:
                share = min(1.0, pairs[m][pair[k]] / words[m][word[k - 1]])
                p = lmscore.PAIR_WEIGHT * share + (1 - lmscore.PAIR_WEIGHT) * p
            assert math.isclose(got[m, k], -math.log(p), rel_tol=1e-4)


def test_texts_like_the_target_score_higher(spark):
    odd_words = [" ".join(w[::-1] for w in prose(i, 120).split()) for i in range(60)]
    texts = [prose(i, 120) for i in range(60)] + odd_words + [None, "", "..."]
    docs = frame(spark, texts)
    target = docs.select("doc_id").filter("doc_id < 30").unionByName(docs.select("doc_id").filter("doc_id < 3"))
    rows = {r["doc_id"]: r for r in lmscore.score(docs, lmscore.fit(docs, target)).collect()}
    assert len(rows) == len(texts)
    assert min(rows[i]["score"] for i in range(60)) > max(rows[i]["score"] for i in range(60, 120))
    assert all(rows[i]["n_tokens"] == 0 and rows[i]["score"] is None for i in (120, 121, 122))
    assert rows[3]["n_tokens"] == 120


@pytest.mark.parametrize("groups", [1, 5])
def test_ranges_of_shards_change_nothing(spark, odd, nothing, monkeypatch, groups):
    """Keys sent by way of ranges, of all blocks together or of groups of them, give the losses of keys sent to their shards."""
    docs = frame(spark, [prose(i % 40, 30 + i % 50) for i in range(120)] + [None, "", "..."])
    target = docs.select("doc_id").filter("doc_id < 30")
    want = sorted(map(tuple, lmscore.score(docs, lmscore.fit(docs, target)).collect()))
    monkeypatch.setattr(lmscore, "_groups", lambda chars, bits, coarse: groups)
    models = lmscore.fit(docs, target, coarse_bits=3)
    assert models.coarse == 3 < models.bits
    got = sorted(map(tuple, lmscore.score(docs, models).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))
    ids = odd.select("doc_id")
    assert lmscore.score(odd, lmscore.fit(odd, ids, coarse_bits=3)).count() == odd.count()
    assert lmscore.score(nothing, lmscore.fit(nothing, ids, coarse_bits=3)).count() == 0
    assert lmscore.score(odd, lmscore.fit(nothing, ids, coarse_bits=3)).count() == odd.count()


def test_groups_grow_with_the_input():
    """A row of a group in a shard stays about as long as that of a block in a range."""
    for chars in (10**9, 10**12, 10**15):
        bits = max(lmscore.SHARD_BITS, (chars // lmscore.SHARD_CHARS).bit_length())
        coarse = min(bits, lmscore.COARSE_BITS)
        in_group = chars / lmscore.BLOCK_CHARS / lmscore._groups(chars, bits, coarse)
        assert in_group >= 0.99 * 2 ** (bits - coarse)


def test_odd_and_empty_tables(spark, odd, nothing):
    ids = odd.select("doc_id")
    assert lmscore.score(odd, lmscore.fit(odd, ids)).count() == odd.count()
    empty = lmscore.fit(nothing, ids)
    assert lmscore.score(nothing, empty).count() == 0
    assert lmscore.score(odd, empty).count() == odd.count()


def test_counts_are_exact_for_a_vocabulary_beyond_any_table(spark):
    """Far more words and pairs than the former tables had classes, against counts by plain dictionaries."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 120_000, 1500)) for _ in range(120)] + [prose(i, 40) for i in range(6)]
    docs = frame(spark, texts)
    target = docs.select("doc_id").filter("doc_id % 3 = 0")
    folds = {r["doc_id"]: r["f"] for r in docs.selectExpr("doc_id", "(xxhash64(text) & 65535) % 2 f").collect()}
    counts = [[{}, {}], [{}, {}]]
    for d, text in enumerate(texts):
        words = text.replace(".", "").split()
        for gram in [*words, *zip(words, words[1:])]:
            for m in ((0, 1) if d % 3 == 0 else (1,)):
                held = counts[folds[d]][m]
                held[gram] = held.get(gram, 0) + 1
    size = 1 + len({g for f in counts for g in f[1] if isinstance(g, str)})
    assert size > 1 << lmscore.WORD_BITS
    rows = {r["doc_id"]: r for r in lmscore.score(docs, lmscore.fit(docs, target)).collect()}
    total = [[sum(n for g, n in m.items() if isinstance(g, str)) for m in f] for f in counts]
    for d in (0, 1, 2, 50, 119, 121):
        words, f, want = texts[d].replace(".", "").split(), 1 - folds[d], [0.0, 0.0]
        for m in (0, 1):
            scale = total[f][0] / total[f][m]
            for before, word in zip([None, *words], words):
                p = (counts[f][m].get(word, 0) * scale + lmscore.ADDED) / (total[f][0] + lmscore.ADDED * size)
                if counts[f][m].get(before, 0):
                    p = p / 2 + counts[f][m].get((before, word), 0) / counts[f][m][before] / 2
                want[m] -= math.log(p) / len(words)
        assert math.isclose(rows[d]["loss_target"], want[0], rel_tol=1e-9)
        assert math.isclose(rows[d]["loss_background"], want[1], rel_tol=1e-9)
