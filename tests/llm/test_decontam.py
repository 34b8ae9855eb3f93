import numpy as np
import pytest

from dailyfolio.llm import decontam
from dailyfolio.llm.words import words_of
from tests.llm.conftest import frame, prose

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, ITEM), (2, "Wholly other. " + prose(77, 30)), (3, None), (None, ITEM), (4, ""), (5, "short one")],
        "item_id bigint, text string")


def plain_tiles(item, text, least):
    """Greedy tiles by comparing every pair of places."""
    used_i, used_t = [False] * len(item), [False] * len(text)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                       and not used_i[i + n] and not used_t[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(used_i)
        for k in range(n):
            used_i[i + k] = used_t[j + k] = True


def test_tiles_equal_exhaustive_greedy_tiles():
    rng = np.random.default_rng(0)
    for _ in range(120):
        a = rng.integers(0, 4, rng.integers(5, 25)).tolist()
        b = rng.integers(0, 4, rng.integers(5, 40)).tolist()
        key = lambda x: words_of([" ".join(f"w{v}" for v in x)]).key
        assert decontam.tiled(key(a), [key(b)], 3) == plain_tiles(a, b, 3)


def found(docs, bench, **kw):
    rows = decontam.contamination(docs, bench, **kw).select("doc_id", "__leaks").collect()
    return {r["doc_id"]: {x["item_id"]: round(x["coverage"], 2) for x in r["__leaks"]} for r in rows}


def test_verbatim_reordered_and_partial_passages(spark, bench):
    w = ITEM.split()
    texts = [
        prose(1, 80) + " " + ITEM.upper().replace(" ", ", ") + "! " + prose(2, 80),
        " ".join(w[10:] + prose(3, 20).split() + w[:10]),
        " ".join(w[:9]) + " " + prose(4, 100),
        " ".join(w[::-1]),
        prose(5, 300),
        "this is a short one indeed",
        None, ""]
    got = found(frame(spark, texts), bench)
    assert got[0] == {1: 1.0} and got[1] == {1: 1.0}
    assert got[2] == got[3] == got[4] == got[6] == got[7] == {}
    assert got[5] == {5: 1.0}
    assert found(frame(spark, texts), bench, block_words=10) == got


def plain(texts, items, least=5, coverage=0.6):
    """Every text tiled against every item, without seeds."""
    keys = lambda x: words_of([x or ""]).key.tolist()
    out = {}
    for d, text in enumerate(texts):
        out[d], words = {}, keys(text)
        for i, item in items:
            item = keys(item)
            if i is not None and item:
                share = plain_tiles(item, words, min(least, len(item))) / len(item)
                if share >= coverage:
                    out[d][i] = max(round(share, 2), out[d].get(i, 0))
    return out


def test_whole_query_equals_tiling_every_pair(spark):
    rng = np.random.default_rng(4)
    draw = lambda n, k: " ".join(f"w{v}" for v in rng.integers(0, k, n))
    items = [(f"item {i}", draw(6 + 3 * (i % 5), 5 + 20 * (i % 3))) for i in range(12)] + [
        ("few", "w1 w2 w3"), ("same", "so " * 30), (None, draw(20, 9)), ("null", None), ("item 0", "w1 w1 w2 w2 w3 w3 w4")]
    texts = [draw(30, 4 + 6 * (i % 6)) for i in range(40)]
    for i in range(12):
        w = items[i][1].split()
        texts += [draw(9, 60) + " " + " ".join(w[len(w) // 2:]) + " x y z " + " ".join(w[:len(w) // 2]), items[i][1].upper()]
    texts += ["so " * 17, "so " * 90, "so " * 19 + "x " + "so " * 8, None, "", "w1 w2 w3"]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id string, text string, coverage double")
    want = plain(texts, items)
    assert sum(map(bool, want.values())) > 15
    assert found(frame(spark, texts), bench) == want
    assert found(frame(spark, texts), bench, block_words=12) == want
    kept = decontam.decontaminated(frame(spark, texts), bench, block_words=30)
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, f in want.items() if not f]


def test_repeated_words_stay_small(spark):
    import tracemalloc

    block = decontam.Benchmark(["word " * 1000, "a b " * 300], 5, 0.6)
    tracemalloc.start()
    got = block.matches(["word " * 40_000, "word " * 700, "word " * 500, "a b " * 5_000 + "b " * 900])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[(0, 1.0)], [(0, 0.7)], [], [(1, 1.0)]] and peak < 60e6


def test_stage_drops_only_contaminated(spark, bench):
    docs = frame(spark, [ITEM, prose(1, 50), None])
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_odd_and_empty_tables(spark, odd, nothing, bench):
    assert decontam.contamination(odd, bench).count() == odd.count()
    assert decontam.decontaminated(nothing, bench).count() == 0
    assert decontam.decontaminated(odd, bench.limit(0)).count() == odd.count()
