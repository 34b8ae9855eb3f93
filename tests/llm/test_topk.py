import math

import duckdb
import numpy as np
import pytest

from dailyfolio.llm import topk
from dailyfolio.llm.words import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, cid string"


def plain(rows, k=5, every=50):
    """Every inner product in Python's whole numbers."""
    held = {(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows
            if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q, a in held:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in held if (i, b) != (q, a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], SCHEMA)


def got(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def drawn(n, dims, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    rows = [(i, (centre[i % 4] * (i % 3) + rng.normal(size=dims) / 2).astype(np.float32).tolist()) for i in range(n)]
    copies = [(n + i, rows[7][1]) for i in range(40)]  # one group of copies, some of them queries
    return rows + copies


@pytest.mark.parametrize("nodes,slice_rows,block_rows", [(2, 4096, 1024), (3, 40, 2), (1, 100, 100)])
def test_search_equals_all_products(spark, nodes, slice_rows, block_rows):
    rows = drawn(180, 12, nodes)
    found = topk.search(frame(spark, rows), nodes=nodes, slice_rows=slice_rows, block_rows=block_rows, every=20)
    assert got(found) == plain(rows, every=20)


def test_sql_states_the_same(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = sorted(c.execute(topk.sql()).fetchall())
    assert got(topk.search(table(spark, SF, "embeddings"))) == want and want


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [0.5]), (2, []), (3, None), (100, None), (None, [1.0, 1.0]),
            (4, [None, 1.0]), (150, [nan, 1.0]), (5, [inf, 0.0]), (6, [-1.0, -2.0]), (200, [-4.0, 8.0, 1.0])]
    assert got(topk.search(frame(spark, rows))) == plain(rows)
    assert got(topk.search(frame(spark, rows[:1]))) == []
    assert topk.search(frame(spark, [])).count() == 0
    large = [(0, [2e6, -2.0]), (1, [1e6, 5.0]), (2, [-2e6, 1.0])]
    assert got(topk.search(frame(spark, large))) == plain(large)
    beyond = topk.search(frame(spark, [(0, [3e30, -2.0]), (1, [2e30, 5.0]), (2, [-3e30, 1.0])]))
    assert [r[2] for r in got(beyond)] == [1, 2]  # parts saturate


def test_products_are_exact_at_every_size():
    for top in (100, 1 << 28, 1 << 40):
        rng = np.random.default_rng(top)
        a, b = (rng.integers(-top, top, (5, 7)) for _ in range(2))
        want = [[max(-topk.MOST, min(topk.MOST, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert topk.products(a, b).tolist() == want
