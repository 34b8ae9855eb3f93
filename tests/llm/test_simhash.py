import random
import re

import numpy as np
import xxhash

from dailyfolio.llm import simhash
from dailyfolio.llm.components import components
from tests.llm.conftest import frame, prose


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, pairs):
    head = {n: n for n in nodes}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_fingerprints(n, seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
    return sorted(out)


def test_fingerprints_follow_the_definition():
    for text in [None, "", " \t", "One", "one TWO", "É É É", "a b c d e f g h", prose(3, 400), "x\x0by\x0cz w"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_one_node_links_like_all_pairs():
    fps = near_fingerprints(150, 1)
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    member, head = simhash.linked(np.array(fps, np.uint64))
    assert classes(fps, zip(member.tolist(), head.tolist())) == want
    assert len(member) == len(fps) - len(set(want.values()))


def test_index_links_like_all_pairs_with_and_without_split_nodes(spark):
    fps = near_fingerprints(200, 2)
    hub = 0x1234_5678_9ABC_DEF0
    fps = sorted({*fps, hub, *(hub ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(64))})
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame_ = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for limit in (40, 4096):
        rows = components(simhash.links(frame_, limit)).collect()
        got = classes(fps, [(r["node"] % (1 << 64), r["root"] % (1 << 64)) for r in rows])
        assert got == want


def test_near_duplicates_and_representatives(spark):
    base = prose(1, 600)
    texts = [base, prose(2, 300), base + " tail", base, None, "", prose(2, 300)]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = classes(range(7), [(a, b) for a in range(7) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    docs = frame(spark, [prose(5, 100), prose(6, 100)])
    doubled = docs.unionByName(docs).unionByName(docs.selectExpr("null as doc_id", *docs.columns[1:]))
    other = frame(spark, [prose(7, 100)]).selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:])
    kept = simhash.representatives(doubled.unionByName(other).unionByName(other)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 0), (False, 1), (True, 0)]


def test_odd_and_empty_tables(odd, nothing):
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.representatives(nothing).columns == nothing.columns
    assert simhash.representatives(odd).count() < odd.count()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (300, 200), (200, 300)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    nodes = {x for e in edges for x in e}
    assert classes(nodes, [(r["node"], r["root"]) for r in rows]) == classes(nodes, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
