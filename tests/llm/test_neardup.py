import random

import numpy as np
import pytest

from dailyfolio.llm import neardup
from dailyfolio.llm.words import table
from tests.llm.conftest import frame, prose
from tests.llm.test_simhash import classes


def shingles(text):
    w = [x for x in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def plain(texts):
    """The group of each text over all pairs: distinct shingle sets first, an inverted index to skip pairs that share nothing."""
    sets, index = {}, {}
    for i, t in enumerate(texts):
        sets.setdefault(shingles(t), []).append(i)
    pairs = [(rows[0], i) for rows in sets.values() for i in rows]
    for s, rows in sets.items():
        for other in {o for x in s for o in index.get(x, ())}:
            if similar(s, other):
                pairs.append((rows[0], sets[other][0]))
        for x in s:
            index.setdefault(x, []).append(s)
    return classes(range(len(texts)), pairs)


def found(docs, **kw):
    rows, heads = neardup.groups(docs, **kw)
    return {r["doc_id"]: r["root"] for r in rows.join(heads, "key").collect()}


def partition(group):
    out = {}
    for i, g in group.items():
        out.setdefault(g, set()).add(i)
    return sorted(map(sorted, out.values()))


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def changed(base, k, seed):
    rng = random.Random(seed)
    out = list(base)
    for i in rng.sample(range(len(out)), k):
        out[i] = "".join(rng.choices("klmnop", k=6))
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """Families of a base and its copies; copies of a large family are too far from one another, but near to their base."""
    out = [" ".join(words(s, 60 + 40 * (s % 9))) for s in range(60)]
    for f in range(25):
        base = words(100 + f, 150)
        out += [changed(base, k, 1000 * f + k) for k in (0, 1, 2, 3, 4, 6, 9)]
    base = words(999, 400)
    out += [changed(base, 9, 5000 + i) for i in range(150)] + [" ".join(base)]
    out += [" ".join(base).upper().replace(" ", ", "), "one two", "One, two!", "one two three", None, "", " .. ", prose(1, 200), prose(1, 200) + " end"]
    return out


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 16])
def test_groups_equal_the_components_of_all_similar_pairs(spark, corpus, chunk):
    assert partition(found(frame(spark, corpus), chunk=chunk)) == partition(plain(corpus))


@pytest.mark.parametrize("cell", [neardup.CELL, 40])
def test_copies_among_many_similar_texts_are_joined(spark, cell):
    """Each text's copy is one of many in its buckets, most of which are as near by their fingerprints, but not similar."""
    base = words(1, 300)
    texts = [t for i in range(150) for own in [changed(base, 5, 70 + i)] for t in (own, changed(own.split(), 6, 900 + i))]
    want = partition(plain(texts))
    assert len(want) > 60
    assert partition(found(frame(spark, texts), cell=cell)) == want


@pytest.mark.parametrize("cell", [100, 2])
def test_all_similar_pairs_of_an_open_bucket_are_found(spark, cell):
    sets = {i: [100 * (i // 3) + x for x in range(10) if x != i % 3] for i in range(30)} | {30: [], 31: [1, 2, 3]}
    near = spark.createDataFrame([(3, 0), (4, 3)], "node bigint, root bigint")
    rows = spark.createDataFrame([(b, i, len(s)) for b in (7, 8) for i, s in sets.items()] + [(9, 3, 9), (9, 4, 9)], "bucket bigint, cid bigint, n bigint")
    root = {3: 0, 4: 3}
    members = neardup.open_buckets(rows, near, cell)
    assert {r["bucket"] for r in members.collect()} == {7, 8, 9}
    got = neardup.rest(members, spark.createDataFrame(list(sets.items()), "cid bigint, shingles array<bigint>"), 0.8).collect()
    want = {(a, b) for a in sets for b in sets if a < b and root.get(a, a) != root.get(b, b)
            and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert len(got) == len(want) == 30 and {(r["a"], r["b"]) for r in got} == want


def test_recall_on_the_given_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").orderBy("doc_id").collect()
    want = plain([r["text"] for r in rows])
    got = found(table(spark, "/root/testdata/sf0.01", "documents"))
    roots = [got[r["doc_id"]] for r in rows]
    linked = [(i, g) for i, g in want.items() if i != g]
    assert len(linked) > 20 and all(roots[i] == roots[g] for i, g in linked)
    assert len(set(roots)) == len(set(want.values()))


def test_one_document_of_each_group_stays(spark, corpus):
    docs = frame(spark, corpus)
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain(corpus).values()))


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    docs = frame(spark, [prose(5, 100), prose(6, 100)])
    doubled = docs.unionByName(docs).unionByName(docs.selectExpr("null as doc_id", *docs.columns[1:]))
    other = frame(spark, [prose(7, 100)]).selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:])
    kept = neardup.representatives(doubled.unionByName(other).unionByName(other)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 0), (False, 1), (True, 0)]


def test_odd_and_empty_tables(odd, nothing):
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert neardup.representatives(nothing).count() == 0


def test_bands_and_fingerprints_follow_the_sets():
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 40_000, dtype=np.uint64))
    assert (neardup.bands(a) == neardup.bands(a[::-1])).all() and neardup.fingerprint(a) == neardup.fingerprint(a[::-1])
    shared = [(neardup.bands(x) == neardup.bands(x[:len(x) * 9 // 10])).any() for x in np.array_split(a, 100)]
    assert sum(shared) >= 98
