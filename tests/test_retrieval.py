from collections import Counter

import pyarrow as pa

from dailyfolio.operators import grams, retrieval


def test_grams_are_counted_in_pieces_of_any_size(monkeypatch):
    words = [["b", "a", "b"], None, [], ["zz"], ["a", "ab", "a", "ab", "é"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(words, pa.list_(pa.string()))], names=["k", "_w"])
    want = [sorted(Counter([*(w or []), *(" ".join(p) for p in zip(w or [], (w or [])[1:]))]).items(), key=lambda x: x[0].encode()) for w in words]
    for size in (1, 4, 1 << 20):
        monkeypatch.setattr(retrieval, "COUNTED_WORDS", size)
        rows = pa.Table.from_batches(retrieval._counted(iter([batch, batch.slice(2), batch.slice(0, 0)]))).to_pylist()
        assert [r["k"] for r in rows] == [0, 1, 2, 3, 4, 2, 3, 4]
        assert [list(zip(r["terms"], r["tfs"])) for r in rows] == want + want[2:]


def test_words_travel_instead_of_grams(spark):
    """Words that are counted behind a join give the counts of the texts; texts without words, or null, give none."""
    papers = spark.createDataFrame([("p0", "Deep graph", "nets of the graph"), ("p1", "", "the of"), ("p2", None, None), ("p3", "zz", "été zz")],
                                   "id string, title string, abstract string")
    words = grams.paper_words(papers)
    assert "terms" not in words.columns and grams.counted(papers) is papers
    asked = spark.createDataFrame([("p0", 1), ("p1", 2), ("p2", 3), ("p3", 4), ("none", 5)], "paper_id string, n int")
    got = {r["n"]: dict(zip(r["terms"], r["tfs"])) for r in grams.counted(asked.join(words, "paper_id", "left")).collect()}
    want = {r["paper_id"]: dict(zip(r["terms"], r["tfs"])) for r in retrieval.build_index(papers).counts.collect()}
    assert got == {1: want["p0"], 2: {}, 3: {}, 4: want["p3"], 5: {}} and want["p3"] == {"zz": 2, "zz été": 1, "été": 1, "été zz": 1}
    plan = grams.counted(asked.join(words, "paper_id", "left"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")


def test_only_terms_of_the_vocabulary_are_shuffled_for_vectors(spark):
    """The written index has the vectors of the lazy one; also of papers that come twice and without a known term."""
    rows = [("p0", "", "graph nets graph"), ("p0", "", "soup graph"), ("p1", "", "unusual"), ("p2", "", "graph")]
    index = retrieval.build_index(spark.createDataFrame(rows, "id string, title string, abstract string"), max_features=2)
    found = [{(r["paper_id"], r["term"], round(r["weight"], 9)) for r in i.postings().collect()} for i in (index, index.materialize())]
    assert found[0] == found[1] and {p for p, _, _ in found[0]} == {"p0", "p2"}
    batch = pa.RecordBatch.from_pylist([{"paper_id": "a", "terms": ["x", "y"], "tfs": [1, 2]}, {"paper_id": "b", "terms": None, "tfs": None}])
    (cut,) = retrieval._within(["y", "z"])(iter([batch]))
    assert cut.to_pylist() == [{"paper_id": "a", "terms": ["y"], "tfs": [2]}, {"paper_id": "b", "terms": [], "tfs": []}]
