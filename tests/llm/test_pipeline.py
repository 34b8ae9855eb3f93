import corpus_pipeline
import __spark_entry__ as contract
from dailyfolio.llm.words import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and docs.count() == len(kept), name
        assert len(kept) >= 0.85 * len(ids)
        ids = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == ids


def test_stages_pass_odd_tables(spark, odd, nothing, tmp_path):
    for rows, name in ((odd, "odd"), (nothing, "nothing")):
        docs = rows
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            path = f"{tmp_path}/{name}-{step}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if step != "packing":
                assert docs.columns == rows.columns


def test_every_operator_is_registered():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
