"""One query per operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailyfolio.llm import bags, decontam, htmltext, langid, lmscore, merkle, packing, pii, quality, simhash, spans, topk, urls
from dailyfolio.llm.words import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {
    "op9_url_filters": urls.sql(), "op11_merkle_manifest": merkle.sql(), "op12_exact_top_k_search": topk.sql(),
    "op13_ranked_lexical_search": bags.sql()}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query
def op2_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lmscore.score(docs, lmscore.fit(docs, good))


def _listed(spans_col: str) -> F.Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] != k), F.lit(True))).cast("bigint")  # noqa: B023
              .alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("all").alias("spans"))


@query
def op4_html_extraction(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"))


@query
def op7_benchmark_decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    leaks = F.col("__leaks")
    return found.select("doc_id", (F.size(leaks) > 0).alias("contaminated"),
                        F.transform(leaks, lambda x: x["item_id"]).alias("item_ids"),
                        F.array_max(F.transform(leaks, lambda x: x["coverage"])).alias("coverage"))


@query
def op8_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_url_filters(spark, sf_dir):
    pages = urls.parsed(table(spark, sf_dir, "pages"))
    return urls.judge_parsed(pages, urls.listed_by_words(pages))


@query
def op10_substring_dedup(spark, sf_dir):
    found = spans.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("__cut.removed")
    return found.select(
        "doc_id", F.size(removed).cast("bigint").alias("n_removed"),
        F.aggregate(removed, F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"]).alias("removed_chars"),
        F.array_join(F.transform(removed, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("removed"),
        F.sha2("__cut.text", 256).alias("kept_sha256"))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


@query
def op12_exact_top_k_search(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


@query
def op13_ranked_lexical_search(spark, sf_dir):
    return bags.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
