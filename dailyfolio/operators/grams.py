"""Texts as their words, which travel instead of their 1- and 2-grams and are counted where they arrive.

The grams of a text take several times the bytes of its words. Operators that join texts to something else take either packed counts
(paper_id, terms, tfs) or uncounted words (paper_id, words), and count what comes out of the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.functions.text import ENGLISH_STOP_WORDS, doc_text, remove_stop_words, tokens


def paper_words(papers: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Rows (paper_id, words) of papers (id, title, abstract): the words that count, joined by spaces, which no word holds."""
    text = doc_text(F.col("title"), F.col("abstract"))
    return papers.select(F.col("id").alias("paper_id"), F.concat_ws(" ", remove_stop_words(tokens(text), stop_words)).alias("words"))


def counted(rows: DataFrame) -> DataFrame:
    """Rows with packed counts (terms, tfs) in place of ``words``; rows that hold counts stay as they are. Null words give no terms."""
    if "words" not in rows.columns:
        return rows
    from dailyfolio.operators.retrieval import counted_words

    return counted_words(rows.withColumn("_w", F.filter(F.split("words", " "), lambda w: w != "")).drop("words"))
