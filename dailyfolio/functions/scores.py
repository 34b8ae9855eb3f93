"""Score arithmetic on decimals and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE = "decimal(4,2)"
VALID_RATINGS = (1, 5, 10)


def final_score(llm: Column, pref: Column) -> Column:
    """60/40 blend of the stored scores; one alone stands for itself."""
    a, b = llm.cast(SCORE), pref.cast(SCORE)
    blend = F.round(F.lit("0.6").cast("decimal(2,1)") * a + F.lit("0.4").cast("decimal(2,1)") * b, 2)
    return F.coalesce(blend.cast(SCORE), b, a)


def pref_score(prob: Column) -> Column:
    return (prob * 10).cast(SCORE)


def like_label(score: Column) -> Column:
    return (F.coalesce(score, F.lit(0)) >= 5).cast("int")


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def valid_rating(score: Column) -> Column:
    return score.isin(*VALID_RATINGS)
