"""Texts sent to the scorer and to users, and the scorer's replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dailyfolio.functions.papers import author_line, format_authors
from dailyfolio.functions.text import strip, truncate_ellipsis
from dailyfolio.schemas import SCORE_REPLY

PERSONAL_AFTER = 30
ABSTRACT_CHARS = 400

# Message texts, as users see them.
INTRO_COLD = (
    "📬 *Today's paper digest is ready!*\n\n"
    "_Rate each paper to help me learn your taste. "
    f"After {PERSONAL_AFTER} ratings I'll start personalising your recommendations._"
)
INTRO_PERSONAL = (
    "📬 *Today's personalised digest is ready!*\n\n"
    "_Papers are ranked by your taste. Keep rating to refine your recommendations._"
)
MILESTONE = (
    "🎓 *I've learned enough to personalise your digest!*\n\n"
    "Your next digest will be ranked by your own preferences, not just topic keywords."
)
REQUEST_HEAD = "Researcher interests: "
REQUEST_ITEMS = "\n\nPapers to evaluate:\n"
REQUEST_TAIL = ("\n\nReturn a JSON array with ", " elements, one per paper, in the same order.")


def prompt_item(number: Column, title: Column, authors: Column, abstract: Column) -> Column:
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")),
        F.lit("\nAuthors: "), author_line(authors, ""),
        F.lit("\nAbstract: "),
        truncate_ellipsis(F.coalesce(abstract, F.lit("")), ABSTRACT_CHARS), F.lit("\n"),
    )


def request_text(profile: Column, block: Column, n: Column) -> Column:
    return F.concat(
        F.lit(REQUEST_HEAD), profile, F.lit(REQUEST_ITEMS), block,
        F.lit(REQUEST_TAIL[0]), n.cast("string"), F.lit(REQUEST_TAIL[1]),
    )


def strip_code_fence(text: Column) -> Column:
    """Remove Markdown code fences around a reply."""
    opened = F.regexp_replace(strip(text), r"(?m)^```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"(?m)\s*```$", "")


def parse_score_reply(text: Column) -> Column:
    """Reply text to array<struct<score double, reason string>>; null when it is not valid JSON.

    A missing or unreadable score counts as 0, a missing reason as empty.
    """
    # Wrapped in one more list, anything before or after the array is an error.
    wrapped = F.from_json(
        F.concat(F.lit("["), strip_code_fence(text), F.lit("]")), f"array<{SCORE_REPLY}>")
    items = F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))
    return F.transform(items, lambda item: F.struct(
        F.coalesce(item["score"].try_cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(item["reason"], F.lit("")).alias("reason"),
    ))


def render_message(title: Column, url: Column, authors: Column, source: Column, venue: Column,
                   reason: Column, score: Column) -> Column:
    """One paper as a Markdown message."""
    place = F.concat(
        F.replace(F.coalesce(source, F.lit("")), F.lit("_"), F.lit("\\_")),
        F.when(F.coalesce(venue, F.lit("")) != "", F.concat(F.lit(" · "), venue))
        .otherwise(F.lit("")),
    )
    why = (
        F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("\n💡 "), reason, F.lit("\n")))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.lit("*["), F.coalesce(title, F.lit("Untitled")), F.lit("]("),
        F.coalesce(url, F.lit("")), F.lit(")*\n_"), format_authors(authors), F.lit("_\n"),
        place, F.lit("\n"), why, F.lit("\n🔢 Relevance: "),
        F.format_number(F.coalesce(score.cast("double"), F.lit(0.0)), 1), F.lit("/10"),
    )


def digest_header(rating_count: Column) -> Column:
    return (
        F.when(rating_count >= PERSONAL_AFTER, F.lit(INTRO_PERSONAL)).otherwise(F.lit(INTRO_COLD))
    )


def is_milestone(rating_count: Column) -> Column:
    return rating_count == PERSONAL_AFTER
