"""Parsing of rating callbacks and chat commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dailyfolio.functions.scores import valid_rating
from dailyfolio.functions.text import WHITESPACE

# Whitespace as JavaScript's trim() and \s see it.
CHAT_SPACE = "".join(c for c in WHITESPACE if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"

# Commands in the order in which they are tried.
COMMANDS = ("start", "topics", "pause", "resume", "help", "frequency", "limit", "rating")
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
RATING_BUTTONS = (("👎", 1), ("👍", 5), ("❤️", 10))

AWAITING_TOPICS = "awaiting_topics"
AWAITING_DAY = "awaiting_frequency_start_day|"


def chat_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(CHAT_SPACE))


def leading_int(c: Column) -> Column:
    """Integer at the start of a text, ignoring what follows; null if there is none."""
    digits = F.regexp_extract(chat_strip(c), r"^([+-]?[0-9]+)", 1)
    return digits.try_cast("bigint")


def leading_float(c: Column) -> Column:
    number = F.regexp_extract(
        chat_strip(c), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return number.try_cast("double")


def parse_rating_callback(data: Column) -> Column:
    """``rate|<paper>|<score>`` as struct(paper_id, score, reason); reason is null when valid."""
    parts = F.split(F.coalesce(data, F.lit("")), r"\|")
    known = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "rate")
    score = leading_int(F.get(parts, F.lit(2)))
    accepted = F.coalesce(known & valid_rating(score), F.lit(False))
    return F.struct(
        F.when(known, F.get(parts, F.lit(1))).alias("paper_id"),
        F.when(accepted, score.cast("smallint")).alias("score"),
        F.when(~known, F.lit("Unknown action"))
        .when(~accepted, F.lit("Invalid score")).alias("reason"),
    )


def parse_command(text: Column) -> Column:
    """struct(command, days, papers, min_rating).

    ``command`` is a command name, ``text`` for anything else, null without text. The three
    arguments are null unless given and in range.
    """
    command = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for name in COMMANDS:
        command = command.when(F.startswith(text, F.lit("/" + name)), F.lit(name))
    command = command.otherwise(F.lit("text"))
    words = F.split(chat_strip(text), "[" + CHAT_SPACE + "]+")
    arg = F.get(words, F.lit(1))
    whole, real = leading_int(arg), leading_float(arg)
    return F.struct(
        command.alias("command"),
        F.when((command == "frequency") & whole.between(1, 365), whole.cast("int")).alias("days"),
        F.when((command == "limit") & whole.between(1, 50), whole.cast("int")).alias("papers"),
        F.when((command == "rating") & real.between(0, 10), real.cast("decimal(3,1)"))
        .alias("min_rating"),
    )


def next_weekday_on_or_after(day: Column, name: Column) -> Column:
    """First date from ``day`` on that falls on the named weekday; null for an unknown name."""
    wanted = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.lower(chat_strip(name)))
    ahead = F.pmod(wanted.cast("int") - F.dayofweek(day), F.lit(7))
    return F.when(wanted > 0, F.date_add(day, ahead))


def rating_actions(paper_id: Column) -> Column:
    """The three rating buttons of a paper as array<struct<label, data>>."""
    return F.array(*[
        F.struct(
            F.lit(label).alias("label"),
            F.concat(F.lit("rate|"), paper_id, F.lit(f"|{score}")).alias("data"),
        )
        for label, score in RATING_BUTTONS
    ])
