"""Chat commands folded into user settings, without a per-chat loop.

A chat is a small state machine: some commands leave a question pending, and a later free
text may answer it. The fold finds, for each text, the command that governs it and, for each
command, the first text that answers it. Both are window and aggregate steps over bounded
ranges of update ids, so one very busy chat is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.functions.bot import (
    AWAITING_DAY, AWAITING_TOPICS, chat_strip, leading_int, next_weekday_on_or_after,
    parse_command)
from dailyfolio.operators.ranking import CHUNK_ROWS, last_before
from dailyfolio.operators.users import DEFAULTS

# New users are numbered in this many interleaved sequences.
ID_LANES = 64


def _live_updates(updates: DataFrame, users: DataFrame) -> DataFrame:
    """Parsed updates of chats that have a user, from the creating /start on."""
    parsed = (
        updates.select("update_id", "ts", "chat_id", "text",
                       parse_command(F.col("text")).alias("_c"))
        .select("update_id", "ts", "chat_id", "text", "_c.*").where(F.col("command").isNotNull())
    )
    starts = parsed.groupBy("chat_id").agg(
        F.min(F.when(F.col("command") == "start", F.col("update_id"))).alias("start_id"))
    known = users.select("chat_id", F.lit(True).alias("known"),
                         F.coalesce("pending_action", F.lit("")).alias("pending_before"))
    chats = starts.join(known, "chat_id", "left").where("known or start_id is not null")
    return parsed.join(chats, "chat_id").where("known or update_id >= start_id")


def settings_changes(updates: DataFrame, users: DataFrame,
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Net effect of a log of messages per chat.

    Null means unchanged, except for ``pending_action``, which counts if ``pending_set``.
    ``created_at`` is set for chats that the log creates.
    """
    creates = F.col("known").isNull() & (F.col("update_id") == F.col("start_id"))
    asks: Column = (
        F.when((F.col("command") == "topics") | creates, F.lit(AWAITING_TOPICS))
        .when(F.col("days") == 1, F.lit(""))
        .when(F.col("days") > 1, F.concat(F.lit(AWAITING_DAY), F.col("days").cast("string")))
    )
    live = _live_updates(updates, users).withColumn("asks", asks)
    state = F.when(F.col("asks").isNotNull(),
                   F.struct(F.col("update_id").alias("at"), F.col("asks").alias("pending")))
    placed = last_before(live, ["chat_id"], "update_id", state, "governed", chunk_rows)
    pending = F.coalesce("governed.pending", "pending_before", F.lit(""))
    since = F.coalesce(F.col("governed.at"), F.lit(-1))
    answer_day = next_weekday_on_or_after(F.to_date("ts"), F.col("text"))
    answers = (
        placed.where(F.col("command") == "text")
        .select("chat_id", "update_id", "text", since.alias("since"), pending.alias("pending"),
                answer_day.alias("day"))
        .where((F.col("pending") == AWAITING_TOPICS)
               | (F.startswith("pending", F.lit(AWAITING_DAY)) & F.col("day").isNotNull()))
        .groupBy("chat_id", "since")
        .agg(F.min_by(F.struct("update_id", "text", "pending", "day"), "update_id").alias("a"))
        .select("chat_id", "a.*")
    )
    command = F.col("command")
    none = {"profile": "string", "active": "boolean", "papers": "int", "min_rating":
            "decimal(3,1)", "days": "int", "next": "date", "pending": "string",
            "created_at": "timestamp"}

    def effect(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("chat_id", "update_id", *[
            given.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    daily = F.col("days") == 1
    from_commands = effect(
        live,
        active=F.when(command == "pause", F.lit(False)).when(command == "resume", F.lit(True)),
        papers=F.col("papers"), min_rating=F.col("min_rating"),
        days=F.when(daily, F.lit(1)), next=F.when(daily, F.to_date("ts")),
        pending=F.col("asks"), created_at=F.when(creates, F.col("ts")))
    topics = F.col("pending") == AWAITING_TOPICS
    from_answers = effect(
        answers,
        profile=F.when(topics, chat_strip(F.col("text"))), active=F.when(topics, F.lit(True)),
        days=F.when(~topics, leading_int(F.element_at(F.split("pending", r"\|"), 2))),
        next=F.when(~topics, F.col("day")), pending=F.lit(""))
    effects = from_commands.unionByName(from_answers)

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("update_id")))

    net = effects.groupBy("chat_id").agg(*[latest(c).alias(c) for c in none])
    return net.select(
        "chat_id", F.col("profile").alias("keyword_profile"), "active",
        F.col("papers").alias("max_papers"), F.col("days").alias("digest_frequency"),
        F.col("next").alias("next_digest_date"), "min_rating",
        F.col("pending").isNotNull().alias("pending_set"),
        F.nullif("pending", F.lit("")).alias("pending_action"), "created_at")


def apply_settings(users: DataFrame, changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Users with the changes merged in column by column and new chats added.

    One full outer join; users and changes are of one row per chat, so no key is hot. ``users`` may be those of
    the changed chats alone; ``known``, all of them, then tells which ids are taken.
    """
    last_id = (users if known is None else known).agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    defaults = {
        "active": F.lit(True), "max_papers": F.lit(DEFAULTS["max_papers"]),
        "digest_frequency": F.lit(DEFAULTS["digest_frequency"]),
        "min_rating": F.lit(DEFAULTS["min_rating"]).cast("decimal(3,1)"),
        "next_digest_date": F.to_date("_created_at"), "keyword_profile": F.lit(None)}
    renamed = changes.select("chat_id", *[
        F.col(c).alias(f"_{c}") for c in changes.columns if c != "chat_id"])
    lane = F.pmod(F.xxhash64("chat_id"), F.lit(ID_LANES))
    place = F.row_number().over(Window.partitionBy("_new", "_lane").orderBy("chat_id"))
    merged = (
        users.join(renamed, "chat_id", "full")
        .withColumns({"_new": F.col("id").isNull(), "_lane": lane})
        .withColumns({"_place": place, "_last_id": last_id})
    )
    fresh_id = F.col("_last_id") + ID_LANES * (F.col("_place") - 1) + F.col("_lane") + 1
    out = {
        "id": F.coalesce("id", fresh_id),
        "created_at": F.coalesce("created_at", "_created_at"),
        "pending_action": F.when(F.col("_pending_set"), F.col("_pending_action"))
        .otherwise(F.col("pending_action")),
        **{c: F.coalesce(F.col(f"_{c}"), F.col(c), F.when(F.col("_new"), d))
           for c, d in defaults.items()}}
    return merged.select(*[out.get(c, F.col(c)).alias(c) for c in users.columns])


def settings_from_log(updates: DataFrame, users: DataFrame,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The users table after a log of messages, for replay and backfill."""
    return apply_settings(users, settings_changes(updates, users, chunk_rows))


def settings_last_value(updates: DataFrame) -> DataFrame:
    """Last digest size, minimum rating and pause state set per chat, ignoring who exists."""
    c = parse_command(F.col("text"))
    rows = updates.select("chat_id", "update_id", c.alias("_c")).select(
        "chat_id", "update_id", "_c.*")
    at = F.col("update_id")
    active = F.when(F.col("command") == "resume", F.lit(True)).when(
        F.col("command") == "pause", F.lit(False))
    return rows.withColumn("active", active).groupBy("chat_id").agg(*[
        F.max_by(col, F.when(F.col(col).isNotNull(), at)).alias(name)
        for col, name in (("papers", "max_papers"), ("min_rating", "min_rating"),
                          ("active", "active"))])
