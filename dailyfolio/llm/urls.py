"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The list is folded into blocks of eight 64-bit words; a URL sets one bit in each word of its
block. The blocks are a table of bounded size that is broadcast to the pages; what passes is a possible
hit and goes to an exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailyfolio.session import written

#: Rules: verdict, host, start of the path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of a host name that put its pages on the list that the query derives.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx")

WORDS = 8
URLS_PER_BLOCK = 32
#: Blocks at most (64 bytes each): beyond it the filter passes more, and the join removes more.
MOST_BLOCKS = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without trailing ``/``, ``index`` or ``.html``; no query, no fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"(/|/index\.html?|\.html?)$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bit(url: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(url, F.lit(1)), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table ``(block, word0..word7)`` of at most ``blocks`` rows."""
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col("canonical"), k)).alias(f"word{k}") for k in range(WORDS)])


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, canonical`` of every row, as a table: the pages themselves are read once, by their url only."""
    url = F.col("url")
    return written(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                                canonical(url).alias("canonical")), "parsed-urls")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``listed`` has a column ``canonical``. A rule decides where one fits, the list elsewhere: block if
    listed, else allow. A null url, or one without ``://``, has an empty host and path, and no rule. Rows that
    repeat get equal results; an empty list allows; urls of any length are taken whole; other columns are not read.
    """
    return judge_parsed(parsed(pages), listed, rules)


def judge_parsed(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """As ``judge``, of rows from ``parsed``."""
    known = written(listed.select("canonical").filter("canonical <> ''").distinct(), "listed")
    blocks = int(min(MOST_BLOCKS, max(1, known.count() // URLS_PER_BLOCK + 1)))
    table = written(bloom(known, blocks), "bloom")
    rows = pages.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    columns = ["page_id", "host", "path"]
    ruled = rows.filter("fit is not null").select(*columns, "fit.rule", "fit.verdict")
    open_ = rows.filter("fit is null").withColumn("block", _block(F.col("canonical"), blocks))
    tested = open_.join(F.broadcast(table), "block", "left")  # at most MOST_BLOCKS rows of 72 bytes
    possible = F.lit(True)
    for k in range(WORDS):
        possible = possible & (F.coalesce(F.col(f"word{k}"), F.lit(0)).bitwiseAND(_bit(F.col("canonical"), k)) != 0)
    none = F.lit(None).cast("string")
    free = tested.filter(~possible).select(*columns, none.alias("rule"), F.lit("allow").alias("verdict"))
    hits = (tested.filter(possible).select(*columns, "canonical")
            .join(known.withColumn("found", F.lit("block")), "canonical", "left")
            .select(*columns, none.alias("rule"), F.coalesce("found", F.lit("allow")).alias("verdict")))
    return ruled.unionByName(free).unionByName(hits)


def listed_by_words(pages: DataFrame, words=LISTED_WORDS) -> DataFrame:
    """Canonical URLs of the parsed pages whose host has one of the words between dots and hyphens.

    A list for want of a given one: ``judge`` takes any.
    """
    pattern = rf"(^|[.-])({'|'.join(words)})([.-]|$)"
    return pages.filter(F.col("host").rlike(pattern)).select("canonical")


def sql(rules=RULES, words=LISTED_WORDS) -> str:
    """The same over a view ``pages``, for DuckDB."""
    host = "translate(regexp_extract(rest, '^([^/?#]*)', 1), '{0}', '{1}')".format(_UPPER, _LOWER)
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda pick: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'"
        for v, h, p in order) + " END"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|/index\\.html?|\\.html?)$', '') AS canonical,
         {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM parts),
listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|[.-])({'|'.join(words)})([.-]|$)'))
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN canonical <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named"""
