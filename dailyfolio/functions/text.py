"""Text expressions. All of them stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() and \s of the Python re module see it.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The English stop words that ship with Spark ML.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
    they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
    wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
    """.split()
)


def strip(c: Column) -> Column:
    """Trim any Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_line(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def normalize_title(c: Column) -> Column:
    """Lower case, keep only a-z, 0-9 and whitespace, collapse whitespace, trim."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s\x1c-\x1f]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f]+", " "))


def title_hash(c: Column) -> Column:
    return F.sha2(normalize_title(c), 256)


def doc_text(title: Column, abstract: Column) -> Column:
    """Title and abstract as one text; a missing part counts as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def truncate_ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased words of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"))


def remove_stop_words(toks: Column, words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words, keeping order and repeats."""
    if not words:
        return toks
    return F.filter(toks, lambda t: ~t.isin(list(words)))


def bigrams(toks: Column) -> Column:
    """Neighbouring words joined by a space; empty for fewer than two words."""
    rest = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(
        F.slice(toks, F.lit(1), rest), F.slice(toks, F.lit(2), rest),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def ngrams(toks: Column) -> Column:
    """Words followed by their bigrams."""
    return F.concat(toks, bigrams(toks))
