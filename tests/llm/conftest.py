import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score int, spans string"

WORDS = "the stone river carried small boats along green valley where people sang about winter light and bread".split()


def prose(seed: int, n: int) -> str:
    """Deterministic filler: words picked by a multiplicative walk, in short sentences."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 48271) % 2147483647
        word = WORDS[x % len(WORDS)] + ("" if x % 5 else WORDS[x // 7 % len(WORDS)])
        out.append(word + ("." if i % 9 == 8 else ""))
    return " ".join(out)


ODD = [None, "", "   ", "\n\n\t", "!!! ... ###", "a", "Ünïcode ßtraße 漢字 \U00020000 \U0001F600", "x" * 20_000,
       "word " * 30_000, "..\n" * 5_000, "1" * 5_000, "@" * 3_000, "<p>" * 3_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, odd and very long texts, repeated rows, extra columns with names that operators use."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "f", 1, "x") for i, t in enumerate(ODD)]
    rows += [rows[5], rows[6], (None, "lonely text without an id", None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], "s", len(t or ""), "f", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
