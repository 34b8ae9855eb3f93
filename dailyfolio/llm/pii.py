"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find the base spans, which always stay. The field then works on the neighbourhoods
of digits, ``@``, ``=``, ``+`` and of what follows a name like ``password:``: every run of up to ``MAX_CHUNKS`` chunks is a candidate
segment, described by features of the whole span (its shape, digit counts, checksums, context). Chunks are parted by white space;
longer ones, and those that look like a record, also by quotes, brackets and other marks, so none is too long to be looked at.
A dynamic program over segments of a bounded number of chunks picks boundaries and types together; features are held for a block of
chunks at a time. It is trained on the base spans and on plain forms of secrets in a bounded sample, so that what it
adds are spans that look and stand like those.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: Chunks of a segment, characters from which a chunk is parted at marks too, chunks of context.
MAX_CHUNKS = 6
LONG_CHUNK = 200
CONTEXT = 2
#: First chunks of the segments whose features are held at once.
BLOCK_CHUNKS = 1024
#: Expected distinct texts of the training sample, chosen by a hash, neighbourhoods kept of each, and
#: the chunks and characters that one may have there (longer ones are cut, for the training only).
FIT_DOCS = 3000
FIT_PER_DOC = 8
FIT_CHUNKS = 64
FIT_CHARS = 2000
#: How far a segment's score must lie above that of no entity.
MARGIN = 2.0
SHAPES = 2048
EPOCHS = 6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@=+]")
_CHUNK = re.compile(r"\S+")
_PIECE = re.compile(r"[^\s\"'`,;:&|{}\[\]()<>]+")
#: What announces a secret; the chunk behind it is looked at whatever it holds.
_NAME = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?(?=\S)")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text)
                if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


#: Plain forms of secrets that the field learns from: keys of a fixed form, named values.
_KEY = re.compile(r"\b[A-Z]{4}[0-9A-Z]{16}\b")
_NAMED = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?\"?([^\s\",;]{6,})")


def _seed_secrets(text: str) -> list[Span]:
    out = [("secret", *m.span()) for m in _KEY.finditer(text)]
    for m in _NAMED.finditer(text):
        spaced = any(c.isspace() for c in text[m.start():m.start(1)])
        out.append(("secret", m.start(1) if spaced else m.start(), m.end(1)))
    return out


@dataclass(frozen=True)
class Region:
    """Candidate segments of a neighbourhood as rows (first chunk, last chunk, start, end), with their features."""

    chunks: int
    segments: np.ndarray
    features: np.ndarray  # segments x active indices


def _bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without the punctuation around it."""
    while start < end and text[start] in "\"'`<[{,;:.!?":
        start += 1
    while start < end and text[end - 1] in "\"'`>]},;:.!?":
        end -= 1
    if end > start and text[end - 1] == ")" and "(" not in text[start:end]:
        end -= 1
    if end > start and text[start] == "(" and ")" not in text[start:end]:
        start += 1
    return start, end


_SHAPE = str.maketrans(
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "9" * 10 + "A" * 26 + "a" * 26)
_RUNS = re.compile(r"(.)\1+")
_ALNUM = re.compile(r"[9aA]+")
_HEX = frozenset("0123456789abcdef")
#: Feature slots besides the hashed shapes: each holds a small class.
_SLOTS = 12
_SLOT_SIZE = 16
FEATURES = SHAPES + _SLOTS * _SLOT_SIZE


def _mixed(run: re.Match) -> str:
    """Digits and letters in turn, as in keys, are one class."""
    return "x" if "9" in run[0] and run[0].strip("9") else run[0]


def _features(text: str, before: str, chunks: int) -> list[int]:
    shape = _RUNS.sub(r"\1", _ALNUM.sub(_mixed, text.translate(_SHAPE)))
    n = len(text)
    digits = sum(map(str.isdecimal, text))
    letters = sum(map(str.isalpha, text))
    plain = text.replace(" ", "").replace("-", "")
    dotted = text.split(".")
    name = before.lower().rstrip(" \"'=:(")
    slots = (
        chunks,
        min(digits, 20) // 2,
        min(n // 4, 15),
        int(10 * letters / n),
        1 + (plain.isdecimal() and 16 <= len(plain) <= 19) + (plain.isdecimal() and luhn(plain)),
        1 + ("@" in text) + 2 * ("." in text[text.find("@") + 1:]),
        1 + (len(dotted) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in dotted)),
        1 + (text[0] == "+") + 2 * (text[0] == "("),
        1 + ("=" in text) + 2 * any(c in text for c in "_/"),
        min(15, int(16 * sum(c in _HEX for c in text) / n)) if n >= 16 else 0,
        next((k for k, w in enumerate(("password", "passwd", "secret", "token", "key"), 1)
              if name.endswith(w) or w in text.lower()), 0),
        1 + ("=" in before[-3:]) + 2 * (n == 20 and text.isupper() and digits > 0 and letters > 0),
    )
    return [zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES,
            *(SHAPES + k * _SLOT_SIZE + min(int(v), _SLOT_SIZE - 1) for k, v in enumerate(slots))]


#: Short segments repeat (numbers, words after names); those of tables nearly all do.
_short_features = lru_cache(1 << 14)(_features)


def chunks_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks."""
    out: list[int] = []
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        if b - a > LONG_CHUNK or text.find('":', a, b) >= 0:
            for p in _PIECE.finditer(text, a, b):
                out += p.span()
        else:
            out += (a, b)
    flat = np.array(out, np.int64)
    return flat[::2], flat[1::2]


def neighbourhoods(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of chunks around triggers: their starts, their ends, and which of them hold a trigger."""
    if not _TRIGGER.search(text) and not _NAME.search(text):
        return
    starts, ends = chunks_of(text)
    marks = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    marks = np.concatenate([marks, np.fromiter((m.end() for m in _NAME.finditer(text)), np.int64)])
    hit = np.unique(np.searchsorted(starts, marks, "right") - 1)
    hit = hit[hit >= 0]
    if not len(hit):
        return
    for run in np.split(hit, np.flatnonzero(np.diff(hit) > 2 * CONTEXT) + 1):
        low, high = max(0, int(run[0]) - CONTEXT), min(len(starts), int(run[-1]) + CONTEXT + 1)
        triggered = np.zeros(high - low, bool)
        triggered[run - low] = True
        yield starts[low:high], ends[low:high], triggered


def segments_of(text: str, starts: np.ndarray, ends: np.ndarray, triggered: np.ndarray) -> Iterator[Region]:
    """The candidate segments of a neighbourhood, a block of first chunks at a time.

    A segment begins and ends with a chunk that holds a trigger.
    """
    places = np.flatnonzero(triggered)
    for at in range(0, len(places), BLOCK_CHUNKS):
        segments, features = [], []
        for i in places[at:at + BLOCK_CHUNKS].tolist():
            for j in range(i, min(len(starts), i + MAX_CHUNKS)):
                if triggered[j]:
                    a, b = _bounds(text, int(starts[i]), int(ends[j]))
                    if a < b:
                        segments.append((i, j, a, b))
                        of = _short_features if b - a <= 64 else _features
                        features.append(of(text[a:b], text[max(0, a - 16):a], j - i + 1))
        if segments:
            yield Region(len(starts), np.array(segments, np.int64), np.array(features, np.int64))


def regions(text: str) -> Iterator[Region]:
    """The neighbourhoods with all their segments, in order; for texts of bounded length."""
    for starts, ends, triggered in neighbourhoods(text):
        parts = list(segments_of(text, starts, ends, triggered))
        if parts:
            yield Region(len(starts), np.concatenate([p.segments for p in parts]), np.concatenate([p.features for p in parts]))


@dataclass(frozen=True)
class Field:
    """Weights of features and kinds; the score of no entity is zero."""

    weights: np.ndarray  # FEATURES x kinds

    def _promising(self, parts: Iterator[Region]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segments that score above no entity, with their best kinds and scores."""
        segments, kinds, scores = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for part in parts:
            score = self.weights[part.features].sum(1) - MARGIN
            kind = score.argmax(1)
            score = score[np.arange(len(kind)), kind]
            keep = score > 0
            segments.append(part.segments[keep])
            kinds.append(kind[keep])
            scores.append(score[keep])
        return np.concatenate(segments), np.concatenate(kinds), np.concatenate(scores)

    def segments(self, chunks: int, parts: Iterator[Region]) -> list[Span]:
        """The best segmentation of a neighbourhood: kinds and boundaries chosen together."""
        segments, kinds, scores = self._promising(parts)
        best = [0.0] * (chunks + 1)
        back: dict[int, int] = {}
        ending: dict[int, list[int]] = {}
        for k, j in enumerate(segments[:, 1].tolist()):
            ending.setdefault(j + 1, []).append(k)
        for at in range(1, chunks + 1):
            best[at] = best[at - 1]
            for k in ending.get(at, ()):
                total = best[segments[k, 0]] + scores[k]
                if total > best[at]:
                    best[at], back[at] = total, k
        out, at = [], chunks
        while at > 0:
            k = back.get(at)
            if k is None:
                at -= 1
            else:
                i, _, a, b = segments[k].tolist()
                out.append((KINDS[kinds[k]], a, b))
                at = i
        return out[::-1]


def _marginals(region: Region, score: np.ndarray) -> tuple[np.ndarray, float]:
    """The probability of each segment and kind, and the log of the normaliser."""
    n = region.chunks
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    total = np.logaddexp.reduce(score, axis=1)
    for k, (i, j, _, _) in enumerate(region.segments.tolist()):
        by_end.setdefault(j + 1, []).append(k)
        by_start.setdefault(i, []).append(k)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for at in range(1, n + 1):
        alpha[at] = np.logaddexp.reduce(
            [alpha[at - 1], *(alpha[region.segments[k][0]] + total[k] for k in by_end.get(at, ()))])
    for at in range(n - 1, -1, -1):
        beta[at] = np.logaddexp.reduce(
            [beta[at + 1], *(beta[region.segments[k][1] + 1] + total[k] for k in by_start.get(at, ()))])
    edges = np.array([alpha[i] + beta[j + 1] for i, j, _, _ in region.segments.tolist()]) - alpha[n]
    return np.exp(score + edges[:, None]), float(alpha[n])


def train(examples: list[tuple[Region, list[tuple[int, int]]]], epochs: int = EPOCHS, rate: float = 0.3,
          decay: float = 1e-4) -> Field:
    """Conditional likelihood by stochastic gradients; gold is (segment, kind) per region, in a fixed order."""
    w = np.zeros((FEATURES, len(KINDS)))
    size = np.full((FEATURES, len(KINDS)), 1e-3)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for at in rng.permutation(len(examples)).tolist():
            region, gold = examples[at]
            p, _ = _marginals(region, w[region.features].sum(1))
            for k, kind in gold:
                p[k, kind] -= 1.0
            active = region.features.shape[1]
            uniq, inverse = np.unique(region.features.ravel(), return_inverse=True)
            total = np.zeros((len(uniq), len(KINDS)))
            np.add.at(total, inverse, np.repeat(p, active, axis=0))
            total += decay * w[uniq]
            size[uniq] += total ** 2
            w[uniq] -= rate * total / np.sqrt(size[uniq])
    return Field(w)


def examples_of(text: str, secrets: list[Span] | None = None) -> list[tuple[Region, list[tuple[int, int]]]]:
    """Regions with the seed spans (or the given ``secrets``) that coincide with a candidate segment."""
    known = _seed_secrets(text) if secrets is None else secrets
    seeds = {(a, b): KINDS.index(k) for k, a, b in [*known, *base_spans(text)]}
    out = []
    for region in regions(text):
        gold, end = [], -1
        for k, (_, _, a, b) in enumerate(region.segments.tolist()):
            if (a, b) in seeds and a >= end:
                gold.append((k, seeds[a, b]))
                end = b
        out.append((region, gold))
    return out


def made_examples(n: int = 240) -> list[tuple[str, list[Span]]]:
    """Short texts that hold a made-up secret of each plain form, for samples that have few, with its place."""
    rng = np.random.default_rng(0)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    hexes, upper, small = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = upper + small
    out = []
    for i in range(n):
        name = ("password", "passwd", "secret", "token", "api_key")[i % 5]
        key, short = pick(hexes, 24 + i % 20), pick(hexes, 12 + i % 12)
        form, held = (  # the text of a form, and what of it is the secret
            (f"{name}={short}",) * 2, (f'{name} = "{key}"', key), (f"AKIA{pick(upper, 16)}",) * 2,
            (f"{name}: {(letters := pick(small, 8 + i % 14))}", letters),
            ((token := f"{pick(small, 2 + i // 8 % 5)}{'_-'[i // 8 % 2]}{pick(mixed, 20 + i // 8)}"), token),
            (f'{{"id":"{i}","{name}":"{(value := pick(mixed, 12 + i % 20))}","on":"yes"}}', value),
            (f"{name}={(whole := pick(mixed, 210 + i))}", f"{name}={whole}"),
            (f"{name}: {pick(small, 2 + i // 8 % 5)}", ""))[i % 8]  # a short word is none
        around = [pick(small, 2 + (i + k) % 7) for k in range(4)]
        text = f"{around[0]} {around[1]} {form} {around[2]} {around[3]}, {i % 90} {around[0]}{'.' if i % 2 else ''}"
        at = text.index(held)
        out.append((text, [("secret", at, at + len(held))] if held else []))
    return out


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text of the first neighbourhoods of each text, cut to the size of training examples."""
    for batch in batches:
        cut = []
        for text in batch["text"]:
            for starts, ends, _ in islice(neighbourhoods(text), FIT_PER_DOC):
                a, b = int(starts[0]), int(ends[min(len(ends), FIT_CHUNKS) - 1])
                cut.append(text[max(0, a - 16):min(b, a + FIT_CHARS)])
        yield pd.DataFrame({"text": cut}, dtype=object)


def fit(docs: DataFrame, sample: int = FIT_DOCS) -> Field:
    """Trains on about ``sample`` distinct texts, chosen by a hash of the text, and on ``made_examples``.

    The driver gets at most ``FIT_PER_DOC`` neighbourhoods of ``FIT_CHARS`` characters of each. Null and empty texts
    have none; a text that repeats counts once; an empty table leaves the made-up examples.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    share = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    total = max(1, docs.count())
    rows = texts.filter(share * total < sample).distinct().mapInPandas(_near, "text string").toPandas()
    examples = [x for text in sorted(rows["text"]) for x in examples_of(text)]
    return train(examples + [x for text, secrets in made_examples() for x in examples_of(text, secrets)])


def spans_of(text: str, field: Field) -> list[Span]:
    """All spans by kind as listed, then start: base spans, and what the field adds beside them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    added = []
    for near in neighbourhoods(text):
        for kind, a, b in field.segments(len(near[0]), segments_of(text, *near)):
            k = int(np.searchsorted(starts, b)) - 1
            if k < 0 or reach[k] <= a:
                added.append((kind, a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base + added, key=lambda s: (order[s[0]], s[1], s[2]))


SPANS = "struct<base: array<struct<kind: string, start: int, end: int>>, all: array<struct<kind: string, start: int, end: int>>>"


def finder(field: Field):
    """A pandas UDF of the text: the ``base`` spans and ``all`` spans."""
    names = ("kind", "start", "end")

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.DataFrame:
        texts = [x if isinstance(x, str) else "" for x in texts]
        return pd.DataFrame({
            "base": pd.Series([[dict(zip(names, s)) for s in base_spans(x)] for x in texts], dtype=object),
            "all": pd.Series([[dict(zip(names, s)) for s in spans_of(x, field)] for x in texts], dtype=object)})

    return find.asNondeterministic()


def find_spans(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id`` and the spans of every row: ``base`` and ``all``, in code points, end exclusive.

    Null and empty texts have none; rows that repeat give equal results; no other column is read.
    """
    return docs.select("doc_id", finder(field)(F.col("text")).alias("s")).select("doc_id", "s.*")


def masked(text: str | None, field: Field) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, longest."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b in sorted(spans_of(text, field), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
            last = b
        elif b > last:  # the rest of a span that begins inside another goes with it
            last = b
    return "".join([*out, text[last:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with personal data masked; ``n_chars`` becomes the length of the new text.

    A null text stays null (and its ``n_chars`` becomes null), an empty one empty. Every row is masked by itself, so rows that repeat
    stay equal; all other columns are kept.
    """

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(x if isinstance(x, str) else None, field) for x in texts], dtype=object)

    out = docs.withColumn("text", cover.asNondeterministic()(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
