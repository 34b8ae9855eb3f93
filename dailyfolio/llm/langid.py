"""Language identification by the nearest of several centroids per language.

A text is the sublinear TF-IDF vector of its letter n-grams (one to three, inside and across word
edges), hashed to a fixed number of features and normalised. The labelled texts of each language
are clustered by spherical k-means; a text takes the language of the centroid with the largest
cosine, and is rejected if that cosine is far below what texts of its length reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailyfolio.llm.words import blocks, codes_of, tables

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: Expected labelled texts per language that the centroids are fitted on (chosen by a hash of the id).
FIT_TEXTS = 400
#: Largest model in bytes that is sent to the tasks; more languages than that need fewer features.
MODEL_BYTES = 256 << 20
#: A text is rejected below this share of the cosine that all but the lowest of its length reach.
REJECT_SHARE = 0.5
LOWEST = 0.01
LENGTHS = 24
LEAST_TEXTS = 20
#: Steps in which cosines are counted.
STEPS = 2000
UNKNOWN = "und"

#: Texts and code points whose dense vectors are held at once.
BLOCK = (100_000, 32)

_SPACE = np.uint32(32)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts (texts x FEATURES) and the number of letters of each text.

    Runs of other characters are one space, which counts only between or beside letters.
    """
    t = tables()
    out = np.zeros((len(texts), FEATURES), np.float32)
    letters = np.zeros(len(texts), np.int64)
    longest = max(ORDERS)
    for i, text in enumerate(texts):
        codes = codes_of(text)
        for at in range(0, len(codes), 1_000_000):
            lead = min(at, longest - 1)
            part = np.minimum(codes[at - lead:at + 1_000_000], 0x20000)
            letter = t.letter[part]
            letters[i] += int(letter[lead:].sum())
            part = np.where(letter, t.lower[part], _SPACE)
            keep = np.ones(len(part), bool)
            keep[1:] = letter[1:] | letter[:-1]
            part = part[keep].astype(np.uint64)
            gram = np.zeros(len(part), np.uint64)
            buckets = []
            for n in range(1, longest + 1):
                gram = gram[:max(0, len(part) - n + 1)] * np.uint64(0x1FFFFF) + part[n - 1:]
                if n in ORDERS:
                    known = gram[part[:len(gram)] != _SPACE] if n == 1 else gram
                    buckets.append((known + np.uint64(n)) * _SPREAD >> np.uint64(64 - FEATURE_BITS))
            out[i] += np.bincount(np.concatenate(buckets).astype(np.int64), minlength=FEATURES)
    return out, letters


def _vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, letters = _counts(texts)
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12), letters


def _length(letters: np.ndarray) -> np.ndarray:
    """Half-octave classes of text length."""
    return np.minimum(np.log2(np.maximum(letters, 1)) * 1.5, LENGTHS - 1).astype(np.int64)


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; fewer distinct vectors make fewer centroids."""
    centre = [x.mean(0)]
    centre[0] = centre[0] / max(np.linalg.norm(centre[0]), 1e-12)
    nearest = x @ centre[0]
    for _ in range(k - 1):
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-6:
            break
        centre.append(x[at])
        nearest = np.maximum(nearest, x @ x[at])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        new = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str]) -> pd.DataFrame:
        x, letters = _vectors(texts, self.idf)
        near = x @ self.centroids.T
        best = near.argmax(1) if near.shape[1] else np.zeros(len(x), np.int64)
        score = np.clip(near.max(1), 0.0, 1.0) if near.shape[1] else np.zeros(len(x))
        none = (letters == 0) | (near.shape[1] == 0)
        lang = [UNKNOWN if n else self.langs[b] for n, b in zip(none, best)]
        return pd.DataFrame({
            "lang_pred": lang, "score": np.where(none, 0.0, score).astype(float),
            "rejected": none | (score < self.floors[_length(letters)])})


def _floors(counts: np.ndarray) -> np.ndarray:
    """The smallest cosine that each class of length passes with, from the cosines of all training texts.

    ``counts`` has a row per class and a column per step of the cosine; a class is taken together with its neighbours.
    Where those are fewer than ``LEAST_TEXTS``, the nearest shorter class stands in; below the first that has them, where
    a handful of n-grams says little, a quarter of its floor is enough.
    """
    floors = np.full(LENGTHS, np.nan)
    for j in range(LENGTHS):
        near = counts[max(0, j - 1):j + 2].sum(0)
        if near.sum() >= LEAST_TEXTS:
            floors[j] = REJECT_SHARE * np.searchsorted(np.cumsum(near), max(1, near.sum() * LOWEST)) / STEPS
        elif j:
            floors[j] = floors[j - 1]
    first = floors[~np.isnan(floors)]
    return np.where(np.isnan(floors), first[0] / 4 if len(first) else 0.0, floors)


def is_training(doc_id) -> F.Column:
    """Whether a document may be learned from: three of four, by CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for _, texts in blocks(batch["text"], *BLOCK):
            seen[:FEATURES] += (_counts(texts)[0] > 0).sum(0)
            seen[FEATURES] += len(texts)
    yield pd.DataFrame({"feature": np.arange(FEATURES + 1), "df": seen})


def _cosine_counts(model: "Model"):
    """How many of a task's texts of each length class have which cosine to the nearest centroid."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((LENGTHS, STEPS + 1), np.int64)
        for batch in batches:
            for _, texts in blocks(batch["text"], *BLOCK):
                x, letters = _vectors(texts, model.idf)
                step = np.clip((x @ model.centroids.T).max(1) * STEPS, 0, STEPS).astype(np.int64)
                np.add.at(seen, (_length(letters)[letters > 0], step[letters > 0]), 1)
        length, step = np.nonzero(seen)
        yield pd.DataFrame({"length": length, "step": step, "n": seen[length, step]})

    return counted


def fit(docs: DataFrame) -> Model:
    """Learns from ``text`` and non-null ``lang`` of the documents that ``is_training`` admits.

    Document frequencies and the floors of rejection cover all of them. Centroids are fitted, a language a task,
    on about ``FIT_TEXTS`` texts per language, chosen by a hash of the id; a language with fewer gives all. Languages
    whose centroids make more than ``MODEL_BYTES`` are refused.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & is_training(F.col("doc_id")))
    rows = (labelled.select("text").mapInPandas(_document_counts, "feature int, df bigint")
            .groupBy("feature").agg(F.sum("df").alias("df")).collect())  # FEATURES + 1 rows
    df = np.zeros(FEATURES + 1)
    for r in rows:
        df[r["feature"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    sizes = labelled.groupBy("lang").count()
    langs = sizes.count()
    if langs * CENTROIDS * FEATURES * 4 > MODEL_BYTES:
        raise ValueError(f"{langs} languages make a model of over {MODEL_BYTES} bytes")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = (labelled.join(F.broadcast(sizes), "lang")  # one row per language, bounded just above
              .filter(share * F.col("count") < FIT_TEXTS).select("lang", "text"))

    def fitted(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, letters = [np.concatenate(p) for p in zip(*(_vectors(b, idf) for _, b in blocks(group["text"].sort_values(), *BLOCK)))]
        x, letters = x[letters > 0], letters[letters > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": []}, dtype=object)
        return pd.DataFrame({"lang": key[0], "centroid": [v.astype(np.float32).tobytes() for v in _clustered(x, CENTROIDS)]})

    made = (chosen.groupBy("lang").applyInPandas(fitted, "lang string, centroid binary").toPandas()
            .sort_values(["lang", "centroid"]))
    centroids = np.array([np.frombuffer(b, np.float32) for b in made["centroid"]], np.float32).reshape(-1, FEATURES)
    model = Model(idf, made["lang"].tolist(), centroids, np.zeros(LENGTHS))
    if not len(centroids):
        return model
    counts = np.zeros((LENGTHS, STEPS + 1), np.int64)
    for r in (labelled.select("text").mapInPandas(_cosine_counts(model), "length int, step int, n bigint")
              .groupBy("length", "step").agg(F.sum("n").alias("n")).collect()):  # LENGTHS x STEPS rows at most
        counts[r["length"], r["step"]] = r["n"]
    return Model(idf, model.langs, centroids, _floors(counts))


def predictor(model: Model):
    """A pandas UDF of the text: ``lang_pred``, ``score`` and ``rejected``."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [model.predict(b) for _, b in blocks(texts, *BLOCK)]
        return pd.concat(parts, ignore_index=True) if parts else model.predict([])

    return predict.asNondeterministic()  # evaluated once, also under filters


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (cosine) and ``rejected`` of every row.

    ``lang_pred`` is ``und`` (score 0, rejected) if the text is null, has no letter, or nothing
    could be learned; ties go to the first language in order. Rows that repeat get equal results, a null
    ``doc_id`` is never learned from and not held out, and no other column is read.
    """
    return docs.select("doc_id", predictor(model)(F.col("text")).alias("p")).select(
        "doc_id", F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "p.*")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language is rejected; columns and values stay."""
    mark = "__language"
    return (docs.withColumn(mark, predictor(model)(F.col("text")))
            .filter(~F.col(f"{mark}.rejected")).select(docs.columns))
