"""Cross-entropy difference between a target and a background language model.

Both are interpolated word bigram models over one vocabulary, with an exact count of every word and
every pair of words: 63 bits of hash and the kind, no class. Counts are a Spark table of shards by the leading
bits of the hash, whose number follows the size of the input. Texts are taken in blocks; a block asks
each shard once for each of its distinct words and pairs, so that a common one is no hot key, and adds up its losses from the answers. The
background is matched to the target: its counts are scaled to the target's total, so that smoothing weighs
the same in both. Where there are more shards than ``2^COARSE_BITS``, a block's keys go to coarse ranges of them first; there the
rows of many blocks become one row for each shard, so that rows stay long however large the input is. Texts are in one of two folds by their hash; each is scored by the counts of the other
fold, so no text is scored by a model that has seen it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dailyfolio.llm.words import Words, blocks, grams, words_of
from dailyfolio.session import written

FOLDS = 2
#: Code points of a block, and of the texts behind one shard of the counts; shards are 2^SHARD_BITS at least.
BLOCK_CHARS = 6_000_000
SHARD_CHARS = 16_000_000
SHARD_BITS = 8
#: A block sends its keys to at most 2^COARSE_BITS ranges of shards.
COARSE_BITS = 11
#: Weight of the pair model, and counts added to each word.
PAIR_WEIGHT = 0.5
ADDED = 0.1
#: Bits of the small tables in memory (``Pair``), which only state the loss.
WORD_BITS = 15
PAIR_BITS = 18


def _follows(w: Words) -> np.ndarray:
    """Which words have one before in their text."""
    out = np.zeros(len(w.doc), bool)
    out[1:] = w.doc[1:] == w.doc[:-1]
    return out


def _classes(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word class of each word, pair class of each word with the one before, and which have one before."""
    word = (w.key >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair = np.zeros(len(word), np.int64)
    pair[1:] = (grams(w.key, 2) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    return word, pair, _follows(w)


def _keys(word: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words, and of the pairs that end at a word that follows: the last bit is the kind."""
    word = word & ~np.uint64(1)
    pair = grams(word, 2)[follows[1:]] if len(word) else word
    return word, pair | np.uint64(1)


def _loss(word: np.ndarray, history: np.ndarray, pair: np.ndarray, follows: np.ndarray, total: float, size: int) -> np.ndarray:
    """Loss of each word in nats, from its count, that of the word before and that of both."""
    p = (word + ADDED) / (total + ADDED * size)
    known = follows & (history > 0)
    share = np.where(known, np.minimum(pair / np.maximum(history, 1e-9), 1.0), 0.0)
    return -np.log(np.where(known, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * p, p))


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def _pack(x: np.ndarray, level: int = 1) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), level)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(x), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


def _pack_numbers(x: np.ndarray) -> list[bytes]:
    """Numbers of words: the 255 most common take a byte, the others follow at length."""
    seen = np.bincount(x)
    common = np.sort(np.argsort(-seen, kind="stable")[:255]).astype(np.uint32)
    code = np.zeros(len(seen), np.uint8)
    code[common] = np.arange(1, len(common) + 1)
    short = code[x]
    return [_pack(common), _pack(short, 6), _pack(x[short == 0].astype(np.uint32), 6)]


def _unpack_numbers(x: list[bytes]) -> np.ndarray:
    common, short, rest = _unpack(x[0], np.uint32), _unpack(x[1], np.uint8), _unpack(x[2], np.uint32)
    out = np.concatenate([np.zeros(1, np.uint32), common])[short]
    out[short == 0] = rest
    return out


def _shards(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Each shard that has some of the sorted keys, with where they begin and end."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(shard, prepend=-1))
    yield from zip(shard[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(keys)])


def _fold(same: np.ndarray) -> np.ndarray:
    return same.astype(np.int64) % FOLDS


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Words]]:
    """Blocks of texts of one fold: the fold, places in the batch, words."""
    texts, folds = batch["text"].to_pylist(), _fold(batch["same"].to_numpy())
    for f in range(FOLDS):
        at = np.flatnonzero(folds == f)
        for first, part in blocks((texts[i] for i in at), BLOCK_CHARS):
            yield f, at[first:first + len(part)], words_of(part)


COUNTED = pa.schema([("shard", pa.int32()), ("fold", pa.int32()), ("keys", pa.binary()), ("t", pa.binary()), ("b", pa.binary())])
COUNTS = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.list_(pa.binary())),
                    ("totals", pa.list_(pa.int64())), ("words", pa.int64())])


def _group(block: int, fold: int, groups: int) -> int:
    """The fold of a block, as the last bit, and which of the groups of blocks it belongs to."""
    return 2 * (zlib.crc32(b"%d" % block) % groups) + fold


def _counted(bits: int, groups: int):
    """Counts of one block: for each range of shards its distinct keys, how often in target texts, how often in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            target = batch["target"].to_numpy(zero_copy_only=False)
            for f, at, w in _blocks(batch):
                follows, hit = _follows(w), target[at][w.doc]
                keys, back = np.unique(np.concatenate(_keys(w.key, follows)), return_inverse=True)
                b = np.bincount(back, minlength=len(keys))
                t = np.bincount(back[np.concatenate([hit, hit[follows]])], minlength=len(keys))
                group = _group(block, f, groups)
                block += 1
                rows = [(s, group, _pack_sorted(keys[i:j]), _pack(t[i:j]), _pack(b[i:j])) for s, i, j in _shards(keys, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), COUNTED.types)], schema=COUNTED) \
                    if rows else pa.RecordBatch.from_pylist([], COUNTED)

    return run


def _united(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all rows, sorted, and where each key of the rows is among them."""
    return np.unique(np.concatenate([_unpack_sorted(x) for x in rows["keys"].to_pylist()]), return_inverse=True)


def _condensed(bits: int):
    """The counts of a group of blocks in one range, as one row for each shard."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys, back = _united(rows)
        t, b = (np.bincount(back, np.concatenate([_unpack(x, np.int64) for x in rows[m].to_pylist()]), len(keys)).astype(np.int64)
                for m in ("t", "b"))
        return pa.Table.from_pylist([{"shard": s, "fold": key[1].as_py(), "keys": _pack_sorted(keys[i:j]), "t": _pack(t[i:j]), "b": _pack(b[i:j])}
                                     for s, i, j in _shards(keys, bits)], COUNTED)

    return run


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """One shard: its distinct keys with their counts (target and background of the first fold, then of the second)."""
    parts = [_unpack_sorted(x) for x in rows["keys"].to_pylist()]
    fold = np.repeat(rows["fold"].to_numpy() & 1, [len(x) for x in parts])
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    counts = []
    t, b = (np.concatenate([_unpack(x, np.int64) for x in rows[m].to_pylist()]) for m in ("t", "b"))
    for f in range(FOLDS):
        for each in (t, b):  # sums in doubles are exact up to 2^53
            counts.append(np.bincount(back[fold == f], each[fold == f], len(keys)).astype(np.int64))
    word = keys & np.uint64(1) == 0
    return pa.Table.from_pylist([{
        "shard": key[0].as_py(), "keys": _pack_sorted(keys), "counts": [_pack(c) for c in counts],
        "totals": [int(c[word].sum()) for c in counts], "words": int(word.sum())}], COUNTS)


@dataclass(frozen=True)
class Pair:
    """The loss over small tables in memory: ``[target, background]`` of word and pair classes, both of the same total."""

    words: np.ndarray
    pairs: np.ndarray

    def losses(self, w: Words) -> np.ndarray:
        """Loss of each word under the two models (2 x words), in nats."""
        word, pair, follows = _classes(w)
        return np.array([_loss(words[word], words[_before(word)], pairs[pair], follows, words.sum(), len(words))
                         for words, pairs in zip(self.words, self.pairs)])


@dataclass(frozen=True)
class Models:
    """The table of shards, their bits and those of ranges, the words of each fold and model, and the size of the vocabulary
    (one for unseen words)."""

    counts: DataFrame
    bits: int
    coarse: int
    totals: np.ndarray
    size: int


def _chars(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0


def _groups(chars: int, bits: int, coarse: int) -> int:
    """Groups of blocks: as many blocks in one as a range has shards, so that its rows are as long as those of the blocks."""
    return max(1, chars // (BLOCK_CHARS << bits - coarse))


def fit(docs: DataFrame, target: DataFrame, coarse_bits: int = COARSE_BITS) -> Models:
    """The models that score each fold. ``target`` has the ``doc_id`` of the target texts.

    Counts cover every text and every word and pair. They stay in Spark; the driver gets only the totals and
    the size of the vocabulary. Null texts count nothing.
    """
    ids = target.select("doc_id").filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    chars = _chars(docs)
    bits = max(SHARD_BITS, int(chars // SHARD_CHARS).bit_length())
    coarse = min(bits, coarse_bits)
    kept = "shard int, fold int, keys binary, t binary, b binary"
    # Hinted, so that small tables take the plan of large ones.
    rows = (docs.select("doc_id", "text").filter("text is not null").join(ids.hint("shuffle_hash"), "doc_id", "left")
            .select("text", F.xxhash64("text").bitwiseAND(0xFFFF).alias("same"), F.coalesce("target", F.lit(False)).alias("target"))
            .mapInArrow(_counted(coarse, _groups(chars, bits, coarse)), kept))
    if coarse < bits:
        rows = rows.groupBy("shard", "fold").applyInArrow(_condensed(bits), kept)
    counts = written(rows.groupBy("shard").applyInArrow(
        _merged, "shard int, keys binary, counts array<binary>, totals array<bigint>, words bigint"), "lm-counts")
    sums = counts.agg(*[F.sum(F.col("totals")[k]) for k in range(2 * FOLDS)], F.sum("words")).first()
    *totals, size = [x or 0 for x in sums]
    return Models(counts, bits, coarse, np.array(totals, np.float64).reshape(FOLDS, 2), size + 1)


def _asked(bits: int, groups: int, schema: pa.Schema):
    """Of each block a row for each range of shards with the keys it asks for, and one (of a shard below 0) with its texts as
    numbers of its sorted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for f, at, w in _blocks(batch):
                word, pair = _keys(w.key, _follows(w))
                keys = np.unique(np.concatenate([word, pair]))
                _, number = np.unique(word, return_inverse=True)
                group = _group(block, f, groups)
                rows = [{"block": block, "shard": s, "fold": group, "keys": _pack_sorted(keys[i:j])} for s, i, j in _shards(keys, bits)]
                rows.append({"block": block, "shard": -1 - zlib.crc32(b"%d" % block) % (1 << bits), "fold": group,
                             "number": _pack_numbers(number), "sizes": _pack(np.diff(w.first).astype(np.int64)),
                             "ids": batch["doc_id"].take(pa.array(at)).to_pylist()})
                yield pa.RecordBatch.from_pylist(rows, schema)
                block += 1

    return run


def _gathered(bits: int, schema: pa.Schema):
    """What a group of blocks asks for in one range (here as the block), as one row for each shard."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys, _ = _united(rows)
        return pa.Table.from_pylist([{"block": key[0].as_py(), "shard": s, "fold": key[1].as_py(), "keys": _pack_sorted(keys[i:j])}
                                     for s, i, j in _shards(keys, bits)], schema)

    return run


def _word_keys(keys: np.ndarray) -> bytes:
    return _pack_sorted(keys[keys & np.uint64(1) == 0])


def _handed_out(schema: pa.Schema):
    """The answers to a group of blocks in one range, for each of its blocks: what was gathered is put together again."""

    def run(key: tuple, asked: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(asked):
            return schema.empty_table()
        keys, back = _united(asked)
        answers = answers.sort_by("shard")
        t, b = (np.concatenate([_unpack(x, np.int64) for x in answers[m].to_pylist()]) for m in ("t", "b"))
        out, first = [], 0
        for block, packed in zip(asked["block"].to_pylist(), asked["keys"].to_pylist()):
            own = _unpack_sorted(packed)
            at = back[first:first + len(own)]
            first += len(own)
            out.append({"block": block, "shard": key[0].as_py(), "fold": key[1].as_py(), "keys": _word_keys(own), "t": _pack(t[at]), "b": _pack(b[at])})
        return pa.Table.from_pylist(out, schema)

    return run


def _answered(schema: pa.Schema):
    """Counts of the other fold for the keys that each block asks for, with those of words; rows of texts pass."""

    def run(key: tuple, asked: pa.Table, counts: pa.Table) -> pa.Table:
        if not len(asked) or key[0].as_py() < 0:
            return asked.select([n for n in schema.names if n not in ("t", "b")]).append_column(
                "t", pa.nulls(len(asked), pa.binary())).append_column("b", pa.nulls(len(asked), pa.binary())).select(schema.names).cast(schema)
        have = _unpack_sorted(counts["keys"][0].as_py()) if len(counts) else np.zeros(0, np.uint64)
        of = [_unpack(x, np.int64) for x in counts["counts"][0].as_py()] if len(counts) else []
        out = []
        for block, shard, fold, packed in zip(*(asked[n].to_pylist() for n in ("block", "shard", "fold", "keys"))):
            keys = _unpack_sorted(packed)
            at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
            found = have[at] == keys if len(have) else np.zeros(len(keys), bool)
            t, b = (np.where(found, of[2 * (1 - (fold & 1)) + m][at], 0) if len(have) else np.zeros(len(keys), np.int64) for m in (0, 1))
            out.append({"block": block, "shard": shard, "fold": fold, "keys": _word_keys(keys), "t": _pack(t), "b": _pack(b)})
        return pa.Table.from_pylist(out, schema)

    return run


def _scored(totals: np.ndarray, size: int, schema: pa.Schema):
    """The texts of one block with their losses."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        own = rows.slice(0, 1).to_pylist()[0]  # shards of keys come behind it, in the order of the keys
        words = np.concatenate([np.zeros(0, np.uint64), *[_unpack_sorted(x) for x in rows["keys"].slice(1).to_pylist()]])
        number, sizes = _unpack_numbers(own["number"]), _unpack(own["sizes"], np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        follows = np.zeros(len(doc), bool)
        follows[1:] = doc[1:] == doc[:-1]
        word, pair = _keys(words[number], follows)
        _, back = np.unique(np.concatenate([word, pair]), return_inverse=True)
        losses = []
        for m, name in enumerate(("t", "b")):
            counts = np.concatenate([np.zeros(0, np.int64), *[_unpack(x, np.int64) for x in rows[name].slice(1).to_pylist()]])
            target, total = totals[1 - (own["fold"] & 1)][[0, m]]
            scale = target / total if target > 0 else 1.0
            of_word, of_pair = counts[back[:len(word)]] * scale, np.zeros(len(word))
            of_pair[follows] = counts[back[len(word):]] * scale
            each = _loss(of_word, _before(of_word), of_pair, follows, total * scale, size)
            mean = np.bincount(doc, each, len(sizes)) / np.maximum(sizes, 1)
            losses.append(mean)
        none = sizes == 0
        cells = [pa.array(x, pa.float64(), mask=none) for x in (*losses, losses[1] - losses[0])]
        return pa.Table.from_arrays([pa.array(own["ids"], schema.field("doc_id").type), pa.array(sizes), *cells], schema=schema)

    return run


def score(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` of every row.

    Losses are means per word; ``score`` is background minus target, so that larger is
    closer to the target. A text without a word (null, empty) has 0 words and null scores; rows that repeat get equal results.
    """
    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)
    common = [("block", pa.int64()), ("shard", pa.int32()), ("fold", pa.int32()), ("keys", pa.binary()),
              ("number", pa.list_(pa.binary())), ("sizes", pa.binary()), ("ids", pa.list_(id_arrow))]
    ddl = f"block bigint, shard int, fold int, keys binary, number array<binary>, sizes binary, ids array<{id_type.simpleString()}>"
    asked = pa.schema(common)
    answered = pa.schema([*common, ("t", pa.binary()), ("b", pa.binary())])
    out = pa.schema([("doc_id", id_arrow), ("n_tokens", pa.int64()), *[(n, pa.float64()) for n in ("loss_target", "loss_background", "score")]])
    same = F.coalesce(F.xxhash64("text").bitwiseAND(0xFFFF), F.lit(0)).alias("same")
    bits, coarse, answer_ddl = models.bits, models.coarse, f"{ddl}, t binary, b binary"
    groups = _groups(_chars(docs), bits, coarse) if coarse < bits else 1
    rows = docs.select("doc_id", "text", same).mapInArrow(_asked(coarse, groups, asked), ddl)
    counts = models.counts.select("shard", "keys", "counts").groupBy("shard")
    if coarse < bits:
        rows = written(rows, "lm-asked")
        own = rows.where("shard >= 0")
        gathered = own.groupBy("shard", "fold").applyInArrow(_gathered(bits, asked), ddl)
        found = gathered.groupBy("shard").cogroup(counts).applyInArrow(_answered(answered), answer_ddl).select(
            F.col("block").cast("int").alias("range"), "fold", "shard", "t", "b")
        answers = own.groupBy("shard", "fold").cogroup(found.groupBy("range", "fold")).applyInArrow(_handed_out(answered), answer_ddl)
        answers = answers.unionByName(rows.where("shard < 0"), allowMissingColumns=True)
    else:
        answers = rows.groupBy("shard").cogroup(counts).applyInArrow(_answered(answered), answer_ddl)
    return answers.groupBy("block").applyInArrow(
        _scored(models.totals, models.size, out),
        f"doc_id {id_type.simpleString()}, n_tokens bigint, loss_target double, loss_background double, score double")
