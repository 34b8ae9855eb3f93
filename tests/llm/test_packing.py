import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dailyfolio.llm import packing
from tests.llm.conftest import ODD, frame, prose


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encode = packing._encoder("byte_bpe_50k")
    odd = ["two  spaces", " lead", "trail ", "line\nnext", "a \n b", "tab\t x", "it's 'tis we'll", "<|endoftext|> x",
           "no break  x", "\x1c y \x1d", "é è 漢字 1²3 x　y", "a\r\n b", prose(1, 300), *[t for t in ODD if t]]
    rng = np.random.default_rng(0)
    alphabet = list("ab 'sé1.\n\t \x1c漢 ")
    odd += ["".join(rng.choice(alphabet, 30)) for _ in range(300)]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_long_document_is_cut_and_only_its_first_piece_is_short():
    ids = np.arange(5000, dtype="<u4").tobytes()
    assert [(k, a, n) for k, a, n, _ in packing.cut(ids)] == [(0, 0, 904), (1, 904, 2048), (2, 2952, 2048)]
    assert [n for *_, n, _ in packing.cut(ids[:4 * 4096])] == [2048, 2048]
    assert packing.cut(ids[:4])[0][1:] == (0, 1, zlib.crc32(ids[:4]))


def plain_sum_of_squares(lengths, capacity):
    bins, out = [], []
    for s in lengths:
        def cost(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
        options = []
        for g in sorted({b for b in bins if b >= s}):
            trial = list(bins)
            trial[trial.index(g)] = g - s
            options.append((cost(trial), 0, g))
        options.append((cost([*bins, capacity - s]), 1, capacity))
        _, fresh, g = min(options)
        if fresh:
            bins.append(capacity - s)
        else:
            bins[bins.index(g)] = g - s
        out.append(g)
    return out


def test_each_piece_goes_where_the_sum_of_squares_is_smallest():
    rng = np.random.default_rng(1)
    for capacity in (10, 37):
        lengths = rng.integers(1, capacity, 120)
        _, offset, _ = packing.sum_of_squares(lengths, capacity)
        assert (capacity - offset).tolist() == plain_sum_of_squares(lengths.tolist(), capacity)


def checked(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_gapless_and_tight(spark, tokenizer):
    texts = [prose(i, 20 + 37 * i % 700) for i in range(400)] + [prose(9, 6000), None, ""]
    rows = packing.pack(frame(spark, texts), group_pieces=100).collect()
    used = checked(rows)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    got = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(x) for i, x in ids.items()}
    assert used <= 1.05 * sum(map(len, ids.values())) / 2048 + 2


def test_odd_and_empty_tables(odd, nothing):
    rows = packing.pack(odd).collect()
    checked(rows)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert packing.pack(nothing).count() == 0
