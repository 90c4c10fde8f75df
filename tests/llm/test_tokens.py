"""Token ids, Huffman files and packing: exact round trips and optimal cuts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwork.llm import huffman, packing, tokenstore
from loomwork.llm.tokens import TokenIds, slices

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, "  ", " a", "a ", "a  b", "a \n b", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "don't 's 't  we'll, I'D.", " x y",
    "é é ́a", "a\x1c b", "a\x85 b", "ſ K İ J̌", "日本 語。 文、", "A\tB C\n\nD  ", "x <|startoftext|>y", "ΑΣ Σ", "a | b", "|", "a\t b", "\t", "x\n", "a\n b", "x" * 300 + " y",
    "a .| b", "foo.\nBar baz,\nqux. end.", "A.b,c. d", "x... y.,. z", "é. É, ß.", "1. 2, a1. b2,", "a\x00b c", "​x ﻿y", "👍🏽 ok.", "a\r\nb. c",
]


@pytest.mark.parametrize("path,spaces", [(WORD, "dropped"), (BYTE, "leading")])
def test_ids_are_the_librarys(path, spaces, spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rng = random.Random(1)
    alphabet = "ab .,\n\t|'ÉÄé1́ <|>s"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    plain = Tokenizer.from_file(path)
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for most in (10, 1_000_000):
        encoder = TokenIds(path, spaces, most=most)
        column = pa.array(texts, pa.string())
        for a, b in slices(column, 50_000):
            got = encoder.encode(column.slice(a, b - a))
            for k in range(a, b):
                assert got.ids[got.lo[k - a] : got.hi[k - a]].tolist() == want[k], texts[k]
            assert not len(got.ends) or (np.diff(got.ends) >= 0).all()


def test_huffman_round_trips_and_is_optimal():
    rng = np.random.default_rng(2)
    for n, v in ((0, 4), (1, 4), (255, 3), (256, 50), (257, 1), (5000, 4000), (60_000, 49_408)):
        ids = np.minimum((rng.pareto(0.8, n) * 3).astype(np.int64), v - 1)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=v))
        codec = huffman.Codec(lengths)
        bits, checkpoints = codec.encode(ids)
        assert (codec.decode(bits, checkpoints, n) == ids).all()
        if n >= huffman.STEP * 3:  # from a checkpoint on
            k = 2
            part = codec.decode(bits, checkpoints[k:], n - k * huffman.STEP)
            assert (part == ids[k * huffman.STEP :]).all()
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    assert (huffman.code_lengths(counts) * counts).sum() == 1 * 8 + 1 * 8 + 2 * 7 + 3 * 6 + 5 * 5 + 8 * 4 + 13 * 3 + 21 * 2 + 34
    limited = huffman.code_lengths(counts, 4)
    assert limited.max() == 4 and (2.0 ** -limited.astype(float)).sum() <= 1


def test_token_file(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "BLOCK_IDS", 500)
    rows = [(k * 37 % 101, t) for k, t in enumerate(ODD)] + [(500, "very long " * 30_000), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, start string")
    got = tokenstore.store_and_read(docs, WORD).collect()
    plain = Tokenizer.from_file(WORD)
    want = sorted((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at
        at += len(r.ids) // 4
    assert tokenstore.store_and_read(docs.limit(0), WORD).count() == 0


def test_token_query(spark, small):
    plain = Tokenizer.from_file(WORD)
    at = 0
    for doc, r in zip(spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect(), tokenstore.op8_token_store(spark, small).orderBy("doc_id").collect(), strict=True):
        ids = np.array(plain.encode(doc.text, add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def brute_cost(at, penalty, size):
    cost = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= size:
                cost[j] = min(cost[j], cost[i] + (0 if n & (n - 1) == 0 else size - n) + (penalty[j] if j < len(at) - 1 else 0))
    return cost[-1]


def test_cuts_cost_the_least():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        at, penalty = [0, *np.cumsum(rng.integers(1, 30, n)).tolist()], rng.integers(0, 9, n + 1).tolist()
        cuts, cost = packing.best_cuts(at, penalty, 64)
        assert cost == brute_cost(at, penalty, 64) and cuts[0] == 0 and cuts[-1] == n
        assert max(at[b] - at[a] for a, b in zip(cuts, cuts[1:], strict=False)) <= 64


@pytest.mark.parametrize("stretch", [2000, 4 << 20])
def test_packing_keeps_every_token_once(spark, monkeypatch, small, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "repeated id. " * 50), (None, "no id"), (90, "long " * 20_000), (91, "Sentence. " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    pieces = packing.pack(docs, BYTE).collect()
    plain = Tokenizer.from_file(BYTE)
    want = sorted((repr(i), np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows)
    whole = {}
    for p in pieces:
        whole.setdefault((repr(p.doc_id), p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    for i, ids in want:
        parts = sorted(whole[i, len(ids) // 4])
        assert sum(n for _, n, _ in parts) == len(ids) // 4
        for start, n, crc in parts:
            assert zlib.crc32(ids[4 * start : 4 * (start + n)]) == crc
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    pad = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.SIZE
        pad, total = pad + (0 if at & (at - 1) == 0 else packing.SIZE - at), total + at
    assert stretch < 1 << 20 or pad < 0.05 * total
    assert packing.pack(docs.limit(0), BYTE).count() == 0
