"""Runs, exact top-k and centroids against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import clustering, exacttopk, periodic

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_runs(w, least=6, times=4):
    best = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=8), st.sampled_from([(6, 4), (2, 2), (3, 3), (9, 2), (1, 5)]))
def test_runs_against_all_periods(pieces, limits):
    word = [c for piece, n in pieces for c in piece * n]
    assert periodic.runs_of(word, *limits) == plain_runs(word, *limits)


def test_factors_are_the_longest_earlier_substrings():
    rng = random.Random(3)
    for _ in range(200):
        word = [rng.randrange(3) for _ in range(rng.randrange(30))]
        at = 0
        for start, size, source in periodic.factors(word):
            assert start == at
            longest = max((next((k for k in range(len(word) - start) if word[s + k] != word[start + k]), len(word) - start) for s in range(start)), default=0)
            assert size == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or (source < start and word[source : source + size] == word[start : start + size])
            at += size
        assert at == len(word)


def test_runs_inside_a_copied_factor():
    inner = ["x"] + ["a", "b"] * 5 + ["y"]
    word = ["p", *inner, "q", *inner, "r", *inner, "s"]
    assert periodic.runs_of(word) == plain_runs(word) and len(periodic.runs_of(word)) == 3


def plain_op11(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    inside = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in inside)
    return (doc_id, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], sha(lines), sha(kept))


def test_op11_query(spark, tmp_path):
    small = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()]
    odd = [(None, "a " * 30), (7, None), (8, ""), (9, " \n"), (9, "b\x1cc d e " * 9), (10, "naïve \U0001f600\tx\r\n" * 50), *((k, f"one two three four {k} six seven" * 9) for k in range(1000, 1100))]
    spark.createDataFrame(small + odd, "doc_id long, text string").withColumn("RUNS", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic.op11_periodic_runs(spark, str(tmp_path))
    got = [tuple(r) for r in found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    want = [plain_op11(*r) for r in small + odd]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[1] > 0 for r in got) > 20


def test_periodic_runs_edge_cases(spark):
    docs = spark.createDataFrame([(1, "k a a a a a a a b", "x"), (1, "k a a a a a a a b", "y"), (None, None, "z")], "doc_id long, text string, id string")
    rows = periodic.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == [(0, [], ""), *[(1, [(1, 7, 1)], "k a b")] * 2]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs.withColumnRenamed("doc_id", "runs"), id_col="runs")
    long = spark.createDataFrame([(1, "u v w " * 100_000)], "doc_id long, text string")
    assert [tuple(x) for x in periodic.periodic_runs(long).first().runs] == [(0, 300_000, 3)]


def plain_top(rows, every, k=5, scale=256):
    fine = {(i, tuple(int(np.floor(np.float64(x) * scale)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in fine:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "copies", "ties", "few", "large"])
def test_top_k_against_all_products(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, dims = (4, 6) if kind == "few" else (900, 6)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    if kind == "copies":
        x[: n // 3] = x[0]
        x[n // 3 : n // 2] = x[1] + rng.normal(size=(n // 2 - n // 3, dims)) * 0.01
    if kind == "ties":
        x = np.sign(x) / 256
    if kind == "large":
        x = x * 1000
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(n, None), (n + 1, [NAN] * dims), (n + 2, [None] * dims), (n + 3, [INF] * dims), (n + 4, [1.0]), (None, [1.0] * dims), (n + 5, [0.0] * dims), (0, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("Key", F.lit(2))
    found = sorted(tuple(r) for r in exacttopk.top_k(table, F.col("id") % 25 == 0).collect())
    assert found == plain_top([r for r in rows if r[1] is None or len(r[1]) == dims], 25)


def test_top_k_without_rows_and_beyond_its_numbers(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert exacttopk.top_k(table, F.col("id") % 2 == 0).count() == 0 and exacttopk.top_k(table.limit(0), F.col("id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(2, [1.0])], "vec_id long, embedding array<float>")
    assert exacttopk.top_k(alone, F.col("id") % 2 == 0).count() == 0
    with pytest.raises(Exception, match="32-bit integer"):
        exacttopk.top_k(spark.createDataFrame([(2, [1e30])], table.schema), F.col("id") % 2 == 0)


def test_threshold_hands_on_few_entries():
    """On random unit vectors the cutoff's share keeps a few hundredths of a part's list at most."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    q, parts = x[:50], (slice(0, 32), slice(32, 64))
    lists = [next(exacttopk.local_scores(q[:, p], x[:, p]))[1] for p in parts]
    assert (lists[0] + lists[1] == q @ x.T).all()
    seen = np.concatenate([exacttopk.first_entries(s, exacttopk.LISTED) for s in lists], axis=1)
    cutoff = np.array([np.unique((q[r] @ x[sorted(set(seen[r]))].T))[-6] for r in range(50)])
    row, _, _ = exacttopk._reaching(2)(lists[0], [cutoff])
    assert len(row) / 50 < 0.03 * len(x)


def plain_clusters(rows, k=16, rounds=3, scale=64, dims=64):
    kept = [(i, [int(np.floor(np.float64(c) * scale)) for c in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    of = lambda c: sum(d for _, x, d in found if x == c)
    return sorted((i, c, d, of(c), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize("kind", ["random", "copies", "grid", "few", "large"])
def test_clusters_against_plain_integers(spark, kind):
    rng = np.random.default_rng(7)
    n = 5 if kind == "few" else 300
    x = rng.normal(size=(n, 64))
    if kind == "copies":
        x[: n // 2] = x[0]
    if kind == "grid":  # full of equal distances
        x = np.sign(x) * (rng.random(x.shape) < 0.05) / 64
    if kind == "large":
        x[0] *= 1e7  # beyond what is screened
    rows = list(enumerate(x.tolist())) + [(900, None), (901, [0.0] * 63), (902, [0.0] * 65), (903, [NAN] * 64), (904, [None] * 64), (905, [INF] * 64), (None, [0.0] * 64), (0, x[0].tolist()), (0, x[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("H", F.lit("h")).withColumn("cluster", F.lit(1))
    assert sorted(tuple(r) for r in clustering.clusters(table).collect()) == plain_clusters(rows)
    assert clustering.clusters(table.limit(0)).count() == 0


def test_intervals_hold_the_exact_distances():
    rng = np.random.default_rng(5)
    for scale in (3, 1000, 1 << 26):
        x, c = (np.clip(rng.normal(size=(n, 64)) * scale, -(1 << 27), 1 << 27).astype(np.int64) for n in (200, 16))
        screen = clustering.Screen(c.tolist())
        low, high = screen.intervals(x)
        exact = [[sum(b * b for b in cc) - 2 * sum(a * b for a, b in zip(v, cc, strict=True)) for cc in c.tolist()] for v in x.tolist()]
        assert all(lo <= e <= hi for a, b, e3 in zip(low.tolist(), high.tolist(), exact, strict=True) for lo, hi, e in zip(a, b, e3, strict=True))
        assert screen.nearest(x).tolist() == [min(range(16), key=lambda k: (row[k], k)) for row in exact]


def test_top_k_hands_on_k_and_one_a_block(monkeypatch):
    """The parts of a block meet in one task: whatever reaches a cutoff's share, k + 1 candidates a query leave it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 8))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<i2")
    x[2000:3000] = 0
    q, ids = np.concatenate([x[:40], x[2000:2001]]), rng.permutation(5000)
    parts = lambda v: [v[:, :3], v[:, 3:]]
    scores = q.astype(int) @ x.T.astype(int)
    want = [sorted(zip(-scores[r], ids, strict=True))[:6] for r in range(len(q))]
    for wide in (exacttopk.WIDE, 1024, 100):
        monkeypatch.setattr(exacttopk, "WIDE", wide)
        cutoffs = exacttopk.listed_best(parts(q), parts(x), 6).min(axis=1)
        assert all(c <= -w[-1][0] for c, w in zip(cutoffs, want, strict=True))
        for cutoff in (cutoffs, np.full(len(q), exacttopk._NOTHING)):
            row, column, score = exacttopk.reaching_best(parts(q), parts(x), ids, cutoff, 6)
            got = [[] for _ in q]
            for r, c, s in zip(row, column, score, strict=True):
                got[r].append((-s, ids[c]))
            assert [sorted(g) for g in got] == want
    scores = scores[:, :4096]
    for listed in (6, 32):
        first = np.take_along_axis(scores, exacttopk.first_entries(scores, listed), axis=1)
        assert (np.sort(first, axis=1) == np.sort(scores, axis=1)[:, -listed:]).all()
