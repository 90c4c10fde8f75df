"""SimHash components and line dedup against brute force."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import components as simhash_components
from loomwork.llm import jaccard, linededup, simhash
from loomwork.llm.components import connected_components, spanning_forest

LONG = " ".join(f"word{k % 997}" for k in range(60_000))


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    ids = [i for i, _ in rows]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        known = least.get(find(k))
        least[find(k)] = ids[k] if known is None else known if ids[k] is None else min(known, ids[k])
    return sorted((repr(ids[k]), fps[k], repr(least[find(k)])) for k in range(len(rows)))


def texts(rng, n):
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(60)) for _ in range(n // 3)]
    out = [None, "", "  \n", "One", "one", "Two words", "É x　y z", LONG, LONG + " tail", LONG.upper()]
    while len(out) < n:
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice("abc")
        out.append(" ".join(words))
    return out


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts(rng, 100))] + [(5, "repeated id"), (5, "repeated id"), (None, "no id"), (None, "no id at all")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, key int")
    got = sorted((repr(r.doc_id), r.fp % 2**64, repr(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("block, hot", [(2, 1 << 20), (8, 1 << 20), (256, 1 << 20), (2, 4), (4, 30)])
def test_dense_groups_lose_no_link(spark, monkeypatch, block, hot):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(block)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    near = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in np.repeat(centre, 60)}
    fps = np.array(sorted(near), np.uint64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    got = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    want = [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[:k] if (int(a) ^ int(b)).bit_count() <= 3]
    assert classes(got) == classes(want)


def test_a_hot_key_makes_rows_in_proportion(spark):
    """Fingerprints that all agree in one segment: pairs of blocks would make (n / BLOCK) ** 2 / 2 groups of rows."""
    n = 100_000
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**32, n, dtype=np.uint64)) | np.uint64(0x5A5A5A5A << 32)
    near = fps[:200] ^ np.uint64(0b1011)
    table = spark.createDataFrame(pd.DataFrame({"fp": np.union1d(fps, near).view(np.int64)}))
    made = []
    verified = simhash._verified

    def counted(index, shared, distance):
        made.append(shared.select(F.sum(F.col("n") * F.ceil(F.col("n") / simhash.BLOCK))).first()[0] or 0)
        return verified(index, shared, distance)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "_verified", counted)
        links = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.near_links(table).collect()}
    assert sum(made) < 40 * n
    found = classes([tuple(x) for x in links])
    assert all(any({int(a), int(b)} <= c for c in found) for a, b in zip(fps[:200], near, strict=True))


def classes(pairs):
    out = {}
    for a, b in pairs:
        merged = out.get(a, {a}) | out.get(b, {b})
        for x in merged:
            out[x] = merged
    return {frozenset(x) for x in out.values()}


def test_least_reachable_by_rounds_and_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 300):
        pairs = rng.integers(-50, 50 + 10 * n, (n, 2))
        root = {int(x): int(x) for x in pairs.ravel()}
        for _ in range(len(root)):
            for a, b in pairs.tolist():
                root[a] = root[b] = min(root[a], root[b])
        nodes, least = simhash_components.least_reachable(pairs[:, 0], pairs[:, 1])
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == root
    monkeypatch.setattr(simhash_components, "ONE_TASK", 3)
    test_components(spark)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 500), (7, 7), (900, 905), (905, 903)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 900: 900, 903: 900, 905: 900}
    assert connected_components(edges.where("a < 0")).count() == 0
    assert spanning_forest([(1, 2), (2, 3), (1, 3), (4, 4)]) == [(1, 2), (2, 3)]


def test_one_of_each_component_stays(spark):
    rows = [(3, "same text here"), (1, "same text here"), (1, "same text here"), (9, None), (8, ""), (None, "x y z w"), (4, "x y z w"), (None, "only null id")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, kept_id string")
    got = sorted(((r.doc_id, r.text, r.kept_id) for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, "same text here", "kept"), (8, "", "kept"), (4, "x y z w", "kept"), (None, "only null id", "kept")], key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0 and linededup.dedup_lines(none).count() == 0


# line dedup ------------------------------------------------------------------------------------


def brute_lines(rows, width=3):
    first, found = {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, 0)):
        lines = (t or "").split("\n") if t is not None else []
        held = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        for k in range(len(held) - width + 1):
            key = tuple(x for _, x in held[k : k + width])
            if key in first:
                found.append(((i, t), held[k][0], held[k + width - 1][0]))
            else:
                first[key] = i
    gone = {}
    for row, a, b in found:
        gone.setdefault(row, set()).update(range(a, b + 1))
    return {(i, t): t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    lines = [f"line {k}" for k in range(12)] + ["", "  ", " line 3\t", "line 4\r"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "a\na\na\na\na"), (103, "\n".join(f"row {k}" for k in range(5000))), (104, "\n".join(f"row {k}" for k in range(4000, 6000)))]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(*r, "c", k) for k, r in enumerate(rows)], "doc_id long, text string, cut_id string, h1 int")
    out = linededup.dedup_lines(docs, n_lines="n_lines", n_removed="n_removed")
    assert out.columns == ["doc_id", "text", "cut_id", "h1", "n_lines", "n_removed"]
    want = brute_lines(rows)
    for r in out.collect():
        before = rows[r.h1]
        assert r.text == want[before], before
        assert r.n_removed == (0 if before[1] is None else len(before[1].split("\n")) - (0 if r.text == "" and r.n_removed else len(r.text.split("\n"))))


def test_line_dedup_equals_its_sql(spark, small):
    docs = f"{small}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{docs}')")
    theirs = sorted(map(tuple, con.execute(linededup.SQL).fetchdf()[["doc_id", "text", "n_lines", "n_removed"]].itertuples(index=False)))
    assert sorted(map(tuple, linededup.op10_line_dedup(spark, small).select("doc_id", "text", "n_lines", "n_removed").collect())) == theirs


def test_line_dedup_plan_is_native(spark, small):
    plan = linededup.op10_line_dedup(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F


# near copies by Jaccard similarity -------------------------------------------------------------


def word_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("block", [3, 256])
def test_near_dedup_stage_reaches_jaccard_08(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(0, 400, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 400]))]
        other = list(words)
        for at in range(7, len(words) - 7, rng.choice([30, 45, 50, 60, 80])):
            other[at] = "edited"
        rows += [(k, " ".join(words)), (k + 1, " ".join(other).title())]
        pairs.append((k, k + 1))
    core = [f"c{k}" for k in range(120)]
    rows += [(1000 + k, " ".join(core[:60] + [f"own{k}"] + core[60:])) for k in range(30)] + [(2000, None), (2001, " "), (2002, "two words"), (2003, "Two  words")]
    sets = {i: word_sets(t) for i, t in rows}
    near = [p for p in pairs if similar(sets[p[0]], sets[p[1]])]
    assert 60 < len(near) < 180
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i < 1000} - {b for _, b in near} | {1000, 2000, 2002}


def test_near_dedup_recall_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, word_sets(r.text)) for r in docs.collect())
    holders = {}
    for i, (_, s) in enumerate(rows):
        for g in s:
            holders.setdefault(g, []).append(i)
    near = {(a, b) for at in holders.values() for a in at for b in at if a < b and similar(rows[a][1], rows[b][1])}
    empty = [i for i, (_, s) in enumerate(rows) if not s]
    root = list(range(len(rows)))
    for a, b in sorted(near | set(zip(empty, empty[1:]))):
        least, most = sorted((root[a], root[b]))
        root = [least if x == most else x for x in root]
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert near and sorted(got) == [rows[k][0] for k in range(len(rows)) if root[k] == k]


def test_many_different_texts_under_one_key(spark):
    """A hot key is indexed anew: thousands of texts with one passage in common, few of them near copies."""
    rng = random.Random(4)
    passage = [f"c{k}" for k in range(60)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(8000)]
    near = [t + " more words" for t in texts[:40]]
    rows = [(k, k * 7 + 1, jaccard.xxhash.xxh64_intdigest(t.encode(), 1) >> 1, t.encode()) for k, t in enumerate(texts + near)]
    table = spark.createDataFrame(rows, "id long, sum64 long, fp long, text binary").repartition(4)
    nodes = table.select("id", "sum64", "fp", F.lit(117).cast("long").alias("size"), F.array(F.lit(1).cast("long")).alias("keys"))
    links = jaccard._links(nodes, table.select("id", "sum64", "text"), 5, 0.8)
    fp = {r[0]: r[2] for r in rows}
    assert {frozenset(map(int, r)) for r in links.collect()} == {frozenset((fp[k], fp[8000 + k])) for k in range(40)}


def test_blocks_are_bounded_by_their_hashes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_HASHES", 100)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[:50] + [f"x{k}"] + words[50:])) for k in range(20)] + [(99, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [0, 99]


def test_near_dedup_goes_by_fingerprints_first(spark, monkeypatch):
    """Sets at most 3 bits apart are linked by SimHash, and only if they are similar; what that has joined is not compared again."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    near = [" ".join(words[:k] + ["edited"] + words[k + 1 :]) for k in range(20, 2980, 60)]
    of = [simhash.fingerprint(t.encode(), 5) for t in near]
    near = [t for t, f in zip(near, of, strict=True) if (f ^ of[0]).bit_count() <= 1][:3]
    assert len(near) == 3
    far = " ".join(words[:600] + ["edited"] * 100 + words[700:])
    rows = [*enumerate(near), (7, far), (8, " ".join(reversed(words))), (9, None), (10, "")]
    marks = {i: simhash.fingerprint_of(jaccard.shingles((t or "").encode())) for i, t in rows}
    assert max((marks[a] ^ marks[b]).bit_count() for a in range(3) for b in range(3)) <= 3
    assert marks[8] != marks[0] and marks[9] == 0 == simhash.fingerprint("".encode(), 5) and marks[0] == simhash.fingerprint(near[0].encode(), 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [0, 8, 9]
    # without any other key the near copies are still found, and what shares a fingerprint by chance stays apart
    monkeypatch.setattr(jaccard, "band_keys", lambda hashes: [])
    assert sorted(r.doc_id for r in jaccard.keep_one(docs.where("doc_id < 7")).collect()) == [0]
    sets = [(0, 9, 5), (1, 9, 5), (2, 9, 7), (4, 9, 2**62 + 2**50 + 2**40)]
    table = spark.createDataFrame(sets, "fp long, size long, mark long")
    assert sorted((r.fp, r.key) for r in jaccard.near_fingerprints(table).collect()) == [(0, 5), (1, 5), (2, 5)]
    index = spark.createDataFrame([(k, 9, root, 1) for k, root in ((1, 1), (2, 1), (3, 1))], "fp long, size long, root long, key long")
    never = jaccard._Comparison(lambda fps: fps.select("fp", F.raise_error(F.lit("compared again")).cast("binary").alias("text")), 4, 5, 0.8)
    assert never.links(index, True).count() == 0
