"""Classifiers by held-out accuracy, search by recall, decontamination by planted items."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, innerproduct, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op7_language_id(spark, SF).join(docs, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all() and found.accepted.mean() > 0.99


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 0), (2, "le chat et le chien", "fr", 0)] * 30 + [(3, None, "en", 0), (4, "", None, 0), (5, "123 $%&", "fr", 0), (None, "the dog " * 100_000, None, 0)], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).collect()
    assert {(r.doc_id, r.lang_pred) for r in rows if r.doc_id in (1, 2, None)} == {(1, "en"), (2, "fr"), (None, "en")}
    assert all(r.lang_pred == "und" and r.score == 0 and not r.accepted for r in rows if r.doc_id in (3, 4, 5))
    strange = spark.createDataFrame([(1, "zqxj wvkz qqxz jjkq " * 40)], "doc_id long, text string")
    assert not langid.predict(strange, model).first().accepted
    kept = langid.keep_accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (3, 4, 5)").count() == 0 and kept.where("doc_id in (1, 2)").count() == 60
    none = docs.limit(0)
    assert langid.predict(none, langid.fit(none)).count() == 0 and langid.predict(docs, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_a_language_of_copies_is_learnt(spark):
    few = [(f"les chats et les chiens numero {chr(97 + k)}", "fr") for k in range(5)]
    many = [(f"the cats and the dogs number {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}", "en") for k in range(3000)]
    docs = spark.createDataFrame(few, "text string, lang string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8000)))).drop("k")
    docs = docs.union(spark.createDataFrame(many, "text string, lang string")).withColumn("doc_id", F.monotonically_increasing_id())
    drawn = {(r.lang, r.n) for r in langid.drawn(docs, sample=400).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert drawn == {("en", 400), ("fr", 5)}
    model = langid.fit(docs, sample=400)
    assert model.langs == ["en", "fr"]
    got = langid.predict(docs.select("doc_id", "text"), model).join(docs, "doc_id")
    assert got.where("lang <> lang_pred").count() == 0


def test_gibberish_and_foreign_texts_are_rejected_and_clean_short_ones_kept(spark):
    import base64
    import string

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rng = np.random.default_rng(2)
    letters = [" ".join("".join(rng.choice(list(string.ascii_lowercase), rng.integers(2, 10))) for _ in range(n)) for n in (100, 200, 300)]
    noise = [base64.b64encode(rng.bytes(n)).decode() for n in (300, 600, 1500)]
    finnish = ["Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset ja jolla on virallisen kielen asema."]
    clean = [r.text for r in docs.where("lang is not null and length(text) between 40 and 200 and text rlike '[a-z]'").orderBy("doc_id").collect()]
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*letters, *noise, *finnish, *clean])], "doc_id long, text string")
    kept = {r.doc_id for r in langid.predict(table, model).where("accepted").collect()}
    odd = len(letters) + len(noise) + len(finnish)
    assert not kept & set(range(odd)) and len(clean) >= 10 and kept >= set(range(odd, odd + len(clean)))


def test_every_labelled_language_is_learnt(spark):
    rows = [(f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k + j)} " * 5, f"l{k:03}") for k in range(330) for j in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.monotonically_increasing_id())
    model = langid.fit(docs)
    assert len(model.langs) == 330
    assert langid.predict(docs.select("doc_id", "text"), model).join(docs, "doc_id").where("lang <> lang_pred").count() <= 10


def brute_predict(fitted, texts, k):
    """tf-idf, centroids and cosines with dictionaries of n-grams in place of hashed buckets and blocks."""
    def grams(t):
        t = re.sub(r"[\x00-@\[-`{-\x7f]+", " ", t.lower()).encode()
        return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))

    df = Counter(g for t, _ in fitted for g in grams(t))

    def unit(t):
        v = {g: (1 + math.log(c)) * (math.log((1 + len(fitted)) / (1 + df[g])) + 1) for g, c in grams(t).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / size for g, x in v.items()}

    def cosine(u, v):
        return sum(x * v.get(g, 0) for g, x in u.items())

    def mean(vs):
        total = Counter()
        for v in vs:
            total.update(v)
        size = math.sqrt(sum(x * x for x in total.values())) or 1
        return {g: x / size for g, x in total.items()}

    centres = []
    for lang in sorted({x for _, x in fitted}):
        own = [unit(t) for t, x in fitted if x == lang]
        found = [mean(own)]
        while len(found) < min(k, len(own)):
            found.append(min(own, key=lambda v: max(cosine(c, v) for c in found)))
        for _ in range(12):
            near = [max(range(len(found)), key=lambda c: cosine(found[c], v)) for v in own]
            found = [mean([v for v, n in zip(own, near, strict=True) if n == c]) for c in range(len(found)) if c in near]
        centres += [(lang, c) for c in found]
    return [max(((cosine(c, unit(t)), lang) for lang, c in centres), key=lambda x: x[0]) for t in texts]


def test_language_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "DIMS", 1 << 16)  # hardly any two n-grams share a bucket
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500 and lang is not null and text rlike '[a-z]'").orderBy("doc_id")
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").distinct().collect()]
    fitted, asked = sorted(rows)[::3][:60], [t for t, _ in rows[:60]]
    found = [r for t, lang in fitted for r in langid.rows_of(lang, langid.lower(pa.array([t]))[0].as_buffer().to_pybytes())]
    model = langid.fit_rows(found)
    want = brute_predict(fitted, asked, langid.CENTROIDS)
    got = [model.predict(t.as_buffer().to_pybytes()) for t in langid.lower(pa.array(asked))]
    assert [x for x, *_ in got] == [x for _, x in want]
    assert np.abs(np.array([c for _, c, _ in got]) - np.array([c for c, _ in want])).max() < 0.03


def test_fit_on_executors_is_the_fit_of_the_same_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    drawn = langid.drawn(docs, sample=30).collect()
    rows = [r for d in drawn for r in langid.rows_of(d.lang, langid.lower(pa.array([d.text]))[0].as_buffer().to_pybytes())]
    columns = zip(*((r.lang, r.whole, r.place.astype("<u2").tobytes(), r.count.astype("<u4").tobytes()) for r in rows), strict=True)
    one, other = langid.fit_rows(langid._rows(*columns)), langid.fit(docs, sample=30)
    assert one.langs == other.langs and (one.owner == other.owner).all()
    assert np.allclose(one.idf, other.idf) and np.allclose(one.centroids, other.centroids) and np.allclose(one.least, other.least)


def test_counts_do_not_depend_on_parts(monkeypatch):
    text = bytes(np.random.default_rng(0).integers(97, 123, 5000, dtype=np.uint8))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_PART", 257)
    assert (langid.counts(text) == whole).all() and whole.sum() == 3 * 5000 - 3 and not langid.counts(b"").any()


def brute_segments(values):
    """The maximal segments by their definition: every proper part of a segment scores less, and no such segment is around it."""
    sums = np.r_[0, np.cumsum(values)]
    n = len(values)
    good = [
        (i, j) for i in range(n) for j in range(i + 1, n + 1)
        if all(sums[k] > sums[i] for k in range(i + 1, j + 1)) and all(sums[k] < sums[j] for k in range(i, j))
    ]
    return [(i, j - 1) for i, j in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in good)]


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 14))
        place = sorted(rng.choice(20, n, replace=False).tolist()) if n else []
        score = [float(x) for x in rng.normal(0, 2, n)]
        values = [-0.31] * 20
        for p, s in zip(place, score, strict=True):
            values[p] = s
        got = toxicity.maximal_segments(place, score, 0.31)
        assert [(a, b) for a, b, _ in got] == sorted(brute_segments(values))


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.op2_toxicity(spark, SF).join(labels, "doc_id", "left").toPandas()
    held = found[found.held_out & found.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.9 and held.predicted[held.toxic == 0].mean() < 0.02
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()


def test_lexicon_against_its_formulas():
    rng = np.random.default_rng(12)
    for _ in range(20):
        n = int(rng.integers(5, 60))
        tokens = [f"t{k}" for k in range(n)]
        toxic, other = rng.integers(0, 40, n) * (rng.random(n) < 0.4), rng.integers(0, 200, n)
        lex = toxicity.lexicon(tokens, toxic.astype(float), other.astype(float), float(toxic.sum()), float(other.sum()))
        want = {}
        for t, a, b in zip(tokens, toxic, other, strict=True):
            if a + b == 0:
                continue
            prior, mass = toxicity.PRIOR * (a + b), toxicity.PRIOR * (toxic.sum() + other.sum())
            odds = math.log((a + prior) / (toxic.sum() + mass - a - prior)) - math.log((b + prior) / (other.sum() + mass - b - prior))
            z = odds / math.sqrt(1 / (a + prior) + 1 / (b + prior))
            if (z >= toxicity.Z_LEAST and odds >= toxicity.ODDS_LEAST and a >= toxicity.TEXTS_LEAST) or z <= -2 * toxicity.Z_LEAST:
                want[t] = (odds, (b + prior) / (other.sum() + mass))
        assert dict(zip(lex.tokens, lex.odds, strict=True)) == pytest.approx({t: x for t, (x, _) in want.items()})
        if any(x > toxicity.DRIFT for x, _ in want.values()) and sum(p * (x - toxicity.DRIFT) for x, p in want.values()) < toxicity.DRIFT * (1 - sum(p for _, p in want.values())):
            known = sum(p * math.exp(lex.rate * (x - toxicity.DRIFT)) for x, p in want.values())
            assert known + (1 - sum(p for _, p in want.values())) * math.exp(-lex.rate * toxicity.DRIFT) == pytest.approx(1, abs=1e-3)
        assert lex.chance(3.0, 50) == pytest.approx(1 - math.exp(-lex.k * 50 * math.exp(-lex.rate * 3.0)), abs=1e-9)


def test_scores_against_brute_force(spark):
    lex = toxicity.Lexicon(["vile", "filth", "calm"], np.array([4.0, 2.5, -3.0]), 0.8, 0.05)
    model = toxicity.Model([lex], 1.7, -2.0)
    rng = np.random.default_rng(8)
    pool = ["vile", "filth", "calm", "plain", "word", "other"]
    texts = [" ".join(rng.choice(pool, int(rng.integers(0, 14)), p=[0.15, 0.1, 0.1, 0.25, 0.2, 0.2])) for _ in range(120)]
    texts += ["plain " * 200_000 + "vile filth vile", "Vile, FILTH!", None, ""]
    docs = spark.createDataFrame([(k // 2, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string")  # ids repeat
    got = sorted((r.doc_id, round(r.score, 9), [(p.first, p.last) for p in r.passages]) for r in toxicity.score(docs, model).collect())
    odds = dict(zip(lex.tokens, lex.odds, strict=True))
    want = []
    for k, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        values = [odds.get(x, 0.0) - toxicity.DRIFT for x in w]
        start = max(0, len(values) - 12) if len(values) > 1000 else 0  # what lies before has no positive score
        found = [(a + start, b + start, sum(values[start + a : start + b + 1])) for a, b in brute_segments(values[start:])]
        sizes = len(decontaminate.words(pa.array([t or ""]))[0])
        p = [(a, b, 1 - math.exp(-lex.k * sizes * math.exp(-lex.rate * s))) for a, b, s in found]
        p = [x for x in p if x[2] <= toxicity.P_MOST]
        evidence = -sum(math.log(x[2]) for x in p)
        want.append((k // 2, round(1 / (1 + math.exp(-(model.base + model.slope * math.log1p(evidence)))), 9), [(a, b) for a, b, _ in p]))
    assert got == sorted(want) and any(x[2] for x in want)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(k, ("vile filth " if k % 4 == 0 else "") + f"plain words number {k} here", k) for k in range(400)] + [(1000, None, 0), (1001, "", 0), (None, "plain", 0)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (3, None), (1000, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[0] > 0.7 > got[1] and got[1000] == got[1001] == got[None] == min(got.values())
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, empty).agg(F.max("score")).first()[0] < 0.5 and toxicity.score(docs.limit(0), model).count() == 0


def brute_nearest(vectors, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(innerproduct, "BLOCK", 300)
    monkeypatch.setattr(innerproduct, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[100:400] = x[100]  # a third are copies
    rows = [(k, x[k].tolist()) for k in range(900)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [math.nan] + [1.0] * 23), (2060, [None] + [1.0] * 23), (2080, [1.0] * 3), (2100, [math.inf] + [0.0] * 23), (None, x[0].tolist()), (5, x[5].tolist())]
    table = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = innerproduct.nearest(table, F.col("id") % 20 == 0, 20).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float((x[r.query_id].astype(float) * x[r.vec_id].astype(float)).sum()), abs=1e-12)
    queries = [(k, x[k].tolist()) for k in range(0, 900, 20)]
    want = brute_nearest(rows, queries, 20)
    assert found.keys() == want.keys()
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    for q in range(100, 400, 20):  # ties in order of the id
        assert found[q] == want[q]
    few = innerproduct.nearest(table.where("vec_id < 41"), F.col("id") % 20 == 0, 50).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in few} == {0: 40, 20: 40, 40: 40}
    assert innerproduct.nearest(table.limit(0), F.col("id") == 0).count() == 0


def test_codes_are_smaller_than_vectors_and_bounds_hold(spark):
    """What goes to every query block is a small part of the vectors, and few vectors are scored exactly."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 50_000)] + 0.6 * rng.normal(size=(50_000, 64))).astype(np.float32)
    q = x[::500]
    quantizer = innerproduct.Quantizer(64).fit(x[:4000])
    codes, norms = quantizer.encode(x), np.linalg.norm(x, axis=1).astype(np.float32)
    rest = quantizer.left_out(x, codes)
    assert codes.nbytes + norms.nbytes + rest.astype(np.float32).nbytes <= x.nbytes // 10
    exact = x.astype(float) @ q.astype(float).T
    hits = kept = 0
    for of, near, _, _ in innerproduct.candidates(quantizer, codes.T.copy(), norms, rest, q.astype(float), 21):
        true = set(np.argsort(-exact[:, of[0]])[:20].tolist())
        hits += len(true & set(near.tolist()))
        kept += len(near)
    assert hits / (20 * len(q)) >= 0.9 and kept / len(q) < 50_000 / 16


def test_planted_items_are_found_and_clean_documents_left(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = np.random.default_rng(9)
    docs, truth = [], {}
    for n, (i, t) in enumerate(items.items()):
        w = t.split()
        for _ in range(len(w) // 8):
            w[int(rng.integers(len(w)))] = "replacedword"
        docs.append((n, "Before it all. " * int(rng.integers(0, 30)) + " ".join(w if n % 2 else t.replace(",", " ;").split()) + " and after, " * 5))
        truth[n] = i
    docs += [(1000, None), (1001, ""), (1002, "clean words " * 50_000), (None, items[0]), (5, "clean too")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_items(table, bench).collect()}
    assert sum((n, i) in got for n, i in truth.items()) >= 0.95 * len(truth)
    assert all((n, i) in got and got[n, i].edits == 0 for n, i in truth.items() if n % 2 == 0) and (None, 0) in got
    assert not {d for d, _ in got} & {1000, 1001, 1002}
    left = decontaminate.drop_contaminated(table, bench)
    assert left.columns == table.columns and sorted((r.doc_id for r in left.where("doc_id >= 1000").collect())) == [1000, 1001, 1002]
    odd = spark.createDataFrame([(1, None), (2, " ,."), (3, "One")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.find_items(spark.createDataFrame([(1, "two one")], "doc_id long, text string"), odd).collect()] == [(1, 3)]
    assert decontaminate.find_items(table, bench.limit(0)).count() == 0 and decontaminate.find_items(table.limit(0), bench).count() == 0


def test_edit_distance_to_the_best_run():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, t = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 25))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.distance(x, t)[0] == min(row)


def brute_items(items, texts, rate):
    """All (text, item) of which a run is within the item's edits, by plain dynamic programming."""
    out = {}
    for d, t in enumerate(texts):
        for i, x in items:
            row = [0] * (len(t) + 1)
            for k, a in enumerate(x, 1):
                new = [k]
                for j, b in enumerate(t, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
                row = new
            if min(row) <= math.floor(rate * len(x)):
                out[d, i] = min(row)
    return out


@pytest.mark.parametrize("part", [128, 16])
@pytest.mark.parametrize("walks", [256, 0])
def test_items_against_brute_force(walks, part, monkeypatch):
    """With walks nearly all pairs within reach are found, without them all; never any other."""
    monkeypatch.setattr(decontaminate, "MOST_WALKS", walks)
    monkeypatch.setattr(decontaminate, "PART", part)
    monkeypatch.setattr(decontaminate, "_LOOKUPS", 97)
    rng = np.random.default_rng(21)
    common = [f"w{k}" for k in range(12)]  # few words, so that grams are frequent

    def text(n):
        return [str(x) for x in rng.choice(common, n)]

    items = [(k, text(int(rng.integers(1, 70)))) for k in range(24)]
    texts = [text(int(rng.integers(0, 90))) for _ in range(30)]
    for k, x in items:  # edited copies, some beyond reach
        y = list(x)
        for _ in range(int(rng.integers(0, 1 + len(x) // 3))):
            y[int(rng.integers(len(y)))] = "other"
        texts.append(text(5) + y + text(7))
    m = decontaminate.Matcher(items)
    assert all(c.exact == (not walks) for c in m.classes)
    got = {(d, m.ids[k]): edits for d, k, _, _, edits in m.find(pa.array([" ".join(t) for t in texts]))}
    want = brute_items(items, texts, decontaminate.RATE)
    assert got.keys() <= want.keys() and all(got[x] >= want[x] for x in got)
    if walks:
        assert len(got) >= 0.95 * len(want)
    else:
        assert got == want


def test_long_items_and_frequent_words(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{k}" for k in rng.integers(0, 4000, 3000))
    edited = long.split()
    for k in rng.choice(3000, 400, replace=False):
        edited[k] = "edited"
    items = spark.createDataFrame([(1, long), (2, "the")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "before " + " ".join(edited) + " after"), (11, "the " * 300_000), (12, " ".join(long.split()[:1500]))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(docs, items).collect()}
    assert got.keys() == {(10, 1), (11, 2)} and 300 < got[10, 1] <= 400


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(8)
    docs = bench.select(F.col("item_id").alias("doc_id"), "text")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()} == {(r.doc_id, r.doc_id) for r in docs.collect()}
    assert decontaminate.drop_contaminated(docs, bench).count() == 0 and pa
