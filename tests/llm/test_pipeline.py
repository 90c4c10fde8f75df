"""The corpus pipeline against a plain version of its stages, and its stages on odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import decontaminate

WORDS = {
    "en": "the of and to in that is was for with on as are they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split(),
    "fr": "le la les des est dans une pour que qui avec sur par pas plus tout mais comme nous vous ils elle sont fait cette deux bien sans peut temps encore autre homme jour grand entre petit aussi monde chose vie main toujours quelque jamais rien heure maison depuis porte moins notre peu avant trop enfant femme terre nuit ville premier moment pays coup cause mort ordre force eau point chez parole livre oeil loin".split(),
}


def text(rng, lang, lines):
    return "\n".join(" ".join(rng.choice(WORDS[lang]) for _ in range(14)) for _ in range(lines))


def documents():
    """(doc_id, text, lang) rows, and the texts that must be packed, by doc_id."""
    rng = random.Random(11)
    rows = [(k, text(rng, "en" if k % 2 else "fr", 12), "en" if k % 2 else "fr") for k in range(60)]
    kept = {i: t for i, t, _ in rows}
    item = text(rng, "en", 2)
    rows += [(100, f"{text(rng, 'en', 6)}\n{item}\n{text(rng, 'en', 6)}", "en")]  # holds the benchmark's item
    rows += [(101, rows[3][1], "en"), (102, rows[3][1], None), (103, rows[4][1].replace("\n", " "), "fr")]  # exact copies, and one in other lines
    kept[-1] = ""  # the copies, cut to nothing by line dedup, are one empty document
    shared = text(rng, "fr", 4)
    own = text(rng, "fr", 9)
    rows += [(110, f"{text(rng, 'fr', 8)}\n{shared}", "fr"), (111, f"{own}\n{shared}", "fr")]  # a passage of four lines in two documents
    kept[110], kept[111] = rows[-2][1], own
    rows += [(120, None, "en"), (121, "", None), (122, "12 34 %%", "en"), (123, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 30, None)]  # no language, or none that is known
    return rows, kept, item


def brute_lines(rows):
    """Later occurrences of windows of three lines, line by line."""
    first, out = set(), []
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            key = tuple(x.strip() for x in lines[k : k + 3])
            if key in first:
                gone |= {k, k + 1, k + 2}
            first.add(key)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, item):
    """The texts that the stages must keep: of documents in a known language (told by the fixture)."""
    rows = brute_lines([(i, t) for i, t, _ in rows if i < 120])
    kept = []
    for i, t in rows:
        s = shingles(t)
        alike = any((not s and not k) or (s and k and len(s & k) >= 0.8 * len(s | k)) for _, _, k in kept)
        if not alike:
            kept.append((i, t, s))
    return {i: t for i, t, _ in kept if item.replace("\n", " ") not in t.replace("\n", " ")}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _, item = documents()
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_gives_what_a_plain_version_gives(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, kept, item = documents()
    want = brute(rows, item)
    empty = [i for i, t in want.items() if not t]
    assert len(empty) <= 1 and {**{i: t for i, t in want.items() if t}, **({-1: ""} if empty else {})} == {i: t for i, t in kept.items() if i != 103}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in want.items()}
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, folder).collect())
    assert {p[0] for p in pieces} == set(ids)
    for doc, start, length, crc, total in pieces:
        assert total == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
    assert all(sum(p[2] for p in pieces if p[0] == d) == len(x) for d, x in ids.items())


def test_stages_on_odd_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.withColumn("cut_id", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("kept_sum", F.lit(2.0)).withColumn("key", F.lit(None).cast("string"))
    odd = odd.union(odd.where("doc_id = 5")).union(odd.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and out.where("cut_id = 1 and fp = 'x'").count() == out.count() > 50
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.near_dedup(spark, odd, folder).where("doc_id = 5").count() == 1
    assert corpus_pipeline.pack(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.pack(spark, odd, folder).where("doc_id is null").count() >= 1


def test_wrappers_are_their_operators(spark, small):
    """The thin queries return what their operators do, over all rows."""
    from loomwork.llm import innerproduct, packing, registry, simhash

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name in ("op1_simhash_neardup", "op2_toxicity", "op7_language_id", "op8_token_store"):
        assert registry.QUERIES[name](spark, small).count() == n
    one = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op1_simhash_neardup"](spark, small).collect()}
    assert one == {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert all(fp == f"{simhash.fingerprint((r.text or '').encode()):016x}" for r in docs.collect() for fp in [one[r.doc_id][0]])
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    found = registry.QUERIES["op4_nearest_neighbours"](spark, small).collect()
    usable = innerproduct.usable(vectors).collect()
    asks = [r for r in usable if r.id % 20 == 0]
    assert len(found) == sum(min(20, sum(x.id != q.id for x in usable)) for q in asks)
    pieces = registry.QUERIES["op5_packing"](spark, small)
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count() == 0
    assert pieces.select("doc_id").distinct().count() == n and packing.SIZE == 1024
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    nine = {(r.doc_id, r.item_id) for r in registry.QUERIES["op9_decontamination"](spark, small).collect()}
    matcher = next(iter(decontaminate.matchers(bench)))
    texts = docs.where("length(text) < 4000").orderBy("doc_id").limit(60).collect()
    for r in texts:  # by alignment of every item with the whole text
        words = decontaminate.words(__import__("pyarrow").array([r.text]))[0].to_pylist()
        number = {w: k + 1 for k, w in enumerate(matcher.vocabulary)}
        flat = np.array([number.get(w, 0) for w in words if w], np.int64)
        want = {(r.doc_id, matcher.ids[k]) for k, x in enumerate(matcher.items) if decontaminate.distance(x, flat)[0] <= matcher.edits[k]}
        assert {x for x in nine if x[0] == r.doc_id} <= want and len(want - nine) <= len(want) // 20


def test_id_columns_that_clash():
    from loomwork.llm import langid, packing, simhash, toxicity

    class Docs:
        sparkSession = dtypes = columns = None

    for call in (
        lambda: packing.pack(Docs, "x", id_col="start"), lambda: langid.predict(Docs, None, id_col="Score"), lambda: decontaminate.find_items(Docs, Docs, id_col="item_id"),
        lambda: simhash.near_duplicates(Docs, id_col="fp"), lambda: toxicity.score(Docs, None, id_col="passages"),
    ):
        with pytest.raises(ValueError, match="may not be called"):
            call()
