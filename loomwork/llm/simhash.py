"""64-bit SimHash fingerprints of whole texts and their links at a small Hamming distance.

Fingerprints
    Words are maximal runs of bytes other than ASCII white space, after lower-casing A-Z only;
    features are word shingles (repeats count), hashed with XXH64 (seed 42).  A bit is set if it
    is set in more than half of the hashes.  A text without words, an empty text and a null text
    have fingerprint zero; a text with fewer words than a shingle has one feature, its words.

Links by deletion-variant signatures
    Two fingerprints that differ in at most ``2 * 1 + 1 = 3`` bits, cut into two 32-bit segments,
    differ in at most one bit in one of the segments.  Each segment is therefore indexed under
    its exact value and under its 32 one-wildcard variants; the equality join of the index with
    itself proposes every pair in reach and nothing else has to be compared.  A wildcard variant
    only pairs fingerprints that differ in the wildcard bit (those that agree there already meet
    under the exact value), so a pair meets at most twice.

Skew
    Copies collapse first (the index holds distinct fingerprints).  Under one key there can still
    be many distinct fingerprints.  Up to ``HOT`` members are dealt into numbered blocks of bounded
    size; each pair of blocks is compared in one bounded task, which hands on a spanning forest of
    the links that it verified, at most one row a member.  The members of a key with more agree in
    its segment but for one bit, so what tells them apart is the other segment: that is cut into
    two and indexed in the same way under the key, and its rest once more where that is hot too.
    A fingerprint makes a bounded number of rows at each level, so the work is linear in the
    members of a key.  No group is held as a whole and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import allow_hash_joins, bounded_batches, cut, cut_narrow, fresh_names, no_clash, partition_count
from loomwork.llm.components import connected_components, spanning_forest
from loomwork.llm.tokens import trimmed

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one UTF-8 text; zero if it has no words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(part) - shingle + 1)
        ones += _bit_counts(h)
    return _bits_of_most(ones, n)


def _bits_of_most(ones: np.ndarray, n: int) -> int:
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of features' hashes; zero if there are none."""
    return _bits_of_most(_bit_counts(hashes), len(hashes))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    full = len(bits) // 240 * 240
    counts = bits[full:].sum(axis=0, dtype=np.int64)
    if full:  # sums of 240 rows fit in a byte, which vectorises well
        counts += np.add.reduce(bits[:full].reshape(-1, 240, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (id, fp signed 64-bit) a document; other columns, whatever their names, are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(trimmed(run), f"id {kind}, fp long")


def _index(fp: Column) -> Column:
    """The index rows of a fingerprint: an array of (key, side, at).

    Side 2 is the exact value of a segment, 0 and 1 are the bit under a wildcard; at is the first
    bit of the other segment.
    """
    segments = [fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)]
    rows = []
    for s, seg in enumerate(segments):
        at = F.lit(32 * (1 - s)).alias("at")
        rows.append(F.struct(seg.bitwiseOR(F.lit((s * 64 + 32) << 32)).alias("key"), F.lit(2).cast("byte").alias("side"), at))
        for i in range(32):
            key = seg.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << i))).bitwiseOR(F.lit((s * 64 + i) << 32))
            rows.append(F.struct(key.alias("key"), F.shiftright(seg, i).bitwiseAND(F.lit(1)).cast("byte").alias("side"), at))
    return F.array(*rows)


def _finer(width: int) -> Column:
    """The index rows, under a key, of the width bits from at, cut into two segments."""
    half = width // 2
    rows = []
    for s in (0, 1):
        seg = F.call_function("shiftrightunsigned", F.col("fp"), F.col("at") + s * half).bitwiseAND(F.lit((1 << half) - 1))
        at = (F.col("at") + half * (1 - s)).alias("at")
        rows.append(F.struct(F.xxhash64("key", F.lit(s), F.lit(half), seg).alias("key"), F.lit(2).cast("byte").alias("side"), at))
        for i in range(half):
            key = F.xxhash64("key", F.lit(s), F.lit(i), seg.bitwiseAND(F.lit(~(1 << i))))
            rows.append(F.struct(key.alias("key"), F.shiftright(seg, i).bitwiseAND(F.lit(1)).cast("byte").alias("side"), at))
    return F.array(*rows)


BLOCK = 256
#: Members of a key up to which pairs of blocks are compared: fewer rows than a finer index makes.
HOT = 32 * BLOCK
#: The bits that a key leaves open, level by level.
WIDTHS = (32, 16, 8)


def near_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """nodes (fp, distinct) -> links (a, b) of fingerprints at most ``distance`` (0 to 3) bits apart.

    The links connect the same fingerprints as all links in reach would; within two blocks under
    one key only a spanning forest of them is returned.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard each reach 3 differing bits at most")
    n = partition_count(nodes.sparkSession)
    # a fingerprint makes 66 rows: few tasks would hold large tables of keys, and an exchange on fp
    # itself would be taken for the one that the nodes come from, which joins small partitions
    index = nodes.repartition(n, F.xxhash64("fp")).select("fp", F.explode(_index(F.col("fp"))).alias("x")).select("fp", "x.*")
    out = None
    for width in WIDTHS:
        seen = index.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        shared = cut(seen.where("n > 1 and (lo = 2 or lo <> hi)").select("key", "n"))
        last = width == WIDTHS[-1]  # no key of this level can have more than some thousand members
        links = _verified(index, shared if last else shared.where(F.col("n") <= HOT), distance)
        out = links if out is None else out.union(links)
        hot = shared.where(F.col("n") > HOT)
        if last or hot.isEmpty():
            break
        members = index.join(hot.select("key"), "key").select("key", "at", "fp")
        index = members.select("fp", F.explode(_finer(width)).alias("x")).select("fp", "x.*")
    return out.distinct()


def _verified(index: DataFrame, shared: DataFrame, distance: int) -> DataFrame:
    """index (key, side, fp) and the keys (key, n) to work on -> a spanning forest of the links of each pair of blocks."""
    n = partition_count(index.sparkSession)
    member = index.join(shared.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "key")
    member = member.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    # the pairs of blocks that a block takes part in; one pair where a key has one block
    pair = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
    )
    dealt = member.select("key", "side", "block", "fp", F.explode(pair).alias("p")).select("key", "p.i", "p.j", "block", "side", "fp")
    order = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            a, b = _close_pairs(group, distance)
            kept = np.array(spanning_forest(zip(a.tolist(), b.tolist(), strict=True)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

    return dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(trimmed(run), "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups (key, i, j); a group has two blocks of rows at most."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = frame[["key", "i", "j"]].iloc[-1:].values
        open_from = len(frame) - int((frame[["key", "i", "j"]].values[::-1] == last).all(axis=1).argmin() or len(frame))
        rest = frame.iloc[open_from:]
        if open_from:
            yield frame.iloc[:open_from]
    if rest is not None and len(rest):
        yield rest


def _close_pairs(frame: pd.DataFrame, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of sorted whole groups, found by comparing rows at growing offsets."""
    key, i, j, block, side = (frame[c].to_numpy() for c in ("key", "i", "j", "block", "side"))
    fp = frame["fp"].to_numpy().view(np.uint64)
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    at, out = np.arange(len(fp)), ([], [])
    for d in range(1, len(fp)):
        at = at[at + d < len(fp)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        other = at + d
        right = (block[at] != block[other]) | (i[at] == j[at])  # a block's own pairs, once
        right &= (side[at] == 2) | (side[at] != side[other])
        right &= np.bitwise_count(fp[at] ^ fp[other]) <= distance
        out[0].append(fp[at[right]])
        out[1].append(fp[other[right]])
    pairs = [np.concatenate(x).view(np.int64) if x else np.array([], np.int64) for x in out]
    return pairs[0], pairs[1]


def _rooted(fps: DataFrame, distance: int) -> DataFrame:
    """fps with fp and id -> one row (fp, least, root) a fingerprint: its least id and the component's name."""
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(near_links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """One row a document: id_col, fp (signed 64-bit), component_id (smallest id in reach).

    A null text counts as empty; texts without words link with each other.  An id that occurs on
    several rows gives as many rows.  Rows with a null id are fingerprinted, link nothing under a
    name and get the smallest non-null id in reach.  An empty table gives no rows.  An id column of a
    result's name is an error; other columns, whatever their names, are not read.
    """
    no_clash(id_col, "fp", "component_id")
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    named = _rooted(fps, distance)
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(of_root, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps one: that with the least id.

    Null ids come last.  Among rows of one id the text with the least hash stays; of rows equal in
    id and text one stays.
    """
    marked = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sum64"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["id", "sum64", "fp"])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    marked = marked.withColumn("text", F.col("text").cast("binary"))
    fps = cut(marked.mapInArrow(trimmed(run), f"id {kind}, sum64 long, fp long"))
    return first_of_each(docs, fps, _rooted(fps, distance).select("fp", "root"), id_col, text_col)


def first_of_each(docs: DataFrame, fps: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the first of their root, by fps (id, sum64, fp) and named (fp, root)."""
    id_, sum_ = fresh_names(docs, "kept_id", "kept_sum")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "sum64")
    first = fps.join(named, "fp").groupBy("root").agg(F.min(order).alias("first"))
    first = cut_narrow(first.select(F.col("first.id").alias(id_), F.col("first.sum64").alias(sum_)))
    on = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(sum_))
    allow_hash_joins(docs.sparkSession)  # saves sorting whole texts
    kept = docs.join(first, on, "left_semi")
    again = fps.groupBy("id", "sum64").count().where("count > 1")
    if again.join(first, F.col("id").eqNullSafe(F.col(id_)) & (F.col("sum64") == F.col(sum_)), "left_semi").isEmpty():
        return kept
    return kept.withColumn(sum_, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, sum_]).drop(sum_)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
