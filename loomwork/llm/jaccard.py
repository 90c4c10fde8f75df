"""Near copies by SimHash fingerprints and the Jaccard similarity of their sets of word shingles.

Words are those of ``simhash``; a text with fewer words than a shingle has one, its words, and a
text without words has none.  Texts of equal sets collapse first.

Fingerprints
    A set has a SimHash fingerprint, and the deletion-variant index of ``simhash`` links those at 3
    or fewer differing bits.  The sets of a component of fingerprints are compared exactly, and those
    that are similar are one component from then on.

Candidates further apart
    Sets of similarity 0.8 differ in up to 11 bits and more, which no index of fingerprints reaches
    in a bounded number of rows.  So a set also has ``BANDS`` keys, each of the ``ROWS`` least values of the set's hashes under as many
    permutations.  Two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS,
    which is 0.9996 at 0.8.  A key whose members the fingerprints have made one component is done;
    of the others those with the same members are worked on once.

Links
    The sets of a key's members are compared exactly.  Members are dealt into blocks, each key in its
    own way, and first only those of one block are compared, which is linear in the members.  Then a
    pair of a key's blocks is compared unless all its members are linked already: groups of thousands
    of near copies are one component by then, and only keys that join different texts cost more.
    As in ``simhash`` a pair of blocks is one task, which hands on a spanning forest.  A block has so
    many members that its sets have ``BLOCK_HASHES`` hashes at most, or one member.

Hot keys
    A key whose members are mostly different texts, such as those with one long passage in common,
    would cost the square of their number.  Where more than ``PAIRS`` pairs of a key's blocks are left,
    its members are indexed anew under the key by ``INNER_BANDS`` keys of ``INNER_ROWS`` other least
    values, of which similar sets share one with probability 0.9999, and others hardly any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import allow_hash_joins, bounded_batches, cut, cut_narrow, partition_count
from loomwork.llm.components import connected_components, spanning_forest
from loomwork.llm.simhash import LOWER, SEED, fingerprint_of, first_of_each, near_links, whole_groups
from loomwork.llm.tokens import trimmed

BANDS = 20
ROWS = 5
BLOCK, BLOCK_HASHES = 256, 1 << 20
PAIRS = 64
INNER_BANDS, INNER_ROWS = 50, 8
_CHUNK = 1 << 11
_COLUMNS = 1 << 12
#: Hashes of all sets that are compared at once.
_TOGETHER = 1 << 20
#: Hashes of texts of one task that are remembered.
_REMEMBERED = 1 << 21
_DRAWN = np.random.default_rng(SEED)
_FACTORS, _SHIFTS = _DRAWN.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INNER = _DRAWN.integers(0, 1 << 63, (2, INNER_BANDS * INNER_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted different hashes of a text's word shingles."""
    words = (text or b"").translate(LOWER).split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def _keys(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray, bands: int, seed: int = 0) -> list[int]:
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK] * factors + shifts).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), seed + k) for k, band in enumerate(least.reshape(bands, -1))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set, signed; none if the set is empty."""
    return _keys(hashes, _FACTORS, _SHIFTS, BANDS)


def inner_keys(hashes: np.ndarray, key: int) -> list[int]:
    """The keys of a set under one of its keys, which is hot."""
    return _keys(hashes, *_INNER, INNER_BANDS, key & 0x7FFFFFFFFFFF)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The places (a, b), a before b, of sets at least so similar; computed in bounded parts."""
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)))
    # the hashes' range in parts, so that a part of all sets is bounded however long the texts are
    edges = np.linspace(0, float(1 << 64), max(1, -(-int(sizes.sum()) // _TOGETHER)) + 1)[1:-1].astype(np.uint64)
    bounds = np.array([[0, *np.searchsorted(s, edges), len(s)] for s in sets])
    for k in range(bounds.shape[1] - 1):
        _count_common([s[a:b] for s, a, b in zip(sets, bounds[:, k], bounds[:, k + 1], strict=True)], common)
    near = common >= similarity * (sizes[:, None] + sizes - common) - 1e-9
    return np.nonzero(np.triu(near, 1))


def _count_common(sets: list[np.ndarray], common: np.ndarray) -> None:
    """Adds to common how many hashes each two of the sets share."""
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = (count > 1)[place]  # a hash in one set only is in no intersection
    column = (np.cumsum(count > 1) - 1)[place[held]]
    row = np.repeat(np.arange(len(sets)), sizes)[held]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + _COLUMNS]))
        held_by = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        held_by[row[part], column[part] - lo] = 1
        common += held_by @ held_by.T


def near_fingerprints(marked: DataFrame) -> DataFrame:
    """marked (fp, size, mark: a set's fingerprint) -> (fp, size, key): the sets of each component of fingerprints.

    Sets that are alone in theirs have no row.
    """
    marks = cut_narrow(marked.groupBy("mark").agg(F.count("*").alias("n")))
    roots = connected_components(near_links(marks.select(F.col("mark").alias("fp"))))
    shared = marks.join(roots.withColumnRenamed("node", "mark"), "mark", "left").where("n > 1 or root is not null")
    return marked.join(shared.select("mark", F.coalesce("root", "mark").alias("key")), "mark").select("fp", "size", "key")


def _links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """nodes (fp, keys, size, mark), texts (id, sum64, text) and nodes' (id, sum64) -> links (a, b) of similar sets.

    The links connect the same sets as all links among members of a key would; without fingerprints
    (mark) nothing is linked beforehand.
    """
    who = nodes.select("fp", F.col("id").alias("at"), F.col("sum64").alias("sum"))
    on = F.col("id").eqNullSafe(F.col("at")) & (F.col("sum64") == F.col("sum"))
    allow_hash_joins(nodes.sparkSession)

    def found(fps: DataFrame) -> DataFrame:
        """(fp, text), a row for each of the sets."""
        return texts.join(who.join(fps, "fp", "left_semi"), on).select("fp", "text").dropDuplicates(["fp"])

    comparison = _Comparison(found, partition_count(nodes.sparkSession), shingle, similarity)
    if "mark" not in nodes.columns:
        return comparison.links(nodes.select("fp", "size", F.explode("keys").alias("key")), True)
    near = cut_narrow(comparison.links(cut_narrow(near_fingerprints(nodes.where("size > 0").select("fp", "size", "mark"))), True))
    # a key of sets that are one component already has nothing to link
    rooted = nodes.join(connected_components(near).withColumnRenamed("node", "fp"), "fp", "left")
    index = rooted.select("fp", "size", F.coalesce("root", "fp").alias("root"), F.explode("keys").alias("key"))
    return near.union(comparison.links(index, True))


class _Comparison:
    """Comparing the members of keys, whose texts are looked up by ``found``."""

    def __init__(self, found: Callable[[DataFrame], DataFrame], partitions: int, shingle: int, similarity: float):
        self.found, self.partitions, self.shingle, self.similarity = found, partitions, shingle, similarity

    def compared(self, dealt: DataFrame, texts: DataFrame) -> DataFrame:
        """dealt (key, i, j, fp) -> links of each group (key, i, j)."""
        order, shingle, similarity = ["key", "i", "j"], self.shingle, self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}
            size = 0
            for frame in whole_groups(batches):
                for _, group in frame.groupby(order, sort=False):
                    fps = group["fp"].to_numpy()
                    for fp, text in zip(fps.tolist(), group["text"], strict=True):
                        if fp not in known:
                            known[fp] = shingles(text, shingle)
                            size += len(known[fp])
                    a, b = similar_pairs([known[fp] for fp in fps.tolist()], similarity)
                    kept = np.array(spanning_forest(zip(fps[a].tolist(), fps[b].tolist(), strict=True)), np.int64).reshape(-1, 2)
                    if len(kept):
                        yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])
                    if size > _REMEMBERED:
                        known, size = {}, 0

        rows = dealt.join(texts, "fp").select(*order, "fp", "text")
        return rows.repartition(self.partitions, *order).sortWithinPartitions(*order).mapInArrow(trimmed(run), "a long, b long")

    def indexed_anew(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """members (key, fp, size) of hot keys -> their index (fp, size, key) by inner keys."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hot, fps, sizes, given = (batch.column(c) for c in range(4))
                keys = [inner_keys(shingles(t.as_py(), shingle), k) for k, t in zip(hot.to_pylist(), given, strict=True)]
                yield pa.RecordBatch.from_arrays([fps, sizes, pa.array(keys, pa.list_(pa.int64()))], names=["fp", "size", "keys"])

        given = members.join(texts, "fp").select("key", "fp", "size", "text")
        return given.mapInArrow(trimmed(run), "fp long, size long, keys array<long>").select("fp", "size", F.explode("keys").alias("key"))

    def links(self, index: DataFrame, split: bool) -> DataFrame:
        """index (fp, size, key) -> links (a, b); split: whether hot keys are indexed anew.

        Where the index has roots, what is linked already, keys with a single one are done.
        """
        who = F.struct(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("y"), F.sum("size").alias("size"))
        root = F.col("root" if "root" in index.columns else "fp")
        alike = index.groupBy("key").agg(who.alias("who"), F.min(root).alias("lo"), F.max(root).alias("hi")).where("who.n > 1 and lo < hi").select("key", "who")
        index = index.select("fp", "size", "key")
        blocks = F.least(F.col("who.n"), F.greatest(F.ceil(F.col("who.n") / BLOCK), F.ceil(F.col("who.size") / BLOCK_HASHES))).cast("int")
        shared = alike.groupBy("who").agg(F.min("key").alias("key")).select("key", blocks.alias("k"))
        block = F.pmod(F.xxhash64("fp", "key"), F.col("k")).cast("int")
        member = cut(index.join(shared, "key").withColumn("block", block))
        texts = self.found(member.select("fp").distinct())
        within = self.compared(member.select("key", F.col("block").alias("i"), F.col("block").alias("j"), "fp"), texts).distinct()
        several = member.where("k > 1")
        if several.isEmpty():
            return within
        within = cut_narrow(within)
        roots = connected_components(within).withColumnRenamed("node", "fp")
        rooted = several.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        blocks = rooted.groupBy("key", "k", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        if split:
            # linked blocks hold one root; what a key has besides tells how many pairs are left
            many = blocks.groupBy("key", "k").agg(F.count_if(F.col("lo") < F.col("hi")).alias("mixed"), F.countDistinct("lo").alias("apart"))
            left = F.col("mixed") * F.col("k") + F.col("apart") * (F.col("apart") - 1) / 2
            hot = cut_narrow(many.where(left > PAIRS).select("key"))
            if not hot.isEmpty():
                again = member.join(hot, "key", "left_semi").select("key", "fp", "size")
                anew = self.indexed_anew(again, self.found(again.select("fp").distinct()))
                within = cut_narrow(within.union(self.links(cut(anew), False)))
                blocks = blocks.join(hot, "key", "left_anti")
        # the pairs of blocks that a block takes part in; those of one component only are done
        pair = F.transform(
            F.sequence(F.lit(0), F.col("k") - 1),
            lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
        )
        apart = blocks.select("key", "lo", "hi", F.explode(pair).alias("p")).where("p.i < p.j")
        apart = apart.groupBy("key", "p.i", "p.j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        sides = cut_narrow(apart.select("key", "i", "j", F.explode(F.array("i", "j")).alias("block")))
        if sides.isEmpty():
            return within
        dealt = member.join(sides, ["key", "block"]).select("key", "i", "j", "fp")
        return within.union(self.compared(dealt, self.found(dealt.select("fp").distinct()))).distinct()


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of docs, all columns, of which each group of linked texts keeps one: that with the least id.

    Null ids, and rows of one id, are as in ``simhash.keep_one``; texts without words link with each other.
    """
    marked = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sum64"), F.col(text_col).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, marks = np.zeros((2, batch.num_rows), np.uint64)
            sizes, keys = np.zeros(batch.num_rows, np.int64), []
            for k, text in enumerate(batch.column(2)):
                hashes = shingles(text.as_py(), shingle)
                sizes[k] = len(hashes)
                fps[k], marks[k] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED), fingerprint_of(hashes)
                keys.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(fps.view(np.int64)), pa.array(sizes), pa.array(marks.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "sum64", "fp", "size", "mark", "keys"],
            )

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    fps = cut(marked.mapInArrow(trimmed(run), f"id {kind}, sum64 long, fp long, size long, mark long, keys array<long>"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "sum64")
    nodes = cut(fps.groupBy("fp").agg(F.min(F.struct(order.alias("first"), "size", "mark", "keys")).alias("m")).select("fp", "m.first.id", "m.first.sum64", "m.size", "m.mark", "m.keys"))
    roots = connected_components(_links(nodes, marked, shingle, similarity)).withColumnRenamed("node", "fp")
    named = nodes.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return first_of_each(docs, fps.select("id", "sum64", "fp"), named, id_col, text_col)
