"""Benchmark items in documents, exact or with a few edited words.

A document holds an item if one of its runs of words is within ``floor(rate * m)`` word edits of the
item's m words.  Words are runs of letters, marks and digits, lower-cased.

0.  Parts.  Items of more than ``PART`` words are looked for by parts of about that size, as walks
    drift apart with their length.  If an item is within its edits of a run, then one of its parts
    at least is within ``floor(rate * its words)`` edits of a part of the run.
1.  Windows.  A run within k edits of a part of m words shares a q-gram of words with it if
    q * (k + 1) <= m (q-gram lemma), so only places that share one can start a window of the
    part's size.  No run within reach is lost here.
2.  CGK embedding.  Windows and parts, cut to the shortest length of their class, walk at random
    over their words: at each of up to 3L steps the current word is put out and a random bit of
    (step, word) tells whether to go on to the next.  With common random bits, strings at a small
    edit distance have outputs at a small Hamming distance.
3.  LSH by sampling the output at ``SAMPLES`` random steps of a short random stretch.  Walks are
    repeated, as often as edited copies of the parts at the greatest allowed distance need to
    collide with the target recall.  Where ``MOST_WALKS`` of them don't reach it, there are none:
    every window of the class is a candidate then, which is exact.
4.  Every candidate is verified: Myers' bit-parallel alignment gives the exact edit distance of the
    whole item to the best run around.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words; only one block's tables are sent
to the executors at a time, and each block is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, no_clash
from loomwork.llm.tokens import slices, trimmed

RATE = 0.2
RECALL = 0.99
SAMPLES = 3
GRAM = 4
BLOCK_WORDS = 1 << 20
PART = 128
MOST_WALKS = 256
#: Places that are looked up at once.
_LOOKUPS = 1 << 20
_PAD = -1


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, some of them empty, and where each text's words start (and the last end)."""
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}\p{N}]+", " ")
    lists = pc.split_pattern(bare, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to a run of text, and where the first such run ends."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        x = eq | minus
        diag = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(diag | plus) & full)
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(x | up) & full)
        minus = up & x
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class _Class:
    """Parts whose lengths are alike; walks: a row (step multipliers, addends, sampled steps) each, none if exact."""

    length: int
    parts: np.ndarray
    exact: bool = False
    walks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def _walk(w: np.ndarray, walk: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The LSH key of each row of w, a window of word numbers that ends with a column of padding."""
    mult, add, steps = walk
    rows, at, last = np.arange(len(w)), np.zeros(len(w), np.int64), w.shape[1] - 1
    key = np.zeros(len(w), np.uint64)
    take = set(steps.tolist())
    for j in range(int(steps.max()) + 1):
        now = w[rows, at]
        if j in take:
            key = (key ^ (now + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        go = (((now + 2).astype(np.uint64) * mult[j] + add[j]) >> np.uint64(63)).astype(np.int64)
        at = np.minimum(at + np.where(now == _PAD, 0, go), last)
    return key


def _windows(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    at = starts[:, None] + np.arange(length + 1)
    inside = (at < ends[:, None]) & (np.arange(length + 1) < length)
    return np.where(inside, flat[np.minimum(at, len(flat) - 1)], _PAD) if len(flat) else np.full(at.shape, _PAD)


def _edited(item: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(k):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[at] = 0
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, 0)
    return np.array(out, np.int64)


class Matcher:
    """One block of items, ready to be looked for.  Word 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, list[str]]], rate: float = RATE, recall: float = RECALL, seed: int = 7):
        self.ids = [i for i, _ in items]
        self.vocabulary = sorted({w for _, ws in items for w in ws})
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        self.items = [np.array([number[w] for w in ws], np.int64) for _, ws in items]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.array([math.floor(rate * len(x)) for x in self.items], np.int64)
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)
        cut = [np.array_split(np.arange(len(x)), -(-len(x) // PART)) for x in self.items]
        self.item_of = np.array([k for k, c in enumerate(cut) for _ in c], np.int64)
        self.offset = np.array([p[0] for c in cut for p in c], np.int64)
        self.parts = [self.items[k][p] for k, c in enumerate(cut) for p in c]
        self.part_edits = [math.floor(rate * len(x)) for x in self.parts]
        by_class: dict[int, list[int]] = {}
        for k, x in enumerate(self.parts):
            by_class.setdefault(int(2 * math.log2(len(x))), []).append(k)
        self.classes = [self._class(np.array(v), recall, rng) for _, v in sorted(by_class.items())]
        self.class_of = np.zeros(len(self.parts), np.int64)
        for c, found in enumerate(self.classes):
            self.class_of[found.parts] = c
        self.grams = self._grams()

    def _hash(self, flat: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(q):
            h += flat[at + k].astype(np.uint64) * self.salt[k]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return h

    def _grams(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """q -> sorted gram hashes, with a target and a place in it of each, without repeats.

        The target is a class, whatever parts of it have the gram, or -1 - part where the class is
        exact.
        """
        rows: dict[int, list[np.ndarray]] = {}
        for k, x in enumerate(self.parts):
            q = min(GRAM, len(x) // (self.part_edits[k] + 1))
            h = self._hash(x, np.arange(len(x) - q + 1), q)
            target = -1 - k if self.classes[self.class_of[k]].exact else int(self.class_of[k])
            rows.setdefault(q, []).append(np.stack([h.view(np.int64), np.full(len(h), target), np.arange(len(h))]))
        out = {}
        for q, found in rows.items():
            h, target, place = np.unique(np.concatenate(found, axis=1), axis=1)
            by = np.argsort(h.view(np.uint64), kind="stable")
            out[q] = h.view(np.uint64)[by], target[by], place[by]
        return out

    def _class(self, parts: np.ndarray, recall: float, rng: np.random.Generator) -> _Class:
        found = _Class(min(len(self.parts[k]) for k in parts), parts)

        def draw() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = 3 * found.length
            # steps near each other: two walks that agree at one mostly agree at the next
            near = min(2 * found.length, SAMPLES * 2)
            steps = rng.integers(2 * found.length - near + 1) + np.sort(rng.choice(near, min(SAMPLES, near), replace=False))
            return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64), steps

        def rows(texts: list[np.ndarray]) -> np.ndarray:
            flat, sizes = np.concatenate(texts), np.array([len(x) for x in texts])
            stops = np.cumsum(sizes)
            return _windows(flat, stops - sizes, stops, found.length)

        # how often do parts at the greatest allowed distance collide in one walk?
        tried = [int(k) for k in parts[:: max(1, len(parts) // 64)]]
        own = rows([self.parts[k] for k in tried for _ in range(8)])
        far = rows([_edited(self.parts[k], self.part_edits[k], rng) for k in tried for _ in range(8)])
        hits = np.mean([_walk(own, w) == _walk(far, w) for w in (draw() for _ in range(48))], axis=0)
        # recall is a mean over pairs, and far pairs collide less often than the mean pair
        n = 1
        while n <= MOST_WALKS and np.mean(1 - (1 - hits) ** n) < recall:
            n += 1
        if n > MOST_WALKS:
            found.exact = True
            return found
        full = rows([self.parts[k] for k in parts])
        for _ in range(n):
            walk = draw()
            key = _walk(full, walk)
            by = np.argsort(key, kind="stable")
            found.walks.append(walk)
            found.keys.append((key[by], parts[by]))
        return found

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, past the last word, edits): one best run a text and item."""
        flat_words, at = words(texts)
        known = pc.index_in(flat_words, value_set=pa.array(self.vocabulary, pa.string()))
        flat = (pc.fill_null(known, -1).to_numpy().astype(np.int64)) + 1
        doc, target, start = self._seeds(flat, at)
        # (text, item, first and past the last word of the words to align), of all candidates
        regions = [self._regions(at, doc[target < 0], -1 - target[target < 0], start[target < 0])]
        for c, found in enumerate(self.classes):
            mine = target == c
            docs, begins = doc[mine], start[mine]
            for lo in range(0, len(docs), 1 << 14):
                d, s = docs[lo : lo + (1 << 14)], begins[lo : lo + (1 << 14)]
                w = _windows(flat, s, at[d + 1], found.length)
                pairs = [_matches(_walk(w, walk), *keys) for walk, keys in zip(found.walks, found.keys, strict=True)]
                row, part = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
                regions.append(self._regions(at, d[row], part, s[row]))
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, item, lo, hi in _joined(np.concatenate(regions, axis=1)).T.tolist():
            self._verify(flat, int(at[d]), d, lo, hi, item, out)
        return [(d, k, *run) for (d, k), run in sorted(out.items())]

    def _regions(self, at: np.ndarray, doc: np.ndarray, part: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where a part's item must lie if the part begins at start, with its edits to either side."""
        item = self.item_of[part] if len(part) else part
        first = start - (self.offset[part] if len(part) else 0)
        lo = np.maximum(at[doc], first - 2 * self.edits[item])
        return np.stack([doc, item, lo, np.minimum(at[doc + 1], first + self.sizes[item] + 2 * self.edits[item])])

    def _seeds(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different (text, target, start) of windows that share a q-gram with a part.

        Looked up in chunks, so a gram that is frequent on both sides takes time but no memory:
        there are no more different rows than words times targets.
        """
        parts: list[np.ndarray] = []
        size = 0
        for q, (hashes, target, place) in self.grams.items():
            if len(flat) < q or q == 0:
                continue
            ok = flat[: len(flat) - q + 1] > 0
            for k in range(1, q):
                ok &= flat[k : len(flat) - q + 1 + k] > 0
            p = np.flatnonzero(ok)
            d = np.searchsorted(at, p, side="right") - 1
            inside = p + q <= at[d + 1]
            p, d = p[inside], d[inside]
            h = self._hash(flat, p, q)
            first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            hit = np.flatnonzero(last > first)
            n, first = (last - first)[hit], first[hit]
            total = np.cumsum(n)
            lo = 0
            while lo < len(hit):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _LOOKUPS, side="right")))
                m = n[lo:hi]
                entry = np.repeat(first[lo:hi] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                which = np.repeat(hit[lo:hi], m)
                start = np.maximum(p[which] - place[entry], at[d[which]])
                parts.append(np.unique(np.stack([d[which], target[entry], start]), axis=1))
                size += parts[-1].shape[1]
                if size > 4 * _LOOKUPS and len(parts) > 1:
                    parts = [np.unique(np.concatenate(parts, axis=1), axis=1)]
                    size = 0  # what is left is no repeat
                lo = hi
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none
        rows = np.unique(np.concatenate(parts, axis=1), axis=1)
        return rows[0], rows[1], rows[2]

    def _verify(self, flat: np.ndarray, begin: int, d: int, lo: int, hi: int, item: int, out: dict) -> None:
        """Aligns the item with the words from lo to hi of text d, which begins at begin; keeps the best run."""
        x, k = self.items[item], int(self.edits[item])
        known = out.get((d, item))
        if known and known[2] == 0:
            return
        edits, stop = distance(x, flat[lo:hi])
        if edits > k:
            return
        # aligned backwards from its end, the run's start comes out
        _, size = distance(x[::-1], flat[lo : lo + stop][::-1])
        run = (lo + stop - size - begin, lo + stop - begin, edits)
        if known is None or (run[2], run[0]) < (known[2], known[0]):
            out[d, item] = run


def _joined(regions: np.ndarray) -> np.ndarray:
    """The regions (text, item, lo, hi), those of one text and item that overlap as one."""
    regions = regions[:, np.lexsort((regions[2], regions[1], regions[0]))]
    if not regions.shape[1]:
        return regions
    new = np.r_[True, (regions[:2, 1:] != regions[:2, :-1]).any(axis=0)]
    # the largest end so far within a text and item: groups are lifted over each other
    lift = np.cumsum(new) * (int(regions[3].max()) + 1)
    reach = np.maximum.accumulate(regions[3] + lift) - lift
    first = new | np.r_[True, regions[2, 1:] >= reach[:-1]]
    heads = np.flatnonzero(first)
    tails = np.r_[heads[1:], regions.shape[1]] - 1
    return np.stack([regions[0, heads], regions[1, heads], regions[2, heads], reach[tails]])


def _matches(keys: np.ndarray, have: np.ndarray, item: np.ndarray) -> np.ndarray:
    """(row, item) for all entries of the sorted have that equal a row's key."""
    first, last = np.searchsorted(have, keys), np.searchsorted(have, keys, side="right")
    n = last - first
    row = np.repeat(np.arange(len(keys)), n)
    entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.stack([row, item[entry].astype(np.int64)])


def matchers(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = RATE, recall: float = RECALL) -> Iterator[Matcher]:
    """The benchmark's items in blocks of bounded size.  Items without words match nothing."""
    items, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i").toLocalIterator():
        found = [w for w in words(pa.array([row.t], pa.string()))[0].to_pylist() if w]
        if not found:
            continue
        items.append((row.i, found))
        size += len(found)
        if size >= BLOCK_WORDS:
            yield Matcher(items, rate, recall)
            items, size = [], 0
    if items:
        yield Matcher(items, rate, recall)


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, recall: float = RECALL,
) -> DataFrame:
    """One row a document and item that it holds: id_col, item_id, first_word, end_word, edits, similarity.

    Null or empty texts and items hold and match nothing.  Rows of docs with one id are reported
    one by one; so are items with one id.  Among runs equally near the first is told.  An empty table
    on either side gives no rows.  An id column of a result's name is an error; other columns are not read.
    """
    no_clash(id_col, "item_id", "first_word", "end_word", "edits", "similarity")
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, item_id long, first_word long, end_word long, edits int, similarity double"
    bounded_batches(docs.sparkSession)
    out = None
    for matcher in matchers(benchmark, item_col, item_text_col, rate, recall):
        kept = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            m = kept.value
            for batch in batches:
                texts = batch.column(1)
                for a, b in slices(texts):
                    found = m.find(texts.slice(a, b - a))
                    col = [np.array(c, np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
                    ids = np.array(m.ids, np.int64)[col[1]]
                    sizes = m.sizes[col[1]].astype(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(col[0] + a)), pa.array(ids), pa.array(col[2]), pa.array(col[3]),
                            pa.array(col[4], pa.int32()), pa.array(1 - col[4] / np.maximum(sizes, 1)),
                        ],
                        names=[id_col, "item_id", "first_word", "end_word", "edits", "similarity"],
                    )

        part = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, recall: float = RECALL,
) -> DataFrame:
    """The rows of docs, all columns, that hold no item; a pass without a shuffle for each block of items."""
    bounded_batches(docs.sparkSession)
    for matcher in matchers(benchmark, item_col, item_text_col, rate, recall):
        kept = docs.sparkSession.sparkContext.broadcast(matcher)
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], kept=kept, place=place) -> Iterator[pa.RecordBatch]:
            m = kept.value
            for batch in batches:
                texts = batch.column(place)
                keep = np.ones(len(texts), bool)
                for a, b in slices(texts):
                    keep[[a + d for d, *_ in m.find(texts.slice(a, b - a))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
