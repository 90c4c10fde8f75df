"""Runs of words: stretches that repeat with a period, found by the factors of a text (Kolpakov and Kucherov).

A run is a stretch of consecutive words with a smallest period q, at least ``times`` times as long as
q and ``least`` words long, that no neighbouring word extends keeping the period.

Stretches
    A run holds each of its word triples ``times`` - 1 times or more.  So a text is cut where a triple
    is rarer, and what follows works on the stretches between.  This loses no run and no neighbour
    that could extend one.

Factors
    The suffix automaton of a stretch knows where each of its substrings first ends.  The factor at a
    place is the longest substring that begins earlier too (it may overlap itself), else one word.

Crossing runs
    A run with ``times`` periods that ends in a factor and begins before it has a period below
    (|last factor| + |factor|) / (times - 1): if it began a period before the last factor, that factor
    would have been longer.  For each boundary and each such period, Main's two extensions tell how
    far the words before and after agree with those a period away.  All are answered together from
    the names of the substrings of 1, 2, 4, ... words, so no hash is trusted.

Inner runs
    All others lie within a factor, and so are copies of runs in its earlier occurrence: they are
    copied from there, from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, no_clash
from loomwork.llm.tokens import slices, trimmed

LEAST, TIMES = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence) of the factors in order; -1 where a word is new."""
    length, link, step, first = [0], [-1], [{}], [-1]
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        step.append({})
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(word)
    while i < n:
        state, end = 0, i
        while end < n and first[after := step[state][word[end]]] < end:
            state, end = after, end + 1
        out.append((i, end - i, first[state] - (end - i) + 1) if end > i else (i, 1, -1))
        i = max(end, i + 1)
    return out


class Extensions:
    """How far two places of a text agree, forwards and backwards, by names of its substrings of 2^k words."""

    def __init__(self, word: np.ndarray):
        self.names = [word.astype(np.int64)]
        width = 1
        while (m := len(word) - 2 * width + 1) > 0:
            low = self.names[-1]
            different, name = np.unique(low[:m] * (int(low.max()) + 1) + low[width : width + m], return_inverse=True)
            self.names.append(name.astype(np.int64))
            if len(different) == m:  # nothing so long occurs twice
                break
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on; a < b."""
        return self._agree(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and b; a < b."""
        return self._agree(a, b, -1)

    def _agree(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        begun, a, b = b, a.copy(), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name, width = self.names[k], 1 << k
            at = np.flatnonzero(b < len(name)) if way > 0 else np.flatnonzero(a >= width)
            back = 0 if way > 0 else width
            at = at[name[a[at] - back] == name[b[at] - back]]
            a[at] += way * width
            b[at] += way * width
        return np.abs(b - begun)


def runs_of_stretch(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of one stretch of word numbers."""
    n = len(word)
    parts = factors(word.tolist())
    start = np.array([p[0] for p in parts] + [n])
    size = np.diff(start, append=n)
    before = np.concatenate([[0], size[:-1]])
    most = np.maximum(before + size - (size > 0), 0) // (times - 1)
    edge = np.repeat(start, most)
    period = np.arange(len(edge)) - np.repeat(np.cumsum(most) - most, most) + 1
    grown = Extensions(word)
    runs: dict[tuple[int, int], int] = {}
    for shift in (0, 1):  # with a period after the boundary, with one before it
        a = edge - shift * period
        fits = (a >= 0) & (a + period <= n)
        a, p = a[fits], period[fits]
        lo, hi = a - grown.backward(a, a + p), a + p + grown.forward(a, a + p)
        long = hi - lo >= np.maximum(least, times * p)
        for s, e, q in zip(lo[long].tolist(), hi[long].tolist(), p[long].tolist(), strict=True):
            runs[s, e] = min(q, runs.get((s, e), q))
    if runs:
        _copy_inner(parts, runs, least)
    return runs


def _copy_inner(parts: list[tuple[int, int, int]], runs: dict[tuple[int, int], int], least: int) -> None:
    by_start: dict[int, dict[int, int]] = {}
    for (s, e), q in runs.items():
        by_start.setdefault(s, {})[e] = q
    for start, size, source in parts:
        if source < 0 or size < least:
            continue
        gap = start - source
        for s in range(start + 1, start + size - least):
            for e, q in by_start.get(s - gap, {}).items():
                if e + gap < start + size:  # its ends are seen inside the factor
                    runs[s, e + gap] = q
                    by_start.setdefault(s, {})[e + gap] = q


def stretches(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of what can hold a run, in order."""
    shortest, often = max(least, times), min(times - 1, max(least, times) - 2)
    if len(word) < shortest:
        return []
    if often < 2 or shortest < 3:
        return [(0, len(word))]
    pair = word[:-1].astype(np.int64) * (int(word.max()) + 1) + word[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * (int(pair.max()) + 1) + pair[1:]
    _, name, count = np.unique(triple, return_inverse=True, return_counts=True)
    fine = np.concatenate([[0], (count[name] >= often).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(fine)).reshape(-1, 2)
    return [(a, b + 2) for a, b in turns.tolist() if b + 2 - a >= shortest]


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs by start, then period."""
    if len(words) < max(least, times):
        return []
    seen: dict = {}
    word = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    found = []
    for a, b in stretches(word, least, times):
        part = np.unique(word[a:b], return_inverse=True)[1]
        found += [(a + s, e - s, q) for (s, e), q in runs_of_stretch(part, least, times).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id, runs, collapsed): each row's runs by start, then period, and its text without their repeats.

    Words are what stands between ASCII white space; ``collapsed`` joins them by one space.  Null and
    empty texts have no word, no run and an empty ``collapsed``; ids may be null and repeat, and an
    empty table gives no rows.  Other columns, whatever their names, are not read.  No exchange: each
    row is worked on by itself, in slices of a few MB; memory follows the longest stretch of a text.
    """
    no_clash(id_col, "runs", "collapsed")
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and a word at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for a, b in slices(texts, 4 << 20):
                runs, kept = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    words = (text or b"").split()  # bytes are split at ASCII white space
                    found = runs_of(words, least, times)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    kept.append(b" ".join(collapsed(words, found)))
                columns = [batch.column(0).slice(a, b - a), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "runs", "collapsed"])

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, runs {RUNS}, collapsed string"
    return found.mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_col)


def looped(doc_id: Column, text: Column, words: Column) -> Column:
    """The text, of which a tenth by the id's checksum repeats a piece of itself up to the end.

    words: those of the text where it is one of them, else null; see ``loops``.
    """
    n, g = F.size(words), F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when(n > 0, F.array_join(whole, " ")).otherwise(text)


def loops(doc_id: Column) -> Column:
    """Whether the query repeats words of the document; never without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's digests of ``periodic_runs`` over the documents, a tenth of them looped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(loops(F.col("doc_id")), words))
    docs = docs.select("doc_id", looped(F.col("doc_id"), F.col("text"), F.col("words")).alias("text"))
    found = periodic_runs(docs)
    # the greatest length / period, compared as whole numbers
    order = lambda x, y: F.when(x.length * y.period != y.length * x.period, F.when(x.length * y.period > y.length * x.period, -1).otherwise(1)).when(
        x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)
    ).otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0))
    found = found.withColumn("best", F.get(F.array_sort("runs", order), F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
