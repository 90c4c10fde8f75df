"""Packing documents into token sequences of bounded length by order-preserving dynamic programming.

Documents stand in the order in which the partition has them.  Cuts between sequences may fall at
the end of a document (free), at the end of a sentence (``SENTENCE_CUT`` tokens' worth), or, in
sentences of more than ``GRID`` tokens, at a multiple of ``GRID`` tokens (``HARD_CUT``).  A sequence is padded to ``size`` unless its length is a power of two.  Over all
ways to cut, the sum of padding and penalties is least:

    cost[j] = penalty[j] + min over i of cost[i] + pad(at[j] - at[i]),   at[j] - at[i] <= size

With padding size - (at[j] - at[i]) the minimum runs over cost[i] - at[i] ... in a window whose two
ends only move forward, so a queue of rising minima gives each transition in constant time; the
lengths that are powers of two are looked up beside it.

A partition's documents are packed in stretches of about ``STRETCH`` tokens, each to its own end, so
memory is bounded by a stretch and the longest document.  There is no shuffle and no order between
partitions; a sequence's number has the partition in its high bits.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, no_clash
from loomwork.llm.tokens import slices, token_ids, trimmed

SIZE = 1024
SENTENCE_CUT = 2
HARD_CUT = 8
GRID = 32
STRETCH = 4 << 20


def best_cuts(at: list[int], penalty: list[int], size: int = SIZE) -> tuple[list[int], int]:
    """The chosen cuts' indexes, first and last place included, and their cost.

    at: rising places, from the start to the end, with gaps of ``size`` at most; penalty: of a cut
    at each; those of the first and last don't count.
    """
    n = len(at)
    cost, back = [0] * n, [0] * n
    exact = _power_steps(np.array(at, np.int64), size)
    step = next(exact, (n, 0))
    # cost[i] + size - (at[j] - at[i]) = (cost[i] + at[i]) + size - at[j]
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])
    for j in range(1, n):
        here = at[j]
        oldest = here - size
        while at[queue[0][1]] < oldest:
            queue.popleft()
        value, best = queue[0]
        value += size - here
        while step[0] == j:
            if cost[step[1]] < value:
                value, best = cost[step[1]], step[1]
            step = next(exact, (n, 0))
        if j < n - 1:
            value += penalty[j]
        cost[j], back[j] = value, best
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1], cost[-1]


def _power_steps(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """The pairs (j, i) whose distance is a power of two up to size, by rising j."""
    pairs = []
    for k in range(size.bit_length()):
        i = np.minimum(np.searchsorted(at, at - (1 << k)), len(at) - 1)
        j = np.flatnonzero(at[i] == at - (1 << k))
        pairs.append(np.stack([j, i[j]]))
    both = np.concatenate(pairs, axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    return zip(both[0].tolist(), both[1].tolist(), strict=True)


def places(sizes: np.ndarray, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may fall, and their penalties: sizes of documents, places of sentence ends."""
    stops = np.cumsum(sizes)
    total = int(stops[-1])
    soft = np.union1d(np.r_[0, stops], ends)
    wide = np.flatnonzero(np.diff(soft) > GRID)
    grids = [np.arange(soft[k] + GRID, soft[k + 1], GRID) for k in wide]
    at = np.union1d(soft, np.concatenate(grids)) if grids else soft
    penalty = np.full(len(at), HARD_CUT, np.int64)
    penalty[np.searchsorted(at, soft)] = SENTENCE_CUT
    penalty[np.searchsorted(at, np.r_[0, stops])] = 0
    return at[at <= total], penalty[at <= total]


class _Stretch:
    """Documents that wait to be packed together."""

    def __init__(self):
        self.docs, self.ids, self.sizes, self.ends, self.total = [], [], [], [], 0

    def add(self, docs: pa.Array, ids: list[np.ndarray], ends: list[np.ndarray]) -> None:
        self.docs.append(docs)
        for x, e in zip(ids, ends, strict=True):
            self.ids.append(x)
            self.sizes.append(len(x))
            self.ends.append(e + self.total)
            self.total += len(x)

    def pack(self, size: int, first_sequence: int) -> tuple[dict[str, np.ndarray], pa.Array, int]:
        sizes = np.array(self.sizes, np.int64)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        at, penalty = places(sizes, np.concatenate(self.ends), size)
        chosen, _ = best_cuts(at.tolist(), penalty.tolist(), size)
        cuts = at[chosen]
        lo = np.union1d(cuts[:-1], starts)  # pieces: cut at sequences' and documents' starts
        hi = np.r_[lo[1:], self.total]
        doc = np.searchsorted(starts, lo, side="right") - 1
        seq = np.searchsorted(cuts, lo, side="right") - 1
        flat = memoryview(np.concatenate(self.ids).tobytes())
        crc = np.fromiter((zlib.crc32(flat[a * 4 : b * 4]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(lo))
        piece = {
            "start": lo - starts[doc], "length": hi - lo, "ids_crc32": crc, "doc_tokens": sizes[doc],
            "sequence_id": first_sequence + seq, "offset": lo - cuts[seq],
        }
        return piece, pa.concat_arrays(self.docs).take(pa.array(doc)), first_sequence + len(cuts) - 1


def pack(
    docs: DataFrame, tokenizer: str, spaces: str = "leading", end_id: int = 0, size: int = SIZE,
    id_col: str = "doc_id", text_col: str = "text", remembered: int = 1_000_000, slice_bytes: int = 12 << 20, stretch: int = STRETCH,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its text's ids and the end id, so null and empty texts have one token.  Each
    token is in exactly one piece, and a piece's offset is where the sequence's earlier pieces end.
    Ids may be null or repeat: every row of docs is a document of its own, ties included.  An id
    column of a result's name is an error.  An empty table gives no
    rows.  Other columns are not read.  remembered bounds the pieces of text whose ids a worker
    keeps, and slice_bytes the text that is encoded at once; they change time and memory only.  A
    stretch of about so many tokens is packed at once, to its own end.
    """
    no_clash(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    if size < GRID or size & (size - 1):
        raise ValueError(f"size must be a power of two, {GRID} or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer, spaces, "<u4", remembered)
        sequence = TaskContext.get().partitionId() << 40
        held = _Stretch()

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            piece, names, sequence = held.pack(size, sequence)
            held = _Stretch()
            return pa.RecordBatch.from_arrays([names, *map(pa.array, piece.values())], names=["doc_id", *piece])

        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, slice_bytes):
                got = encoder.encode(texts.slice(a, b - a))
                first, last = np.searchsorted(got.ends, got.lo, side="right"), np.searchsorted(got.ends, got.hi)
                lo, hi = got.lo.tolist(), got.hi.tolist()
                ids = [np.append(got.ids[i:j], end) for i, j in zip(lo, hi, strict=True)]
                ends = [got.ends[p:q] - i for i, p, q in zip(lo, first.tolist(), last.tolist(), strict=True)]
                held.add(batch.column(0).slice(a, b - a), ids, ends)
                if held.total >= stretch:
                    yield flush()
        if held.total:
            yield flush()

    bounded_batches(docs.sparkSession, "16m" if slice_bytes > 8 << 20 else "8m")
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), schema).withColumnRenamed("doc_id", id_col)


def op5_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
