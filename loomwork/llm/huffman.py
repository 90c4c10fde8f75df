"""Canonical length-limited Huffman codes for token ids, vectorised over whole blocks.

A block is a bit string with a checkpoint, the bit offset, at every ``STEP``-th id.  Decoding looks
``LIMIT`` bits up in one table and runs all stretches between checkpoints side by side.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20
STEP = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with counts over zero (else 0).

    The package-merge algorithm: ``limit`` rounds that merge the sorted counts with the pairs of
    the round before, then count how often each id is in the 2n - 2 cheapest items.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in codes of {limit} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    rounds, items = [], leaves
    rounds.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        rounds.append(by < n)
        items = both[by]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(rounds):
        own = int(is_leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


class Codec:
    """Encoder and decoder for the canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        spans = np.int64(1) << (LIMIT - self.lengths[ids])
        first = np.cumsum(spans) - spans
        if len(ids) and int(first[-1] + spans[-1]) > 1 << LIMIT:
            raise ValueError("no prefix code has these lengths")
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[ids] = first >> (LIMIT - self.lengths[ids])
        self._ids, self._spans, self._table = ids, spans, None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of one block, most significant first, and its checkpoints."""
        size = self.lengths[ids]
        if len(size) and not size.all():
            raise ValueError("an id has no code")
        stop = np.cumsum(size)
        start = stop - size
        # a code of up to 20 bits lies in one or two words of 32; sums of disjoint bits below 2**53 are exact
        word, bit = start >> 5, start & 31
        shifted = self.codes[ids] << (64 - bit - size)
        n = (int(stop[-1]) + 31) // 32 + 1 if len(stop) else 0
        high = np.bincount(word, (shifted.view(np.uint64) >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (shifted & 0xFFFFFFFF).astype(np.float64), n + 1)[:n]
        return (high + low).astype(np.uint32).astype(">u4").tobytes(), start[::STEP].astype(np.int64)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            ids = np.zeros(1 << LIMIT, np.uint32)
            filled = np.repeat(self._ids, self._spans)
            ids[: len(filled)] = filled
            self._table = ids, self.lengths.astype(np.uint8)[ids]
        return self._table

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block."""
        if n == 0:
            return np.zeros(0, np.uint32)
        table, size = self._tables()
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), STEP), np.uint32)
        mask = np.uint32((1 << LIMIT) - 1)
        for k in range(min(n, STEP)):
            if k and n - (len(at) - 1) * STEP <= k:
                at = at[: len(at) - (len(at) == len(out))]  # the last stretch has ended
            key = (windows[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & mask
            out[: len(at), k] = table[key]
            at = at + size[key]
        return out.reshape(-1)[:n]
