"""Token ids of whole texts by a tokenizers file, with the ids of repeated pieces remembered.

Encoding a whole text costs the library far more than the text's different words do, as most words
repeat.  ``TokenIds`` cuts texts only where the tokenizer cannot see across, gives each different
piece to the library once, and joins the results, which are the ids of the whole texts:

* ``spaces="dropped"``: for tokenizers that lower-case, drop white space, take a run of letters and
  a run of punctuation apart and look at nothing beyond.  Cuts are at every space and line feed,
  and between a letter and a last full stop or comma.  A-Z is lower-cased at once where the text
  has no combining mark, with which it might compose otherwise, and no special token's string.
* ``spaces="leading"``: for byte-level tokenizers whose words take one space in front.  Cuts are
  before a space that stands between two characters that aren't white space, around a line feed
  between such, and between a letter and a last full stop or comma.  Texts with other runs of
  white space are cut at the first of these only.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, to any of the libraries in use.
_SPACE = r"\t\n\v\f\r \x1c-\x1f\x{85}\p{Z}"
_IRREGULAR = rf" [{_SPACE}]|[{_SPACE}] |\A[{_SPACE}]|[{_SPACE}]\z|\x00"
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LAST_MARK = r"(\pL)([.,])([ \n]|\z)"
_LINE_FEED = rf"([^{_SPACE}])\n([^{_SPACE}])"
#: A piece that ends a sentence or holds a line break.
_SENTENCE_END = r"[.!?…。！？]['\")\]»”’]*\z|\n"


@dataclass
class Encoded:
    """ids of all texts; text k has ids[lo[k]:hi[k]]; ends: places after sentence ends, ascending."""

    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    ends: np.ndarray


def _trim(piece: str) -> bool:
    """Whether the piece has no white space around, but for one space in front."""
    core = piece[1:] if piece[:1] == " " else piece
    return core != "" and core.strip() == core


class _Pieces(dict):
    """piece -> its ids as bytes.  Beyond ``most`` pieces, only those just used stay; that costs time only."""

    def __init__(self, tokenizer, mark: str, dtype: str, most: int):
        super().__init__()
        self.tokenizer, self.mark, self.dtype, self.most = tokenizer, mark, dtype, most
        self.mark_id = self._encode(mark)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; new ones are encoded many at once with a mark between.

        The mark is a token of its own there and occurs in none of these pieces.
        """
        got = list(map(self.get, pieces))
        new = [p for p, x in zip(pieces, got, strict=True) if x is None]
        if not new:
            return got
        found: dict[str, bytes] = {}
        bare, between = self.mark.strip(" "), self.mark
        plain = [p for p in new if len(p) <= 64 and bare not in p and "<|" not in p and _trim(p)]
        width = np.dtype(self.dtype).itemsize
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = np.array(self._encode(between + between.join(part)), self.dtype)
            ends = np.flatnonzero(ids == self.mark_id[0])
            if len(ends) == len(part) and len(self.mark_id) == 1:
                data = ids.tobytes()
                stops = [*(ends[1:] * width).tolist(), len(data)]
                found.update(zip(part, [data[a:b] for a, b in zip(((ends + 1) * width).tolist(), stops, strict=True)], strict=True))
        for p in new:
            if p not in found:
                found[p] = np.array(self._encode(p), self.dtype).tobytes()
        got = [found[p] if x is None else x for p, x in zip(pieces, got, strict=True)]
        if len(self) + len(found) > self.most:
            self.clear()
            found = dict(zip(pieces[: self.most], got[: self.most], strict=True))
        self.update((p, x) for p, x in found.items() if len(p) <= 64)
        return got


class TokenIds:
    """Encodes texts to little-endian ids of ``dtype``; ``most`` bounds the remembered pieces."""

    def __init__(self, path: str, spaces: str, dtype: str = "<u4", most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if spaces not in ("dropped", "leading"):
            raise ValueError("spaces is 'dropped' or 'leading'")
        tokenizer = Tokenizer.from_file(path)
        self.leading, self.dtype = spaces == "leading", dtype
        self.known = _Pieces(tokenizer, "\t" if self.leading else " | ", dtype, most)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The order in which texts are taken, all their pieces, and the pieces of each."""
        if self.leading:
            odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            even = texts.filter(pa.array(~odd))
            even = pc.replace_substring_regex(even, _LAST_MARK, "\\1\x00\\2\\3")
            even = pc.replace_substring_regex(even, _LINE_FEED, "\\1\x00\n\x00\\2")
            lists = pc.split_pattern(pc.replace_substring(even, " ", "\x00 "), "\x00")
            rest = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        else:
            odd = pc.match_substring_regex(texts, r"\pM|<\|").to_numpy(zero_copy_only=False)
            even = pc.replace_substring(pc.ascii_lower(texts.filter(pa.array(~odd))), "\n", " ")
            lists = pc.split_pattern(pc.replace_substring_regex(even, _LAST_MARK, r"\1 \2\3"), " ")
            rest = [t.split(" ") for t in texts.filter(pa.array(odd)).to_pylist()]
        flat = pa.concat_arrays([lists.flatten(), pa.array([p for x in rest for p in x], pa.string())])
        sizes = np.r_[pc.list_value_length(lists).to_numpy(zero_copy_only=False), [len(x) for x in rest]].astype(np.int64)
        return np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)], flat, sizes

    def encode(self, texts: pa.Array) -> Encoded:
        """texts: strings, null for empty; bounded by the caller, see ``slices``.

        Sentence ends are told from the pieces; line breaks don't count where spaces are dropped.
        """
        texts = pc.fill_null(texts, "")
        n = len(texts)
        order, flat, sizes = self._cut(texts)
        at = np.r_[0, np.cumsum(sizes)]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        values = self.known.of(coded.dictionary.to_pylist())
        is_end = pc.match_substring_regex(coded.dictionary, _SENTENCE_END).to_numpy(zero_copy_only=False)
        table = np.frombuffer(b"".join(values), self.dtype)
        stops = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(self.dtype).itemsize)
        lengths = np.diff(stops, prepend=0).astype(np.int32)
        size = lengths[codes]
        stop = np.cumsum(size, dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
        source = np.repeat(((stops - lengths)[codes] - (stop - size)).astype(kind), size)
        source += np.arange(total, dtype=kind)
        bound = np.r_[0, stop][at]
        lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
        lo[order], hi[order] = bound[:-1], bound[1:]
        return Encoded(table[source], lo, hi, stop[is_end[codes]] if len(codes) else np.array([], np.int64))


@lru_cache(maxsize=4)
def token_ids(path: str, spaces: str, dtype: str = "<u4", most: int = 1_000_000) -> TokenIds:
    """One encoder a Python worker; what it remembers lasts over tasks until ``token_ids.cache_clear``."""
    return TokenIds(path, spaces, dtype, most)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, which then gives memory back to the system: Python workers wait between tasks and stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def slices(texts: pa.Array, most_bytes: int = 12 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of texts that together have about so many bytes, at least one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most_bytes, side="right")))
        yield at, to
        at = to
