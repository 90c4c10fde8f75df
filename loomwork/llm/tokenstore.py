"""Token ids of documents in a Huffman-coded file format, in ascending order of the document.

The format, a folder with two tables that Spark writes (any Hadoop file system, atomic commits):

* ``codebook``: one row (lengths, end_id): the code length of every id, as bytes.
* ``blocks``: one row a block: part, block (its place in the part), before (ids of the part in
  earlier blocks), n_ids, docs (ids of documents), sizes (their numbers of ids), checkpoints (bit
  offsets of every 256th id) and bits.  Parts follow each other, blocks too; within, documents ascend.

Blocks hold whole documents, about half a million ids, so a reader can decode any block alone.  Counts
of ids are over all documents; at most one row an id goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, drop_stored, partition_count, shared_path, stored
from loomwork.llm.huffman import Codec, code_lengths
from loomwork.llm.tokens import slices, token_ids, trimmed

BLOCK_IDS = 1 << 19
#: Pieces of text that a worker remembers while it tokenizes; later stages in the worker forget them.
REMEMBERED = 1_000_000


def tokenize(
    docs: DataFrame, tokenizer: str, spaces: str = "dropped", end_id: int | None = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids, counts): little-endian unsigned 16-bit ids of the whole text, then the end id.

    counts is null but in one row of each of the stretches that are encoded together, where it
    tells how often each id is in the stretch, so that a count of all ids need not read them again.
    Null texts count as empty.  Ids over 65,535 are an error.
    """
    bounded_batches(docs.sparkSession, "16m")
    tail = b"" if end_id is None else np.uint16(end_id).astype("<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer, spaces, "<u4", REMEMBERED)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, 8 << 20):
                got = encoder.encode(texts.slice(a, b - a))
                if len(got.ids) and got.ids.max() > 0xFFFF:
                    raise ValueError("an id doesn't fit in 16 bits")
                ids = got.ids.astype("<u2")
                rows = [ids[i:j].tobytes() + tail for i, j in zip(got.lo.tolist(), got.hi.tolist(), strict=True)]
                counts = np.bincount(ids, minlength=1 << 16)
                if end_id is not None:
                    counts[end_id] += len(rows)
                used = np.flatnonzero(counts)
                sparse = used.astype("<u2").tobytes() + counts[used].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(rows, pa.binary()), pa.array([sparse, *[None] * (b - a - 1)], pa.binary())],
                    names=["doc_id", "ids", "counts"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(trimmed(run), "doc_id long, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, over all rows of ``tokenize``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_ids.cache_clear()
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for sparse in batch.column(0).drop_null().to_pylist():
                n = len(sparse) // 6
                counts[np.frombuffer(sparse, "<u2", n)] += np.frombuffer(sparse, "<u4", n, 2 * n)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["id", "n"])

    rows = tokens.select("counts").where("counts is not null").mapInArrow(trimmed(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_token_file(tokens: DataFrame, path: str, end_id: int | None = 2) -> None:
    """Writes the rows of ``tokenize`` as a token file; equal doc_ids follow each other."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens))
    spark.createDataFrame([(bytearray(lengths.tobytes()), end_id)], "lengths binary, end_id int").coalesce(1).write.parquet(f"{path}/codebook")
    packed = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_ids.cache_clear()
        codec = Codec(np.frombuffer(packed, np.uint8))
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, size
            ids = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
            bits, checkpoints = codec.encode(ids)
            row = {
                "part": part, "block": block, "before": before, "n_ids": len(ids), "docs": list(docs),
                "sizes": [len(x) // 2 for x in held], "checkpoints": checkpoints, "bits": bits,
            }
            block, before, size = block + 1, before + len(ids), 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(ids)
                size += len(ids) // 2
                if size >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    n = partition_count(spark)
    # with a row's place as a second key, rows of one id, or of none, are dealt out over tasks too
    placed = tokens.select("doc_id", "ids", F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    blocks = ordered.select("doc_id", "ids").mapInArrow(trimmed(run), _BLOCKS_SQL)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


_BLOCKS_SQL = "part int, block int, before long, n_ids long, docs array<long>, sizes array<long>, checkpoints array<long>, bits binary"
_BLOCKS = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary()),
])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian unsigned 32-bit integers; start counts all ids before.

    An empty file gives no rows.
    """
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks")
    packed = bytes(spark.read.schema("lengths binary, end_id int").parquet(f"{path}/codebook").first().lengths)
    # a row a part of the file: as many as its writer had tasks
    base, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r.part] = total
        total += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_ids.cache_clear()
        codec = Codec(np.frombuffer(packed, np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, n, docs, sizes, checkpoints, bits = (c[k] for c in batch.columns)
                ids = codec.decode(bits.as_py(), checkpoints.values.to_numpy(), n.as_py()).astype("<u4")
                stop = np.cumsum(sizes.values.to_numpy())
                start = stop - sizes.values.to_numpy()
                # offsets of the documents into the block's ids make the rows, without a copy of each
                offsets = pa.py_buffer(np.r_[0, stop * 4].astype(np.int64).tobytes())
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop), [None, offsets, pa.py_buffer(ids.tobytes())])
                starts = pa.array(start + (base[part.as_py()] + before.as_py()))
                yield pa.RecordBatch.from_arrays([docs.values, starts, pc.cast(rows, pa.binary())], names=["doc_id", "start", "ids"])

    needed = blocks.select("part", "before", "n_ids", "docs", "sizes", "checkpoints", "bits")
    return needed.mapInArrow(trimmed(run), "doc_id long, start long, ids binary")


def store_and_read(
    docs: DataFrame, tokenizer: str, spaces: str = "dropped", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokenizes docs, writes a token file in the shared folder and reads it back.

    Null texts count as empty: such documents have the end id only.  Null ids come first, repeated
    ids stand together.  Columns other than the two named are not read.
    """
    path = shared_path(docs.sparkSession, "tokenfile")
    tokens = stored(tokenize(docs, tokenizer, spaces, end_id, id_col, text_col), "tokens")
    write_token_file(tokens, path, end_id)
    drop_stored(tokens)
    return read_token_file(docs.sparkSession, path)


def op8_token_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = store_and_read(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
