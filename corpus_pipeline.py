"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it kept, with their columns;
the last returns the pieces of the packed sequences.  All stages take null and empty texts, null and
repeated ids, repeated rows and empty tables; columns other than ``doc_id``, ``text``, ``lang`` and
``n_chars`` go through untouched, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, jaccard, langid, linededup, packing
from loomwork.llm.common import drop_stored, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table labels.

    Null texts, texts without a letter and texts too far from every language go; so does all of a
    table without a labelled text.  Repeated rows are judged alike.
    """
    return langid.keep_accepted(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later occurrences of repeated passages; n_chars follows the text.

    A null text stays null, with null n_chars; all documents stay, some of them with an empty text.
    The first occurrence is by doc_id, nulls first, then by the text's hash and the line; rows equal
    in both keep or lose the same lines.
    """
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 and more.

    The least doc_id stays, null ids last, ties by the text's hash.  Null texts and those without a
    word are one group.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, null and empty items are held by none; an empty benchmark keeps
    all.  Repeated rows are judged alike.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold all documents; null and empty texts have one token, the end id."""
    # workers live on from stage to stage, so they hold less than where packing is all they do
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=100_000, slice_bytes=2 << 20, stretch=1 << 20)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the stored rows of the one before, which are removed once the next has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
