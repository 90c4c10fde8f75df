"""Exact line-level deduplication by overlapping windows of three consecutive lines.

Every window of consecutive non-blank lines (trimmed of spaces, tabs and carriage returns) is
hashed to 128 bits.  Over all documents, a window's first occurrence, by (document, place), stays;
the lines of every later occurrence, and blank lines between them, are removed.  Overlapping
occurrences merge, so a repeated passage of any number of lines from three up goes as a whole.  A
removed line always stays in at least one earlier place.  Documents of fewer non-blank lines than
a window keep all their lines.

Built-in functions only.  First occurrences are a partial aggregation, so a passage that a third
of all documents hold is one row a task in the shuffle.  The join that hands them back is a plain
equality join with an exchange on both sides, which Spark's rule for skewed joins splits where a
key is hot: by default a partition of over 256 MB that is five times the median, or some ten million
windows.  A passage of a third of 10^9 documents is split into dozens of tasks that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import allow_hash_joins, fresh_names

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, sum64, h1, h2, first, last): every window, with the numbers of its first and last line.

    sum64 is a hash of the text: it keeps rows apart that have one id and different texts.
    """
    bare = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    held = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("sum64"),
        F.filter(bare, lambda x: x.t != "").alias("held"),
    ).where(F.size("held") >= width)
    row = F.col("held")

    def window(x: Column, i: Column) -> Column:
        parts = [x.t, *(F.get(row, i + k).t for k in range(1, width))]
        return F.struct(
            F.xxhash64(*parts).alias("h1"),
            F.xxhash64(F.lit("second"), *parts).alias("h2"),
            x.i.alias("first"),
            F.get(row, i + (width - 1)).i.alias("last"),
        )

    found = F.filter(F.transform(row, window), lambda x: x["last"].isNotNull())
    return held.select("id", "sum64", F.explode(found).alias("w")).select("id", "sum64", "w.*")


def later_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, sum64, first, last): windows that occur at an earlier place too."""
    all_windows = windows(docs, id_col, text_col, width)
    place = F.struct("id", "sum64", "first")
    again = all_windows.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1")
    # with a third key neither side is dealt out as the join needs, so both get an exchange of its own
    third = F.xxhash64(F.col("h2")).alias("h3")
    return (
        all_windows.select("*", third)
        .join(again.select("h1", "h2", third, "place"), ["h1", "h2", "h3"])
        .where(~place.eqNullSafe(F.col("place")))
        .select("id", "sum64", "first", "last")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
    n_lines: str | None = None, n_removed: str | None = None,
) -> DataFrame:
    """The rows and columns of docs, the text without later occurrences of repeated windows.

    Optionally adds the number of lines and of lines removed.  A null text stays null, with no
    lines; an empty text has one blank line.  Ids may be null or repeat: places are ordered by
    (id, hash of the text, line), nulls first, and rows equal in id and text count as one place,
    so they all keep or lose the same lines.  An empty table gives no rows.
    """
    cut_id, cut_sum, cut_at = fresh_names(docs, "cut_id", "cut_sum", "cut_at")
    span = F.sequence("first", "last")
    gone = (
        later_occurrences(docs, id_col, text_col, width)
        .groupBy(F.col("id").alias(cut_id), F.col("sum64").alias(cut_sum))
        .agg(F.array_distinct(F.flatten(F.collect_set(span))).alias(cut_at))
    )
    allow_hash_joins(docs.sparkSession)  # one side holds line numbers only; saves sorting whole texts
    on = F.col(id_col).eqNullSafe(F.col(cut_id)) & (F.xxhash64(F.col(text_col)) == F.col(cut_sum))
    joined = docs.join(gone, on, "left")
    lines, cut = _lines(F.col(text_col)), F.col(cut_at)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    text = F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    extra = []
    if n_lines:
        extra.append(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias(n_lines))
    if n_removed:
        extra.append(F.when(cut.isNull(), 0).otherwise(F.size(cut)).alias(n_removed))
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *extra)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, n_lines="n_lines", n_removed="n_removed")


SQL = r"""
with line as (
  select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line
  from documents
), held as (
  select doc_id, i, trim(line, ' ' || chr(9) || chr(13)) as a from line where trim(line, ' ' || chr(9) || chr(13)) <> ''
), win as (
  select doc_id, i as f, lead(i, 2) over d as l, a, lead(a, 1) over d as b, lead(a, 2) over d as c
  from held window d as (partition by doc_id order by i)
), ranked as (
  select *, row_number() over (partition by a, b, c order by doc_id, f) as k from win where l is not null
), cut as (
  select distinct doc_id, unnest(range(f, l + 1)) as i from ranked where k > 1
)
select line.doc_id, coalesce(string_agg(line.line, chr(10) order by line.i) filter (where cut.i is null), '') as text,
  cast(count(*) as integer) as n_lines, cast(count(cut.i) as integer) as n_removed
from line left join cut on line.doc_id = cut.doc_id and line.i = cut.i
group by line.doc_id
"""
