"""Event and fixture tables, artifacts' manifests, and references to blobs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.canonical import canonical_json
from loomwork.operators.eventlog import EVENT_COLUMNS, KINDS, event_schema, harvest, with_hash
from loomwork.plans.artifacts import manifest as manifest
from loomwork.plans.compile import Plan
from loomwork.plans.identity import derived


def seeds(spark: SparkSession, rows: list[Mapping[str, Any]], plan: Plan, run_col: str = "run_id") -> DataFrame:
    """Runs from Python values: the declared inputs and the run; extra keys are left out."""
    from pyspark.sql import types as T

    for r in rows:
        lacking = [w for w in (run_col, *plan.inputs) if w not in r]
        if lacking:
            raise ValueError(f"no value for {', '.join(lacking)}")
    fields = [T.StructField(run_col, T.StringType()), *(T.StructField(w, f.type.to_spark()) for w, f in plan.inputs.items())]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], T.StructType(fields))


def append_events(events: DataFrame, path: str) -> None:
    """Appends to an event table, by kind; a kind that the log doesn't have is an error."""
    known = F.col("event_type").isin(*KINDS)
    checked = events.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(F.raise_error(F.lit("unknown kind of event"))))
    checked.write.mode("append").partitionBy("event_type").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(event_schema()).parquet(path)


def write_fixtures(events: DataFrame, path: str) -> None:
    """A JSON row a step: the run's hash, what the step read, wrote, and said to its service."""
    hashes = with_hash(events).select("pipeline_run_id", "run_hash").distinct()
    harvest(events).join(hashes, "pipeline_run_id").write.mode("overwrite").json(path)


def read_fixtures(spark: SparkSession, path: str, pipeline_hash: str) -> DataFrame:
    """The fixtures that runs of just this plan left."""
    columns = "pipeline_run_id string, handler_position int, handler_name string, node_kind string, reads_snapshot string, writes_snapshot string, input_payload string, output_payload string, run_hash string"
    return spark.read.schema(columns).json(path).where(F.col("run_hash") == pipeline_hash)


def write_derived(plan: Plan, path: str | Path) -> None:
    """The plan's derived bundle as canonical JSON; the same plan gives the same bytes."""
    Path(path).write_text(canonical_json(derived(plan)) + "\n", encoding="utf-8")


def event_rows(spark: SparkSession, rows: list[Mapping[str, Any]]) -> DataFrame:
    """Events that the driver made, such as those of drift, as rows of the log."""
    lacking = [r["event_type"] for r in rows if r["event_type"] not in KINDS]
    if lacking:
        raise ValueError(f"unknown kind of event: {lacking[0]}")
    return spark.createDataFrame([tuple(r.get(c) for c in EVENT_COLUMNS) for r in rows], event_schema())


def manifests(spark: SparkSession, found: list[dict[str, Any]]) -> DataFrame:
    rows = [(m["artifact"], t, h, m["pipelines"]) for m in found for t, h in m["bundles"].items()]
    return spark.createDataFrame(rows, "artifact string, trainable string, bundle_hash string, pipeline_hashes array<string>")


def blob_line(reference: str, form: str = "json") -> str:
    """A line that records a reference to a blob: JSON or key=value."""
    if form == "json":
        return json.dumps({"reference": reference}, ensure_ascii=False)
    if form == "kv":
        return f"reference={reference}"
    raise ValueError(f"no form {form!r}")


def write_blob_lines(rows: DataFrame, path: str, column: str = "reference", form: str = "json") -> None:
    """One line a row, as text files."""
    line = F.to_json(F.struct(F.col(column).alias("reference"))) if form == "json" else F.concat(F.lit("reference="), F.col(column))
    rows.select(line.alias("value")).write.mode("append").text(path)
