"""Artifacts against the hashes of what is deployed: which loads go on, warn or halt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(has_manifest: Column, bundle_equal: Column, hash_known: Column, enforced: Column, acknowledged: Column, registered: Column) -> Column:
    """proceed, event, warn or halt.

    Without enforcement a mismatch is an event only, and a missing manifest nothing.  With it a
    registered artifact without a manifest halts, a bundle mismatch halts unless acknowledged, and
    a pipeline hash that the manifest hasn't seen warns.
    """
    matches = bundle_equal & hash_known
    return (
        F.when(~has_manifest, F.when(enforced & registered, "halt").otherwise("proceed"))
        .when(matches, "proceed")
        .when(~enforced, "event")
        .when(~bundle_equal, F.when(acknowledged, "event").otherwise("halt"))
        .otherwise("warn")
    )


def ladder(artifacts: DataFrame, manifests: DataFrame, current: DataFrame, acknowledged: DataFrame, enforced: bool) -> DataFrame:
    """One row an artifact and trainable: artifact, trainable, outcome.

    artifacts (artifact, trainable); manifests (artifact, trainable, bundle_hash, pipeline_hashes);
    current (trainable, bundle_hash, pipeline_hash); acknowledged (artifact, trainable).
    """
    now = current.select("trainable", F.col("bundle_hash").alias("now_bundle"), F.col("pipeline_hash").alias("now_pipeline"))
    taken = acknowledged.select("artifact", "trainable").distinct().withColumn("ack", F.lit(True))
    rows = artifacts.join(now, "trainable").join(manifests, ["artifact", "trainable"], "left").join(taken, ["artifact", "trainable"], "left")
    said = outcome(
        F.col("bundle_hash").isNotNull(),
        F.col("bundle_hash") == F.col("now_bundle"),
        F.coalesce(F.array_contains("pipeline_hashes", F.col("now_pipeline")), F.lit(False)),
        F.lit(enforced),
        F.coalesce("ack", F.lit(False)),
        F.lit(True),
    )
    return rows.select("artifact", "trainable", said.alias("outcome"))


def events(artifacts: DataFrame, manifests: DataFrame, current: DataFrame) -> DataFrame:
    """(event_type, artifact, trainable_name, old_hash, new_hash, pipeline_hash): what drift tells, before any verdict.

    A row for each artifact and trainable whose bundle is another than when it was trained, and one for
    each whose side file hasn't seen the pipeline's hash: the newest that it has seen counts as the old
    one.  Artifacts without a side file tell nothing.
    """
    now = current.select("trainable", F.col("bundle_hash").alias("now_bundle"), F.col("pipeline_hash").alias("now_pipeline"))
    known = artifacts.select("artifact", "trainable").join(manifests, ["artifact", "trainable"]).join(now, "trainable")
    none = F.lit(None).cast("string")
    bundle = F.when(
        ~F.col("bundle_hash").eqNullSafe(F.col("now_bundle")),
        F.struct(F.lit("training_bundle_hash_changed").alias("event_type"), F.col("trainable").alias("trainable_name"), F.col("bundle_hash").alias("old_hash"), F.col("now_bundle").alias("new_hash"), F.col("now_pipeline").alias("pipeline_hash")),
    )
    pipeline = F.when(
        ~F.coalesce(F.array_contains("pipeline_hashes", F.col("now_pipeline")), F.lit(False)),
        F.struct(F.lit("pipeline_hash_changed").alias("event_type"), none.alias("trainable_name"), F.try_element_at("pipeline_hashes", F.lit(-1)).alias("old_hash"), F.col("now_pipeline").alias("new_hash"), none.alias("pipeline_hash")),
    )
    told = known.select("artifact", F.explode(F.array(bundle, pipeline)).alias("e")).where("e is not null")
    return told.select("e.event_type", "artifact", "e.trainable_name", "e.old_hash", "e.new_hash", "e.pipeline_hash")
