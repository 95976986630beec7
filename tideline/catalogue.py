"""Queries over the project's tables for the operators on large data sets, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import compaction, grid, rejects, snapshots, spikes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark, d):
    done = compaction.compact(table(spark, d, "commit_row"), table(spark, d, "stored_row"))
    return done.merged.select("label", "digest")


def p1_compacted(spark, d):
    return compaction.compact(table(spark, d, "commit_row"), table(spark, d, "stored_row")).report.drop("files_after")


def p1_manifest(spark, d):
    """What the new manifest rows cover of each label."""
    rows = compaction.compact(table(spark, d, "commit_row"), table(spark, d, "stored_row")).manifest
    return rows.groupBy("label").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"))


def p1_records(spark, d):
    """The records that are in the new files, under the digests of the old ones."""
    return compaction.compact(table(spark, d, "commit_row"), table(spark, d, "stored_row")).table


def p2_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "commit_snapshot"), values=False).select("snapshot_no", "label", "start", "change_kind")


def p2_changes(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "commit_snapshot"))


def p3_grid(spark, d):
    return grid.regular_grid(table(spark, d, "series_reading"), table(spark, d, "collection_info"))


def p3_found(spark, d):
    return p3_grid(spark, d).where("missing").select("label", "period_start")


def p3_observed(spark, d):
    """The grid without what the smoother adds."""
    return p3_grid(spark, d).select("label", "period_start", F.round("observed", 6).alias("observed"), "n_readings", "missing")


def p4_found(spark, d):
    return rejects.rejected(table(spark, d, "csv_input")).select("file_no", "line_no", "reason")


def p4_loaded(spark, d):
    return rejects.loaded(table(spark, d, "csv_input"))


def p5_found(spark, d):
    return spikes.faulty_readings(table(spark, d, "series_reading"), table(spark, d, "collection_info")).select("label", "epoch_s", "kind")


def p5_limits_and_runs(spark, d):
    """The faults that need no level."""
    return p5_found(spark, d).where("kind <> 'spike'")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_compacted, p1_manifest, p1_records, p2_found, p2_changes, p3_found, p3_grid, p3_observed, p4_found, p4_loaded, p5_found, p5_limits_and_runs)}
