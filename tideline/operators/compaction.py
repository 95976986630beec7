"""Far too many small files: merge them without losing or doubling a record.

The records of a label's small files go through an adaptive REBALANCE: one shuffle, after which the sizes measured
at run time decide which output partitions are merged and which (a hot label) are split. The result is staged, and
only becomes visible, with the manifest rows that take the place of the old ones, when its multiset checksum equals that of the files as they were read, before anything was joined or moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.shared import file_system, forget, new_path, written

SMALL = 64


def hashes(h) -> list:
    """Sum and exclusive or of a hash, which don't depend on the order of rows."""
    return [F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]


def held(records: DataFrame) -> DataFrame:
    """digest, timestamp, value: one row per record; of several versions the largest value, a null only where there is no other."""
    return records.where("digest is not null and timestamp is not null").groupBy("digest", "timestamp").agg(F.max("value").alias("value"))


def file_sizes(manifest: DataFrame, records: DataFrame, small: int = SMALL) -> DataFrame:
    """label, digest, n_records, n_files, is_small, hash_sum, hash_xor: one row per file that the manifest lists for a label.

    The manifest's own lengths are not trusted (they may be null or wrong): a record is a different timestamp under
    the file's digest, and a file without any counts 0. Rows without label or digest list no file. Repeated manifest
    rows and repeated records count once. ``is_small`` files have fewer than ``small`` records and are not their
    label's only file. The hashes are those of the file's records. An empty manifest gives no rows.
    """
    listed = manifest.select("label", "digest").where("label is not null and digest is not null").distinct()
    n = held(records).groupBy("digest").agg(F.count(F.lit(1)).alias("n_records"), *hashes(F.xxhash64("digest", "timestamp", "value")))
    files = listed.groupBy("label").agg(F.count(F.lit(1)).alias("n_files"))
    sized = listed.join(n, "digest", "left").join(files, "label").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return sized.select("label", "digest", "n_records", "n_files", ((F.col("n_records") < small) & (F.col("n_files") > 1)).alias("is_small"), "hash_sum", "hash_xor")


@dataclass
class Compaction:
    """``merged``: the files that were replaced (label, digest, n_records); ``table``: the records now in well-sized files; ``manifest``: label, start, stop, digest, length, closed, path, the rows that take their place, one for
    each label of each new file; ``report``: by label the files and records before and after."""

    merged: DataFrame
    table: DataFrame
    manifest: DataFrame
    report: DataFrame
    path: str


def compact(manifest: DataFrame, records: DataFrame, small: int = SMALL, target_bytes: int = 128 << 20) -> Compaction:
    """Merges each label's small files (see file_sizes) into files of about ``target_bytes``.

    Each record of a label's files comes out once per label: rows repeated under a digest are one record, a
    digest that two labels list is a record of both, files that no label lists are left out. A record whose value is
    null stays, with a null. If versions of one (digest, timestamp) differ, the largest value stays. Columns other than those
    named in the schemas are not carried along. Nothing is committed unless, for each label, number and hashes of the records written equal those of its files as first read. A new
    file's digest is made of its label's number and hashes of records in it.
    """
    spark = manifest.sparkSession
    merged = written(file_sizes(manifest, records, small).where("is_small").drop("is_small", "n_files"), "merge-plan")
    path = new_path(spark, "compacted")
    going_in = held(records.join(merged.select("digest").distinct(), "digest", "left_semi")).join(merged.select("label", "digest"), "digest").select("label", "digest", "timestamp", "value")
    # a session of its own, so that the target size is nobody else's
    aside, shape = f"{path}/_read", going_in.schema
    going_in.write.option("compression", "zstd").parquet(aside)
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    own.conf.set("spark.sql.adaptive.enabled", "true")
    # partition files by label only through sorting: folders per label would bring the small files back
    own.read.schema(shape).parquet(aside).hint("rebalance", "label").sortWithinPartitions("label", "timestamp").write.option("compression", "zstd").parquet(f"{path}/_staged")
    forget(spark, aside)
    staged = spark.read.schema(shape).parquet(f"{path}/_staged")
    h = F.xxhash64("digest", "timestamp", "value")
    by_file = written(staged.select("*", F.col("_metadata.file_name").alias("file"), h.alias("h")).groupBy("label", "file").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("stop"), F.count(F.lit(1)).alias("length"), *hashes(F.col("h"))), "merge-manifest")
    xor = F.bit_xor("hash_xor").alias("hash_xor")
    old = merged.where("n_records > 0").groupBy("label").agg(F.sum("n_records").cast("long").alias("n"), F.sum("hash_sum").alias("hash_sum"), xor)
    new = by_file.groupBy("label").agg(F.sum("length").alias("n"), F.sum("hash_sum").alias("hash_sum"), xor)
    differing = old.join(new.toDF("label", "new_n", "new_sum", "new_xor"), "label", "full_outer").where("not (n <=> new_n and hash_sum <=> new_sum and hash_xor <=> new_xor)")
    if not differing.isEmpty():
        raise RuntimeError(f"compaction of {path} was not committed: what was written differs from what was read")
    fs, source = file_system(spark, f"{path}/_staged")
    if not fs.rename(source, file_system(spark, f"{path}/data")[1]):
        raise RuntimeError(f"compaction of {path} was not committed: {path}/_staged could not be renamed")
    table = spark.read.schema(shape).parquet(f"{path}/data")
    digest = F.sha1(F.concat_ws("|", "label", "length", "hash_sum", "hash_xor"))
    rows = by_file.select("label", "start", "stop", digest.alias("digest"), "length", F.lit("b").alias("closed"), F.concat(F.lit(f"{path}/data/"), "file").alias("path"))
    after = by_file.groupBy("label").agg(F.count(F.lit(1)).alias("files_after"), F.sum("length").alias("n_records"))
    report = merged.groupBy("label").agg(F.count(F.lit(1)).alias("files_before")).join(after, "label", "left")
    return Compaction(merged, table, rows, report.select("label", "files_before", F.coalesce("files_after", F.lit(0)).alias("files_after"), F.coalesce("n_records", F.lit(0)).alias("n_records")), path)
