"""What changed between full snapshots.

The last snapshot is kept as one table bucketed by key, with a hash of the values compared beside them: key and hash are the index, columns of their own
in every file. The next snapshot, bucketed alike, probes the index without a shuffle of the old side; old values are read again only where they are asked for, joined to the changed keys. Then the new table takes
the place of the old, which is dropped. A small file says which table holds, so that the next delivery may come in another session.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.shared import forget, new_path
from tideline.store.files import Files

KEYS = ["label", "start"]
#: Keys of a snapshot for each bucket, about.
BUCKET = 50_000
ROW = "label string, start long, stop long, digest string, h1 long, h2 int"
CHANGE = "label string, start long, change_kind string, new_stop long, new_digest string"
FULL = "snapshot_no long, label string, start long, change_kind string, old_stop long, old_digest string, new_stop long, new_digest string"


def tidy_label(c: Column) -> Column:
    return F.lower(F.trim(c))


def tidy_digest(c: Column) -> Column:
    """The 40 hexadecimal digits in lower case; a text without them stays itself, trimmed, and blank is null."""
    low = F.lower(F.trim(c))
    digits = F.regexp_extract(low, "([0-9a-f]{40})", 1)
    return F.when(digits != "", digits).when(low != "", low)


class SnapshotIndex:
    """The bucketed last snapshot in a folder: ``current.json`` names its table, which any session may open."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 1):
        """``buckets`` counts for the first snapshot of a folder only: all later ones are bucketed alike."""
        self.spark, self.files = spark, Files(spark, folder)
        self.current = json.loads(self.files.read("current.json")) if self.files.exists("current.json") else None
        self.buckets = self.current["buckets"] if self.current else buckets

    @property
    def number(self) -> int | None:
        return self.current and self.current["number"]

    def _table(self, name: str, create: bool = False) -> DataFrame:
        """A bucketed table of the folder by its name; other sessions have to be told of its buckets."""
        known = f"tideline_{name}"
        if create or not self.spark.catalog.tableExists(known):
            self.spark.sql(f"create table {known} ({ROW}) using parquet clustered by ({', '.join(KEYS)}) into {self.buckets} buckets location '{self.files.uri(name)}'")
        return self.spark.table(known)

    def load(self, rows: DataFrame, number: int, values: bool = True) -> DataFrame:
        """Takes the next snapshot (label, start, stop, digest; keys are unique), writes its changes against the one held and returns them: label, start, change_kind, old_stop, old_digest, new_stop, new_digest.

        The first snapshot has no changes. Without ``values`` the old ones stay null and nothing but key and hash is read of the old table. The result stays valid after later loads.
        """
        name = f"snapshot_{uuid.uuid4().hex}"
        hashed = rows.select("label", "start", "stop", "digest", F.xxhash64(F.struct("stop", "digest")).alias("h1"), F.hash(F.struct("digest", "stop")).alias("h2"))
        hashed.repartition(self.buckets, *KEYS).write.format("parquet").option("compression", "zstd").option("path", self.files.uri(name)).bucketBy(self.buckets, *KEYS).saveAsTable(f"tideline_{name}")
        path = self.files.uri(f"changes/{number}")
        found = None
        if self.current:
            held = self._table(self.current["table"])
            old = held.select(*KEYS, F.struct("h1", "h2").alias("old"))
            new = self._table(name).select(*KEYS, "stop", "digest", F.struct("h1", "h2").alias("new"))
            # buckets are of bounded size: hashed, they need no sort
            probe = new.join(old.hint("shuffle_hash"), KEYS, "full_outer").where("not (old <=> new)")
            kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
            found = probe.select(*KEYS, kind.alias("change_kind"), F.col("stop").alias("new_stop"), F.col("digest").alias("new_digest"))
            if values:
                aside = self.files.uri(f"probed/{number}")
                found.write.mode("overwrite").option("compression", "zstd").parquet(aside)
                found = self.spark.read.schema(CHANGE).parquet(aside)
                was = held.select(*KEYS, F.col("stop").alias("old_stop"), F.col("digest").alias("old_digest"))
                changed = found.where("change_kind <> 'added'")
                fetched = was.join(changed.hint("shuffle_hash"), KEYS, "right").select(*changed.columns, "old_stop", "old_digest")
                found = fetched.unionByName(found.where("change_kind = 'added'"), allowMissingColumns=True)
            found.write.mode("overwrite").option("compression", "zstd").parquet(path)
            self.files.remove(f"probed/{number}")
        before, self.current = self.current, {"number": number, "table": name, "buckets": self.buckets}
        self.files.remove("next.json")
        self.files.create("next.json", json.dumps(self.current))
        self.files.remove("current.json")
        self.files.rename("next.json", "current.json")
        if before:
            self.drop(before["table"])
        empty = self.spark.createDataFrame([], f"{CHANGE}, old_stop long, old_digest string")
        columns = [*KEYS, "change_kind", "old_stop", "old_digest", "new_stop", "new_digest"]
        return (empty if found is None else self.spark.read.schema(empty.schema).parquet(path)).select(*columns)

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists tideline_{name}")
        self.files.remove(name)


def delivered(snapshots: DataFrame) -> DataFrame:
    """snapshot_no, label, start, stop, digest: the row that holds for each key of each snapshot.

    Labels and digests are brought to one spelling. Of rows for one key the latest ``delivered_at`` holds (null is the
    earliest); of equally late ones the largest (stop, digest), nulls smallest. Rows without number, label or start are left
    out. ``length`` and ``closed`` and any further columns play no part.
    """
    rows = snapshots.select(F.col("snapshot_no").cast("long").alias("snapshot_no"), tidy_label(F.col("label")).alias("label"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), tidy_digest(F.col("digest")).alias("digest"), "delivered_at")
    rows = rows.where("snapshot_no is not null and label is not null and start is not null")
    best = rows.groupBy("snapshot_no", "label", "start").agg(F.max(F.struct("delivered_at", "stop", "digest")).alias("b"))
    return best.select("snapshot_no", "label", "start", "b.stop", "b.digest")


def snapshot_changes(snapshots: DataFrame, buckets: int | None = None, values: bool = True) -> DataFrame:
    """snapshot_no, label, start, change_kind, old_stop, old_digest, new_stop, new_digest between each delivered snapshot and the delivered one before it; without ``values`` the last four are not looked for and null.

    A stop or digest that is null is a value of its own. The number of snapshots is that of deliveries (a handful), never of rows; each snapshot is read,
    hashed and bucketed once. An empty table gives no rows.
    """
    spark = snapshots.sparkSession
    path = new_path(spark, "deliveries")
    delivered(snapshots).write.option("compression", "zstd").partitionBy("snapshot_no").parquet(path)
    rows = spark.read.schema("label string, start long, stop long, digest string, snapshot_no long").parquet(path)
    sizes = {r[0]: 0 for r in snapshots.where("snapshot_no is not null").select(F.col("snapshot_no").cast("long")).distinct().collect()}  # one row per delivery
    sizes |= {r[0]: r[1] for r in rows.groupBy("snapshot_no").count().collect()}
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    folder = new_path(spark, "snapshots")
    index = SnapshotIndex(spark, folder, buckets or max(1, min(most, -(-max(sizes.values(), default=0) // BUCKET))))
    for number in sorted(sizes):
        index.load(rows.where(F.col("snapshot_no") == number).drop("snapshot_no"), number, values)
    if index.current:
        index.drop(index.current["table"])
    forget(spark, path)
    if len(sizes) < 2:
        return spark.createDataFrame([], FULL)
    one = spark.read.schema(f"{CHANGE}, old_stop long, old_digest string").parquet(*(f"{folder}/changes/{n}" for n in sorted(sizes)[1:]))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/changes/(-?[0-9]+)/", 1).cast("long")
    columns = [*KEYS, "change_kind", "old_stop", "old_digest", "new_stop", "new_digest"]
    return one.select(number.alias("snapshot_no"), *columns)
