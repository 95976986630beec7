"""Working folders that every executor can reach, and tables written to them.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir`` instead of block-manager storage, so that a
lost executor costs a re-read and never a result.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where it is unset (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context, so that executors need no installation of it.

    Called before every plan with a Python function. Workers import the package and keep what its modules cache from task to task.
    """
    context = spark.sparkContext
    if getattr(context, "_tideline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tideline-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tideline_shipped = True


#: Working folders of this process that are to go at its end.
_LEFT: list[tuple] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for working tables. It lives as long as the driver's process, unless forget() takes it away before: what a query returned may be read until then."""
    path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append(file_system(spark, path))
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = file_system(spark, path)
        fs.delete(where, True)


def _clear() -> None:
    for fs, where in _LEFT:
        with contextlib.suppress(Exception):  # the JVM may be gone first
            fs.delete(where, True)
    _LEFT.clear()


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the table read back, free of its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of a URI, so that any storage Spark reads can also be listed and renamed."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
