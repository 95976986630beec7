"""Collections to and from folders of CSV or Parquet files: ``<collection>/_schema.json`` and a file or folder per series."""

from __future__ import annotations

import csv
import io
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.store.files import Files
from tideline.store.repo import Collection, Repo
from tideline.store.schema import Schema


def export_collections(repo: Repo, folder: str, labels: list[str] | None = None, kind: str = "csv") -> None:
    """Writes each collection in one job, the series as ``label=<label>`` folders, in place of an earlier export of it."""
    out = Files(repo.spark, folder)
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown file type {kind!r}")
    for label in labels or repo.ls():
        c = repo.collection(label)
        if c is None:
            raise ValueError(f"no collection {label!r}")
        where = quote(label, safe="")
        out.remove(where)  # an export replaces an earlier one
        df = c.df().hint("rebalance", "label").sortWithinPartitions("label", *c.schema.idx)
        writer = df.write.partitionBy("label")
        if kind == "csv":
            writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(out.uri(where))
        else:
            writer.option("compression", "zstd").parquet(out.uri(where))
        out.create(f"{where}/_schema.json", c.schema.dumps())


def import_collections(repo: Repo, folder: str, labels: list[str] | None = None) -> list[Collection]:
    """Reads folders as export_collections() writes them, and flat ones with ``<label>.csv`` or ``<label>.parquet`` files. Missing collections are created; one
    revision for each. Names that start with ``_`` are skipped. ValueError if a file's columns differ from the schema's."""
    source = Files(repo.spark, folder)
    made = []
    for name in source.ls():
        label = unquote(name)
        if name.startswith(("_", ".")) or (labels and label not in labels):
            continue
        schema = Schema.loads(source.read(f"{name}/_schema.json"))
        c = repo.collection(label) or repo.create_collection(schema, label)
        if c.schema != schema:
            raise ValueError(f"schemas of {label!r} differ")
        entries = [e for e in source.ls(name) if not e.startswith(("_", "."))]
        folders = [e for e in entries if e.startswith("label=")]
        parts = [read_export(source, name, folders, schema)] if folders else []
        parts += [read_series(source, name, e, schema) for e in entries if e not in folders]
        if parts:
            c.write(reduce(DataFrame.unionByName, parts))
        made.append(c)
    return made


def read_export(source: Files, folder: str, entries: list[str], schema: Schema) -> DataFrame:
    """All series of an export in one scan, their labels from the names of their folders."""
    first = next(f for f in source.ls(f"{folder}/{entries[0]}") if not f.startswith(("_", ".")))
    reader = source.spark.read.option("basePath", source.uri(folder)).option("header", True)
    paths = [source.uri(f"{folder}/{e}") for e in entries]
    head = source.spark.read.option("header", True)
    head = head.parquet(paths[0]) if first.endswith(".parquet") else head.csv(paths[0])
    if set(head.columns) != set(schema):
        raise ValueError(f"columns of {folder} are {head.columns}, not {list(schema)}")
    label = T.StructField("label", T.StringType())
    if first.endswith(".parquet"):
        df = reader.schema(T.StructType([*head.schema, label])).parquet(*paths)
    else:
        df = reader.schema(T.StructType([*(T.StructField(n, T.StringType()) for n in head.columns), label])).csv(paths)
    return typed(schema, df)


def typed(schema: Schema, df: DataFrame) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema}
    return df.select(F.col("label").cast("string"), *(c.cast(F.col(f"`{n}`"), have[n]).alias(n) for n, c in schema.columns.items()))


def read_series(source: Files, folder: str, entry: str, schema: Schema) -> DataFrame:
    """A series' file with its label."""
    path, label = f"{folder}/{entry}", unquote(entry.rsplit(".", 1)[0])
    spark = source.spark
    if entry.endswith(".parquet"):
        df = spark.read.parquet(source.uri(path))
    else:
        head = spark.read.option("header", True).csv(source.uri(path))
        df = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in head.columns])).csv(source.uri(path))
    if set(df.columns) != set(schema):
        raise ValueError(f"columns of {path} are {df.columns}, not {list(schema)}")
    return schema.cast(df).select(F.lit(label).alias("label"), *schema)


def write_csv_text(repo: Repo, collection: str, label: str, text: str) -> None:
    """A series from CSV text whose first line is the header, as a command line pipes it in. Quoted fields may hold line ends; the text is on the driver as it comes in."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r and any(x.strip() for x in r)]
    c, names = repo.collection(collection), [n.strip() for n in rows[0]]
    struct = T.StructType([T.StructField(n, T.StringType()) for n in names])
    wrong = next((r for r in rows[1:] if len(r) != len(names)), None)
    if wrong is not None:
        raise ValueError(f"{wrong} has not {len(names)} fields")
    df = repo.spark.createDataFrame([tuple(x.strip() if x.strip() else None for x in r) for r in rows[1:]], struct)
    (c / label).write(c.schema.cast(df))
