"""Declared schemas: the column language ``"timestamp*"``, casts, zero values and plain Python values.

A starred column belongs to the index, in the order of declaration. What a codec clause names is kept as metadata; Parquet
compresses with zstd whatever it says.
"""

from __future__ import annotations

import datetime as dt
import json
import shlex
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.times import since_1970, truncated

#: Named types and, besides them, the array-style codes that stand for the same; unsigned ones take the next wider signed type.
TYPES: dict[str, T.DataType] = {
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
    "float": T.DoubleType(),
    "int": T.LongType(),
    "str": T.StringType(),
    "O": T.StringType(),
    "b1": T.BooleanType(),
    "f4": T.FloatType(),
    "f8": T.DoubleType(),
    **{f"i{n}": t for n, t in ((1, T.ByteType()), (2, T.ShortType()), (4, T.IntegerType()), (8, T.LongType()))},
    **{f"u{n}": t for n, t in ((1, T.ShortType()), (2, T.IntegerType()), (4, T.LongType()), (8, T.DecimalType(20, 0)))},
    **{f"M8[{u}]": T.TimestampNTZType() for u in ("s", "ms", "us", "ns")},
    "M8[D]": T.DateType(),
}
EPOCH = dt.datetime(1970, 1, 1)


def spark_type(name: str) -> T.DataType:
    name = name.lstrip("<>|=")
    if name in TYPES:
        return TYPES[name]
    if name[:1] == "U" and (name[1:].isdigit() or not name[1:]):
        return T.StringType()
    raise ValueError(f"unknown type {name!r}")


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return "timestamp"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    for name, t in TYPES.items():
        if t == kind:
            return name
    if isinstance(kind, T.DecimalType):
        return "float"
    return "O"


@dataclass(frozen=True)
class SchemaColumn:
    name: str
    type_name: str
    idx: bool = False
    codecs: tuple[str, ...] = ()

    @classmethod
    def parse(cls, name: str, text: str) -> SchemaColumn:
        """``<type>[*] [| codec ...]``."""
        words = shlex.split(text.replace("|", " | "))
        if not words or words[0] == "|":
            raise ValueError(f"column {name!r} has no type")
        kind, idx = (words[0][:-1], True) if words[0].endswith("*") else (words[0], False)
        rest = words[1:]
        if rest[:1] == ["*"]:
            idx, rest = True, rest[1:]
        spark_type(kind)
        return cls(name, kind, idx, tuple(w for w in rest if w != "|"))

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.type_name)

    @property
    def whole_seconds(self) -> bool:
        return self.type_name in ("timestamp", "M8[s]")

    def cast(self, c: Column, kind: T.DataType | None = None) -> Column:
        """Casts as the store does: numbers are seconds since 1970 for a timestamp and days for a date; timestamps lose what is finer than a second."""
        numeric = isinstance(kind, T.NumericType)
        if isinstance(self.spark, T.TimestampNTZType):
            if numeric:
                base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
                return base + F.make_dt_interval(secs=c.cast("decimal(18,6)"))
            c = c.cast("timestamp_ntz")
            return truncated(c, "s") if self.whole_seconds else c
        if isinstance(self.spark, T.DateType) and numeric:
            return F.date_from_unix_date(c.cast("int"))
        if isinstance(self.spark, T.StringType) and isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(c)
        return c.cast(self.spark)

    @property
    def zero(self) -> Column:
        """The value of a cell that nobody supplied: empty for text, else 0 (1970 for times)."""
        if isinstance(self.spark, T.StringType):
            return F.lit("")
        if isinstance(self.spark, T.TimestampNTZType):
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        if isinstance(self.spark, T.DateType):
            return F.lit("1970-01-01").cast("date")
        return F.lit(0).cast(self.spark)

    def value(self, x: Any) -> Any:
        """A bound as given by a user (text, number, date, ...) as the column's Python value."""
        if x is None or isinstance(x, Edge):
            return x
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(self.spark, T.TimestampNTZType):
            if isinstance(x, (int, float)):
                x = EPOCH + dt.timedelta(seconds=x)
            elif isinstance(x, str):
                x = dt.datetime.fromisoformat(x)
            elif isinstance(x, dt.date) and not isinstance(x, dt.datetime):
                x = dt.datetime(x.year, x.month, x.day)
            if x.tzinfo is not None:
                x = x.astimezone(dt.timezone.utc).replace(tzinfo=None)
            return x.replace(microsecond=0) if self.whole_seconds else x
        if isinstance(self.spark, T.DateType):
            if isinstance(x, int):
                return EPOCH.date() + dt.timedelta(days=x)
            if isinstance(x, str):
                return dt.date.fromisoformat(x[:10])
            return x.date() if isinstance(x, dt.datetime) else x
        if isinstance(self.spark, T.StringType):
            return str(x)
        if isinstance(self.spark, T.BooleanType):
            return bool(x)
        if isinstance(self.spark, T.FractionalType) and not isinstance(self.spark, T.DecimalType):
            return float(x)
        return int(x)

    def to_json(self, x: Any) -> Any:
        if isinstance(x, Edge):
            return {"edge": x.side}
        return x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else x

    def from_json(self, x: Any) -> Any:
        return (LOWEST if x["edge"] < 0 else HIGHEST) if isinstance(x, dict) else self.value(x)

    def literal(self, x: Any) -> Column:
        if isinstance(x, dt.datetime):
            return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(x).cast(self.spark)


class Edge:
    """Lies below or above every value of any type; stands for what a bound leaves open."""

    def __init__(self, side: int):
        self.side = side

    def __lt__(self, other):
        return self.side < (other.side if isinstance(other, Edge) else 0)

    def __gt__(self, other):
        return self.side > (other.side if isinstance(other, Edge) else 0)

    def __eq__(self, other):
        return isinstance(other, Edge) and other.side == self.side

    def __hash__(self):
        return hash(self.side)

    def __repr__(self):
        return "LOWEST" if self.side < 0 else "HIGHEST"


LOWEST, HIGHEST = Edge(-1), Edge(1)


@dataclass
class Schema:
    columns: dict[str, SchemaColumn] = field(default_factory=dict)
    kind: str = "series"

    def __init__(self, *lines: str, kind: str = "series", **columns: str):
        """``Schema(timestamp="timestamp*", value="float")`` or ``Schema("timestamp timestamp*", "value float")``."""
        texts = dict(line.split(None, 1) for text in lines for line in text.splitlines() if line.strip()) | columns
        self.columns = {n: c if isinstance(c, SchemaColumn) else SchemaColumn.parse(n, c) for n, c in texts.items()}
        self.kind = kind
        if not self.idx:
            raise ValueError("a schema needs at least one index column")

    @classmethod
    def kv(cls, *lines: str, **columns: str) -> Schema:
        """A schema whose writes replace by key."""
        return cls(*lines, kind="kv", **columns)

    @classmethod
    def from_frame(cls, df: DataFrame, idx_columns: list[str] | None = None) -> Schema:
        """The schema of a DataFrame; all columns are index columns unless said otherwise."""
        return cls(**{f.name: SchemaColumn(f.name, type_name(f.dataType), idx_columns is None or f.name in idx_columns) for f in df.schema})

    @property
    def idx(self) -> list[str]:
        return [n for n, c in self.columns.items() if c.idx]

    @property
    def idx_columns(self) -> list[SchemaColumn]:
        return [self.columns[n] for n in self.idx]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.spark, True, {"idx": c.idx, "codecs": list(c.codecs)}) for n, c in self.columns.items()])

    def __len__(self):
        return len(self.columns)

    def __iter__(self):
        return iter(self.columns)

    def __getitem__(self, name: str) -> SchemaColumn:
        return self.columns[name]

    def __eq__(self, other):
        return isinstance(other, Schema) and self.kind == other.kind and [(c.name, c.spark, c.idx) for c in self.columns.values()] == [(c.name, c.spark, c.idx) for c in other.columns.values()]

    def dumps(self) -> str:
        return json.dumps({"kind": self.kind, "columns": {n: {"dt": c.type_name, "codecs": list(c.codecs), "idx": c.idx} for n, c in self.columns.items()}})

    @classmethod
    def loads(cls, text: str) -> Schema:
        d = json.loads(text)
        return cls(kind=d["kind"], **{n: SchemaColumn(n, c["dt"], c["idx"], tuple(c["codecs"])) for n, c in d["columns"].items()})

    def cast(self, df: DataFrame) -> DataFrame:
        """The schema's columns that ``df`` has, cast; other columns are dropped, missing ones not invented."""
        have = {f.name: f.dataType for f in df.schema}
        return df.select(*(c.cast(F.col(f"`{n}`"), have[n]).alias(n) for n, c in self.columns.items() if n in have))

    @property
    def numeric(self) -> list[str]:
        """Columns outside of the index that hold numbers: what a viewer can draw."""
        return [n for n, c in self.columns.items() if not c.idx and isinstance(c.spark, T.NumericType)]

    def __matmul__(self, labels: str | list[str]) -> dict[str, Schema]:
        """``schema @ ["a", "b"]``: this schema for each label."""
        return {label: self for label in ([labels] if isinstance(labels, str) else labels)}

    def values(self, bound: Any) -> tuple | None:
        """A bound (scalar or tuple of the first index columns) as typed values; None or an empty tuple is no bound."""
        if bound is None:
            return None
        bound = tuple(bound) if isinstance(bound, (tuple, list)) else (bound,)
        if len(bound) > len(self.idx):
            raise ValueError(f"bound {bound} has more values than the index {self.idx}")
        return tuple(c.value(x) for c, x in zip(self.idx_columns, bound)) or None

    def create(self, spark: SparkSession, data: Any) -> DataFrame:
        """A DataFrame of this schema from a DataFrame, a pandas one, a dict of columns or a list of records; columns that are missing stay missing."""
        if isinstance(data, DataFrame):
            return self.cast(data)
        if isinstance(data, list):
            names = list(data[0]) if data else list(self.columns)
            data = {n: [r[n] for r in data] for n in names}
        if hasattr(data, "to_dict") and hasattr(data, "columns"):
            data = {n: data[n].tolist() for n in data.columns}
        data = {n: list(data[n]) for n in self.columns if n in data}
        if len({len(x) for x in data.values()}) > 1:
            raise ValueError("columns differ in length")
        plain = lambda c, x: json.dumps(x) if c.type_name == "O" else c.value(x)
        typed = {n: [None if x is None else plain(self.columns[n], x) for x in col] for n, col in data.items()}
        struct = T.StructType([f for f in self.struct if f.name in typed])
        return spark.createDataFrame(list(zip(*typed.values())), struct)


def records(df: DataFrame, style: str | None = "default"):
    """Rows as dicts: ``default`` with Python values, ``epoch`` with times as whole seconds."""
    if style == "epoch":
        df = df.select(*(epoch(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
    return (r.asDict() for r in df.toLocalIterator())


def epoch(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return since_1970(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86400
    return c
