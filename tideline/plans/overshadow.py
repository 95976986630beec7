"""Visible rows of a history of writes as one declarative plan, for histories that themselves are large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Ranges into which the index is cut so that rows and writes meet by equality.
RANGES = 1024


def visible(rows: DataFrame, writes: DataFrame, index: str, label: str = "label") -> DataFrame:
    """Rows that lie inside the interval of their own write and in none of a later one.

    rows: label, index, seq, ...; writes: label, seq, start, stop, closed (l, r, b or n); a delete is a write without rows, a null bound leaves its side open. Where the index is a number or a time, it is cut into RANGES equal ranges between its
    least and its largest value (one action): a row meets only the writes that reach into its own range, and (label, range) splits a hot label. Otherwise the label alone is the key. Rows with a null label or index are
    in no write and not visible.
    """
    x, kind = F.col(index), rows.schema[index].dataType
    held = rows.where(x.isNotNull() & F.col(label).isNotNull())
    number = number_of(kind)
    w = writes.select(F.col(label).alias("_l"), F.col("seq").alias("_s"), "start", "stop", "closed")
    if number is None:
        held, w = held.withColumn("_range", F.lit(0)), w.withColumn("_r", F.lit(0))
    else:
        low, high = held.agg(F.min(number(x)), F.max(number(x))).first()
        width = max(1e-9, ((high or 0) - (low or 0)) / RANGES)
        place = lambda c: F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor((number(c) - (low or 0)) / width)))
        held = held.withColumn("_range", place(x))
        bound = lambda c, none: F.when(F.col(c).isNull(), F.lit(none)).otherwise(place(F.col(c)))
        first, last = bound("start", 0), bound("stop", RANGES - 1)
        w = w.withColumn("_r", F.explode(F.sequence(first, F.greatest(first, last))))
    left = F.col("start").isNull() | (x > F.col("start")) | (F.col("closed").isin("l", "b") & (x == F.col("start")))
    right = F.col("stop").isNull() | (x < F.col("stop")) | (F.col("closed").isin("r", "b") & (x == F.col("stop")))
    inside = left & right & (F.col(label) == F.col("_l")) & (F.col("_range") == F.col("_r"))
    own = held.join(w, inside & (F.col("seq") == F.col("_s")), "left_semi")
    return own.join(w, inside & (F.col("_s") > F.col("seq")), "left_anti").drop("_range")


def number_of(kind: T.DataType):
    """How an index of a type becomes a number that keeps its order; None if it has no such."""
    if isinstance(kind, T.NumericType):
        return lambda c: c.cast("double")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")).cast("double")
    return None
