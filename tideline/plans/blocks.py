"""Series cut into blocks of time, one shuffle for any series length, and what blocks have to know of each other.

A label may hold a third of all rows, so no operator here ever gathers a label in one task. Time is divided into
periods and blocks of a fixed number of periods; (series, block) is the shuffle key. A block that must see beyond its edges gets the last entries of the
blocks before it and the first ones of those after it, by their number and across any pause, see carried().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.times import since_1970

#: Sorts before every real publication time.
NO_PUBTIME = -(2**60)
#: What makes a series: a label, and its collection's period.
SERIES = ["label", "period_s"]
#: Non-empty blocks on each side that a block is told of, and blocks for which that is found out together.
LOOK, TOGETHER = 8, 4096


def versions(readings: DataFrame, info: DataFrame) -> DataFrame:
    """label, period_s, low, high, t, ver, value of every reading that has a label, a time and a known collection.

    ``ver`` orders the versions of one (label, t): by publication time (null first), then a version with a number
    before one without. NaN counts as no number and comes out as null. ``info`` is one row per collection; its first row by period and limits is
    taken if a collection is repeated. Collections without a positive period are left out. Limits that are null come out infinite. A label is expected in one collection; in
    several of different periods it is a series in each of them.
    """
    info = info.where("collection is not null and period_s > 0").groupBy("collection").agg(F.min(F.struct(F.col("period_s").cast("long").alias("period_s"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))).alias("i"))
    value = F.when(~F.isnan("value"), F.col("value"))
    read = readings.select("collection", "label", since_1970(F.col("timestamp")).alias("t"), F.coalesce(since_1970(F.col("pubtime")), F.lit(NO_PUBTIME)).alias("pub"), value.cast("double").alias("value")).where("label is not null and t is not null")
    low, high = F.coalesce("i.low", F.lit(float("-inf"))).alias("low"), F.coalesce("i.high", F.lit(float("inf"))).alias("high")
    return read.join(info, "collection").select("label", "i.period_s", low, high, "t", (F.col("pub") * 2 + F.col("value").isNotNull().cast("long")).alias("ver"), "value")


def first_of(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def last_of(c: Column, n: int) -> Column:
    return F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)


def carried(edges: DataFrame, series: list[str], limit: int, stats: dict[str, tuple] | None = None) -> DataFrame:
    """``edges`` with ``before``, ``after`` (arrays of at most ``limit`` entries), ``next_block`` and statistics of the whole series.

    edges: one row per non-empty block with the columns of ``series``, ``block``, ``head`` and ``tail``: the block's first and last entries in order. ``before`` is what comes last in
    the LOOK non-empty blocks before it, ``after`` what comes first in those after it, however far away they are; ``stats``: name -> (aggregate, column), e.g. (F.sum, "n"). Blocks are
    compared within runs of TOGETHER, then the runs among each other, so that a task holds one row for millions of readings of a series at most.
    """
    stats = stats or {}
    flat = lambda c, a, b, w: F.flatten(F.collect_list(c).over(w.rowsBetween(a, b)))
    inner = W.partitionBy(*series, "_run").orderBy("block")
    e = edges.withColumn("_run", F.floor(F.col("block") / TOGETHER))
    e = e.withColumns({"_p": flat("tail", -LOOK, -1, inner), "_n": flat("head", 1, LOOK, inner), "_nb": F.lead("block").over(inner)})
    runs = e.groupBy(*series, "_run").agg(
        F.max_by(last_of(F.concat("_p", "tail"), limit), "block").alias("_t"), F.min_by(first_of(F.concat("head", "_n"), limit), "block").alias("_h"), F.min("block").alias("_b"), *(f(c).alias(n) for n, (f, c) in stats.items())
    )
    outer, all_ = W.partitionBy(*series).orderBy("_run"), W.partitionBy(*series)
    runs = runs.withColumns({"_rp": flat("_t", -LOOK, -1, outer), "_rn": flat("_h", 1, LOOK, outer), "_rb": F.lead("_b").over(outer), **{n: f(n).over(all_) for n, (f, _) in stats.items()}})
    one = [n for n in edges.columns if n not in stats]
    joined = e.select(*one, "_run", "_p", "_n", "_nb").join(runs.select(*series, "_run", "_rp", "_rn", "_rb", *stats), [*series, "_run"])
    return joined.select(*one, last_of(F.concat("_rp", "_p"), limit).alias("before"), first_of(F.concat("_n", "_rn"), limit).alias("after"), F.coalesce("_nb", "_rb").alias("next_block"), *stats)


def run_starts(label: pa.Array, *keys: np.ndarray) -> np.ndarray:
    """Positions at which (label, *keys) differs from the row before; the first row always."""
    n = len(label)
    new = np.zeros(n, bool)
    if n:
        ends = pc.run_end_encode(label).run_ends.to_numpy(zero_copy_only=False)
        new[0] = True
        new[ends[:-1]] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def ints(batch, name: str, null: int = 0) -> np.ndarray:
    c = batch.column(name)
    return pc.fill_null(c, null).to_numpy(zero_copy_only=False) if c.null_count else c.to_numpy(zero_copy_only=False)


def floats(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def group_starts(batch: pa.RecordBatch, at: str | None = None) -> np.ndarray:
    """Where a (series, block) begins; with ``at`` also where that column changes."""
    return run_starts(batch.column("label"), *(ints(batch, c) for c in ("period_s", "block", *([at] if at else []))))


def latest(batch: pa.RecordBatch, at: str) -> pa.RecordBatch:
    """The last row of each (series, block, at), in sorted order."""
    last = np.append(group_starts(batch, at)[1:], batch.num_rows) - 1
    return batch if len(last) == batch.num_rows else batch.take(pa.array(last))


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int, at: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches of whole (series, block) groups with about ``rows`` rows, and where each group starts. Of rows that agree in ``at`` the last is kept, batch by batch as they arrive."""
    held: list[pa.RecordBatch] = []
    ready: list[pa.RecordBatch] = []
    n = 0

    def together(parts):
        one = latest(pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0], at)
        return one, group_starts(one)

    def key(batch, i):
        return tuple(batch.column(c)[i].as_py() for c in (*SERIES, "block"))

    last_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = latest(batch, at)
        starts = group_starts(batch)
        if held and key(batch, 0) != last_key:
            ready += held
            n += sum(b.num_rows for b in held)
            held = []
        cut = int(starts[-1])
        if cut:
            ready += held
            n += sum(b.num_rows for b in held) + cut
            held = []
            ready.append(batch.slice(0, cut))
        held.append(batch.slice(cut))
        last_key = key(batch, batch.num_rows - 1)
        if n >= rows:
            yield together(ready)
            ready, n = [], 0
    if ready or held:
        yield together(ready + held)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive values as one list per group."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
