"""Irregular readings onto a regular grid, with a Kalman smoother over a continuous-time local trend.

State: level and slope; the slope is a Wiener process, so between times dt apart the state moves by [[1, dt], [0, 1]] with
covariance q * [[dt^3/3, dt^2/2], [dt^2/2, dt]]. A period's readings observe level + slope * (their mean offset). Time is in periods, and any dt will do: a block's own periods follow each
other, the periods with readings that it is told of from before and after lie where they lie, across any pause. The noise is that of the whole source.
Blocks of all labels in a batch run in lockstep: one numpy step for one node of all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.blocks import SERIES, carried, floats, ints, last_of, lists, versions, whole_groups
from tideline.plans.shared import ship, written

#: Periods of a block, and periods with readings that it is told of on each side at most: the smoother's memory is about (r/q)^(1/4) of them, 32 at most, and a block tells of eight times its own.
PERIODS, EDGE = 4096, 256
#: Periods of a block at least, however long they are.
LEAST = 512
#: Readings further from their neighbours' median than so many standard deviations have their variance raised, so that spikes don't bend the level.
GATE = 5.0
#: Periods between two readings up to which a change of level is a step.
NO_PAUSE = 4
CELL = "array<struct<k: long, mean: double, offset: double, n: double>>"
PACKED = f"label string, period_s long, block long, k array<long>, mean array<double>, offset array<double>, fit array<double>, observed array<double>, n array<int>, head {CELL}, tail {CELL}, min_k long, max_k long, near double, near_n long, far double, far_n long, spread double, spread_n long"
SCHEMA = "label string, period_start long, value double, sd double, observed double, n_readings int, missing boolean"
ARROW = pa.schema([("label", pa.string()), ("period_start", pa.int64()), ("value", pa.float64()), ("sd", pa.float64()), ("observed", pa.float64()), ("n_readings", pa.int32()), ("missing", pa.bool_())])
CELLS = pa.struct([("k", pa.int64()), ("mean", pa.float64()), ("offset", pa.float64()), ("n", pa.float64())])


def second_difference(y: np.ndarray, h: int) -> tuple[float, int]:
    """Robust variance of second differences h cells apart, and how many there are; 0, 0 below eight."""
    d = y[2 * h :] - 2 * y[h:-h] + y[: -2 * h] if len(y) > 2 * h else np.zeros(0)
    d = d[np.isfinite(d)]
    return ((1.4826 * float(np.median(np.abs(d)))) ** 2, len(d)) if len(d) >= 8 else (0.0, 0)


def noise(near: np.ndarray, near_n: np.ndarray, far: np.ndarray, far_n: np.ndarray, spread: np.ndarray, spread_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, q) of each source from sums over its blocks: second differences 1 and 8 cells apart have variances 6 r and 6 r + 2/3 q h^3."""
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where(spread_n > 0, spread / np.maximum(spread_n, 1), 1.0)
        floor = np.maximum(1e-12, 1e-8 * var)
        r = np.maximum(floor, np.where(near_n > 0, near / np.maximum(near_n, 1) / 6, var / 2))
        q = np.where(far_n > 0, (far / np.maximum(far_n, 1) - 6 * r) / (2 / 3 * 512), 1e-4 * r)
    return r, np.clip(q, 1e-6 * r, r)


def raised(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Variance of each reading (S x B, NaN: none): r, more for one that lies beyond GATE standard deviations from the median of the three readings before, itself and the three after.

    It depends on the readings alone, so the smoother stays linear and blocks agree with one another.
    """
    out = np.broadcast_to(r, y.shape).copy()
    for j in range(y.shape[1]):
        i = np.flatnonzero(np.isfinite(y[:, j]))
        v = y[i, j]
        if len(v) < 7:
            continue
        middle = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, 3, mode="edge"), 7), axis=1)
        away = np.abs(v - middle)
        usual = 1.4826 * np.median(away)
        out[i, j] = np.maximum(r[j], np.where(away > GATE * np.maximum(np.sqrt(r[j]), usual), away * away, 0.0))
    return out


def jumps(y: np.ndarray, r: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """Variance that the level gains at each node: where the medians of the seven readings before and the seven from here on lie further apart than GATE times what is usual, that distance squared; else 0.

    So a lasting change of level is a step, and not the beginning of a slope; a change over a pause is none. Like raised() it depends on the readings alone.
    """
    out, times = np.zeros(y.shape), np.cumsum(dt, 0)
    for j in range(y.shape[1]):
        i = np.flatnonzero(np.isfinite(y[:, j]))
        if len(i) < 20:
            continue
        middle = np.median(np.lib.stride_tricks.sliding_window_view(y[i, j], 7), axis=1)
        apart = np.abs(middle[7:] - middle[:-7])  # of readings a+7.. and ..a+6
        top = (apart > GATE * (1.4826 * np.median(apart) + 3 * np.sqrt(r[j]))) & (np.diff(times[i, j])[6:-6] <= NO_PAUSE)
        # the largest of its neighbourhood is where it happens
        near = np.lib.stride_tricks.sliding_window_view(np.pad(apart, 4), 9).max(1)
        at = np.flatnonzero(top & (apart == near))
        out[i[at + 7], j] = apart[at] ** 2
    return out


def smooth(y: np.ndarray, d: np.ndarray, n: np.ndarray, r: np.ndarray, q: np.ndarray, dt: np.ndarray | None = None, jump: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance at each of the S nodes of B series (arrays S x B; q of length B, r S x B or B).

    y: mean of a period's readings (NaN: none), d: their mean offset in periods, n: how many they are; dt: periods since the node before (1 if not given; 0 stands for nodes added for filling up); jump: see jumps().
    """
    steps, b = y.shape
    r = np.broadcast_to(r, y.shape)
    dt = np.ones((steps, b)) if dt is None else dt
    jump = np.zeros((steps, b)) if jump is None else jump
    seen = np.isfinite(y)
    first = np.argmax(seen, 0)
    cols = np.arange(b)
    start = np.where(seen.any(0), y[first, cols], 0.0)
    spread = np.array([np.var(y[seen[:, j], j]) if seen[:, j].any() else 0.0 for j in cols])
    wide = np.maximum(spread, r.max(0) if steps else 0.0) * 1e4 + (r.max(0) if steps else 1.0)
    m0, m1 = start.copy(), np.zeros(b)
    p00, p01, p11 = wide.copy(), np.zeros(b), wide / 100
    keep = np.empty((10, steps, b))
    yy, nn = np.where(seen, y, 0.0), np.maximum(n, 1)
    for i in range(steps):
        if i:
            h = dt[i]
            m0 = m0 + h * m1
            p00, p01, p11 = p00 + 2 * h * p01 + h * h * p11 + q * h**3 / 3 + jump[i], p01 + h * p11 + q * h * h / 2, p11 + q * h
        keep[:5, i] = m0, m1, p00, p01, p11
        di = d[i]
        h0, h1 = p00 + di * p01, p01 + di * p11
        e = yy[i] - m0 - di * m1
        s = h0 + di * h1 + r[i] / nn[i]
        g = np.where(seen[i], 1 / s, 0.0)
        k0, k1 = h0 * g, h1 * g
        m0, m1 = m0 + k0 * e, m1 + k1 * e
        p00, p01, p11 = p00 - k0 * h0, p01 - k0 * h1, p11 - k1 * h1
        keep[5:, i] = m0, m1, p00, p01, p11
    level, var = np.empty((steps, b)), np.empty((steps, b))
    for i in range(steps - 1, -1, -1):
        f0, f1, f00, f01, f11 = keep[5:, i]
        if i == steps - 1:
            m0, m1, p00, p01, p11 = f0, f1, f00, f01, f11
        else:
            h = dt[i + 1]
            a0, a1, a00, a01, a11 = keep[:5, i + 1]
            det = a00 * a11 - a01 * a01
            det = np.where(np.abs(det) > 1e-300, det, 1e-300)
            c00, c01, c10, c11 = f00 + h * f01, f01, f01 + h * f11, f11  # P F'
            g00, g01 = (c00 * a11 - c01 * a01) / det, (c01 * a00 - c00 * a01) / det
            g10, g11 = (c10 * a11 - c11 * a01) / det, (c11 * a00 - c10 * a01) / det
            x0, x1 = m0 - a0, m1 - a1
            d00, d01, d11 = p00 - a00, p01 - a01, p11 - a11
            m0, m1 = f0 + g00 * x0 + g01 * x1, f1 + g10 * x0 + g11 * x1
            u0, u1, w0, w1 = g00 * d00 + g01 * d01, g00 * d01 + g01 * d11, g10 * d00 + g11 * d01, g10 * d01 + g11 * d11
            p00, p01, p11 = f00 + u0 * g00 + u1 * g01, f01 + u0 * g10 + u1 * g11, f11 + w0 * g10 + w1 * g11
        level[i], var[i] = m0, p00
    return level, np.maximum(var, 0)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells sorted by (series, block, k) as one row per block, with its edges and what it says of the source's noise."""
    for batch, starts in whole_groups(batches, 150_000, "k"):
        sizes = np.diff(np.append(starts, batch.num_rows))
        group = np.repeat(np.arange(len(starts)), sizes)
        k, fit = ints(batch, "k"), floats(batch, "fit")
        mean, offset = floats(batch, "mean"), floats(batch, "offset")
        usable = fit > 0
        seen = np.cumsum(usable)
        first = seen - usable - (seen - usable)[starts][group]  # usable cells before this one in its block
        left = np.bincount(group, usable, len(starts))[group] - first - usable
        cell = pa.StructArray.from_arrays([pa.array(k), pa.array(mean), pa.array(offset), pa.array(fit)], fields=list(CELLS))

        stats = []
        for g, at in enumerate(starts):
            i = slice(at, at + sizes[g])
            y = np.full(int(k[i][-1] - k[i][0]) + 1, np.nan)
            y[k[i] - k[i][0]] = np.where(usable[i], mean[i], np.nan)
            near, far = second_difference(y, 1), second_difference(y, 8)
            some = y[np.isfinite(y)]
            stats.append((near[0] * near[1], near[1], far[0] * far[1], far[1], float(np.var(some)) * len(some) if len(some) else 0.0, len(some)))
        # how far the block's own noise lets the smoother remember
        r, q = noise(*np.array(stats, float).T)
        reach = np.minimum(EDGE, 8 + np.ceil(8 * (r / q) ** 0.25)).astype(int)[group]

        def edge(rank):
            i = np.flatnonzero(usable & (rank < reach))
            return lists(cell.take(pa.array(i)), np.bincount(group[i], minlength=len(starts)))

        arrays = [batch.column(c).take(pa.array(starts)) for c in (*SERIES, "block")]
        arrays += [lists(batch.column(c), sizes) for c in ("k", "mean", "offset", "fit", "observed", "n")]
        arrays += [edge(first), edge(left), pa.array(k[starts]), pa.array(k[starts + sizes - 1])]
        arrays += [pa.array([s[i] for s in stats], pa.float64() if i % 2 == 0 else pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", PACKED)])


def unlisted(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A column of lists (null: empty) as numpy arrays; of structs as arrays with one column per field."""
    c = batch.column(name)
    flat = c.flatten()
    flat = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in flat.flatten()], 1) if pa.types.is_struct(flat.type) else flat.to_numpy(zero_copy_only=False).astype(float)
    return np.split(flat, np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1])


def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            if batch.num_rows:
                yield from block_grids(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema))


def block_grids(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    b = batch.num_rows
    period, block, periods = ints(batch, "period_s"), ints(batch, "block"), ints(batch, "periods")
    lo, hi = np.maximum(ints(batch, "first_k"), block * periods), np.minimum(ints(batch, "last_k"), (block + 1) * periods - 1)
    own = {c: unlisted(batch, c) for c in ("k", "mean", "offset", "fit", "observed", "n")}
    before, after = unlisted(batch, "before"), unlisted(batch, "after")
    r, q = noise(*(floats(batch, c) for c in ("near", "near_n", "far", "far_n", "spread", "spread_n")))
    size = hi - lo + 1
    lead = max((len(x) for x in before), default=0)
    # nodes: what came before (ending at row lead), the own periods, what comes after
    steps = lead + int((size + np.array([len(x) for x in after])).max())
    y, d, n, dt = np.full((steps, b), np.nan), np.zeros((steps, b)), np.zeros((steps, b)), np.zeros((steps, b))
    obs, count = np.full((steps, b), np.nan), np.zeros((steps, b), np.int32)
    for j in range(b):
        p, a = before[j], after[j]
        at = lead - len(p)
        times = np.concatenate([p[:, 0] if len(p) else [], np.arange(lo[j], hi[j] + 1), a[:, 0] if len(a) else []])
        dt[at + 1 : at + len(times), j] = np.diff(times)
        for part, start in ((p, at), (a, lead + int(size[j]))):
            if len(part):
                i = slice(start, start + len(part))
                y[i, j], d[i, j], n[i, j] = part[:, 1], part[:, 2], part[:, 3]
        i = lead + (own["k"][j] - lo[j]).astype(int)
        fit = own["fit"][j]
        y[i, j], d[i, j], n[i, j] = np.where(fit > 0, own["mean"][j], np.nan), np.nan_to_num(own["offset"][j]), fit
        obs[i, j], count[i, j] = own["observed"][j], own["n"][j]
    usable = np.isfinite(y).any(0)
    level, var = smooth(y, d, n, raised(y, r), q, dt, jumps(y, r, dt))
    labels = batch.column("label")
    for j in range(b):
        i = slice(lead, lead + int(size[j]))
        none = np.full(int(size[j]), not usable[j])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([labels[j].as_py()] * int(size[j]), pa.string()),
                pa.array(np.arange(lo[j], hi[j] + 1) * period[j]),
                pa.array(level[i, j], mask=none),
                pa.array(np.sqrt(var[i, j]), mask=none),
                pa.array(obs[i, j], from_pandas=True),
                pa.array(count[i, j]),
                pa.array(count[i, j] == 0),
            ],
            schema=ARROW,
        )


def block_periods(periods: int) -> Column:
    """Periods of a block. Of long periods fewer make a block, since each may hold a reading a second."""
    return F.least(F.lit(periods), F.greatest(F.lit(LEAST), F.floor(F.lit(PERIODS * 3600) / F.col("period_s")))).cast("long")


def cells(readings: DataFrame, info: DataFrame, periods: int = PERIODS) -> DataFrame:
    """The series' columns, block, k, n, fit, mean, offset, observed: one row per period with a value. The one shuffle, by (series, block), serves the versions, the sums of periods and the packing of blocks; a dense period is summed as it arrives."""
    k = F.floor(F.col("t") / F.col("period_s"))
    rows = versions(readings, info).withColumn("k", k).withColumn("block", F.floor(F.col("k") / block_periods(periods)))
    at = [*SERIES, "block", "k"]
    held = rows.repartition(*SERIES, "block").groupBy(*at, "t").agg(F.max(F.struct("ver", "value")).alias("h"), F.min("low").alias("low"), F.max("high").alias("high")).select(*at, "t", "low", "high", F.col("h.value").alias("value")).where("value is not null")
    finite = F.abs("value") != F.lit(float("inf"))
    good = finite & (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    offset = (F.col("t") - F.col("k") * F.col("period_s")) / F.col("period_s")
    when = lambda c, x: F.avg(F.when(c, x))
    return held.groupBy(*at).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.count_if(good).cast("double").alias("fit"), when(good, F.col("value")).alias("mean"), F.coalesce(when(good, offset), F.lit(0.0)).alias("offset"), when(finite, F.col("value")).alias("observed")
    )


def regular_grid(readings: DataFrame, info: DataFrame, periods: int = PERIODS) -> DataFrame:
    """One row per label and period from the label's first to its last period with a value.

    ``period_start`` in seconds since 1970; ``value`` and ``sd``: the smoothed level at the period's start and its standard
    deviation; ``observed``: the mean of the period's readings; ``n_readings``; ``missing``: no reading with a value lies in
    the period. Of the versions of a (label, time) the latest published holds, also when its value is null or NaN, and
    repeated rows count once; see versions() for ties. Readings without label, time or a known collection are left
    out. Infinite values and those outside the collection's limits count as values but do not move the level; a label that has nothing else has null ``value`` and ``sd``. A label without any value has no rows, an empty table neither.

    A block is smoothed together with up to EDGE periods with readings on either side of it, however far away they are, under the noise of the whole label; what lies beyond those has lost its weight, see PERIODS. Writes one table of blocks.
    """
    ship(readings.sparkSession)
    placed = cells(readings, info, periods).sortWithinPartitions(*SERIES, "block", "k")
    blocks = written(placed.mapInArrow(packed, T._parse_datatype_string(PACKED)), "grid-blocks")
    sums = ("near", "near_n", "far", "far_n", "spread", "spread_n")
    stats = {"first_k": (F.min, "min_k"), "last_k": (F.max, "max_k"), **{c: (F.sum, c) for c in sums}}
    told = carried(blocks.select(*SERIES, "block", "head", "tail", F.col("min_k"), F.col("max_k"), *sums), SERIES, EDGE, stats)
    told = told.select(*SERIES, "block", "tail", "before", "after", "next_block", *stats)
    # blocks that lie wholly in a pause
    pause = told.where("next_block > block + 1").select(*SERIES, F.explode(F.sequence(F.col("block") + 1, F.col("next_block") - 1)).alias("block"), last_of(F.concat("before", "tail"), EDGE).alias("before"), "after", *stats)
    arrays = ["k", "mean", "offset", "fit", "observed", "n"]
    full = blocks.select(*SERIES, "block", *arrays).join(told.select(*SERIES, "block", "before", "after", *stats), [*SERIES, "block"])
    both = full.unionByName(pause, allowMissingColumns=True).withColumn("periods", block_periods(periods))
    return both.mapInArrow(gridded, T._parse_datatype_string(SCHEMA))
