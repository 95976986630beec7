"""Implausible readings: impossible, stuck and spiking, each judged by its own label.

Blocks of time are folded into daily profile matrices (rows: days or equal parts of a day, columns: their periods). Robust principal
components split a matrix into a low-rank part, the label's normal course, and a sparse part. Only readings in the sparse part can be spikes, and how far they depart is measured after the
normal course of the day is taken off: a peak that every day has is no spike, a day that lacks it has one. Then an
exact test against the level just before and just after decides. Runs of one value and the physical limits are tested by themselves.

A block decides what lies inside of it. What lies within MARGIN readings of its edges is decided in a second pass over the edges alone, which have been told of the readings before and after, however long ago.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.blocks import SERIES, carried, floats, group_starts, ints, lists, versions, whole_groups
from tideline.plans.shared import ship, written

#: Columns of a profile at most, cells of a block about.
COLUMNS, CELLS = 288, 4608
#: Readings just before and just after that give the level.
NEAR = 6
STUCK = 8
#: Times the usual scatter that a spike departs from the level.
DEPARTURE = 10.0
#: The scatter around a level made of two medians of NEAR readings is larger than that of the readings by this factor (normal noise).
WIDER = 1.05
#: A cell is in the sparse part from so many scatters of the matrix on; well below DEPARTURE.
SPARSE = 2.5
#: Readings from an edge that the second pass decides, and readings on each side that it sees. Of a run of one value STUCK readings count, of a run of impossible ones one.
MARGIN, EDGE = 16, 32
#: Readings below which a block has no profile.
LEAST = 12

POINT = "array<struct<t: long, v: double, x: double, sparse: boolean, bad: boolean>>"
SCHEMA = f"label string, period_s long, block long, epoch_s long, kind string, departure double, pairs long, equal_pairs long, scatter double, n_scatter long, head {POINT}, tail {POINT}"
FOUND = "label string, epoch_s long, kind string, departure double, pairs long, equal_pairs long, scatter double, n_scatter long"
POINTS = pa.struct([("t", pa.int64()), ("v", pa.float64()), ("x", pa.float64()), ("sparse", pa.bool_()), ("bad", pa.bool_())])
ARROW = pa.schema([("label", pa.string()), ("period_s", pa.int64()), ("block", pa.int64()), ("epoch_s", pa.int64()), ("kind", pa.string()), ("departure", pa.float64()), ("pairs", pa.int64()), ("equal_pairs", pa.int64()), ("scatter", pa.float64()), ("n_scatter", pa.int64()), ("head", pa.list_(POINTS)), ("tail", pa.list_(POINTS))])
FOUND_ARROW = pa.schema([ARROW.field(n) for n in ("label", "epoch_s", "kind", "departure", "pairs", "equal_pairs", "scatter", "n_scatter")])


def robust_pca(m: np.ndarray, rounds: int = 30, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of a wide matrix by the inexact augmented Lagrangian of principal component pursuit.

    Singular vectors come from the small Gram matrix (rows x rows), so a round costs little more than one product.
    """
    lam = 1 / np.sqrt(max(m.shape))
    norm = np.linalg.norm(m) or 1.0
    top = np.linalg.norm(m, 2) or 1.0
    mu = 1.25 / top
    y = m / max(top, np.abs(m).max() / lam)
    s = np.zeros_like(m)
    low = s
    for _ in range(rounds):
        a = m - s + y / mu
        w, u = np.linalg.eigh(a @ a.T)
        sv = np.sqrt(np.maximum(w, 0))
        shrunk = np.where(sv > 1 / mu, 1 - 1 / (mu * np.maximum(sv, 1e-300)), 0.0)
        low = (u * shrunk) @ (u.T @ a)
        x = m - low + y / mu
        s = np.sign(x) * np.maximum(np.abs(x) - lam / mu, 0)
        z = m - low - s
        y = y + mu * z
        mu = min(mu * 1.6, 1e7 / top)
        if np.linalg.norm(z) < tol * norm:
            break
    return low, s


def normal_course(cell: np.ndarray, value: np.ndarray, columns: int, daily: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each reading what the usual day adds to its level, and whether it lies in the sparse part.

    ``cell``: ascending period numbers; ``value``: finite; ``daily``: a row is a whole day, otherwise it is a part of one, which adds nothing. The matrix of days is centred by the median of each
    column, so that what most days have at the same time is the normal course and an odd spike leaves no trace in it; the principal components then separate how days differ from what is sparse.
    """
    first = int(cell[0])
    span = int(cell[-1]) - first + 1
    daily &= 4 <= columns <= span // 8
    columns = max(4, min(columns, span // 8))
    origin = first - first % columns  # columns keep their place in the day
    rows = (int(cell[-1]) - origin) // columns + 1
    pos = cell - origin
    total = np.bincount(pos, value, rows * columns)
    n = np.bincount(pos, minlength=rows * columns)
    seen = np.flatnonzero(n)
    mean = total[seen] / n[seen]
    # empty cells come from medians of their neighbours, which no spike is part of
    middle = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(mean, 3, mode="edge"), 7), axis=1)
    matrix = np.interp(np.arange(rows * columns), seen, middle)
    matrix[seen] = mean
    matrix = matrix.reshape(rows, columns)
    usual = np.median(matrix - np.median(matrix, axis=1, keepdims=True), axis=0) if daily else np.zeros(columns)
    usual = usual - usual.mean()
    matrix = matrix - usual
    centre = np.median(matrix)
    scale = 1.4826 * np.median(np.abs(np.diff(matrix.reshape(-1)))) or np.std(matrix) or 1.0
    low, _ = robust_pca((matrix - centre) / scale)
    shape = usual[pos % columns]
    rest = np.abs(value - shape - centre - scale * low.reshape(-1)[pos])
    sparse = rest > SPARSE * max(1.4826 * np.median(rest), 1e-12)
    hit = np.zeros(rows * columns + 2, bool)
    hit[pos[sparse] + 1] = True  # a cell may hold several readings, and its fill bends the cells beside it
    return shape, hit[pos + 1] | hit[pos] | hit[pos + 2]


def side_levels(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of up to NEAR readings of the same segment before and after each reading; NaN if there are fewer than three."""
    n = len(v)

    def level(shift: int) -> np.ndarray:
        w = np.full((n, NEAR), np.nan)
        for j in range(1, NEAR + 1):
            if j < n:
                a, b = (slice(j, None), slice(None, n - j)) if shift < 0 else (slice(None, n - j), slice(j, None))
                same = seg[a] == seg[b]
                w[a, j - 1][same] = v[b][same]
        w.sort(axis=1)
        c = NEAR - np.isnan(w).sum(1)
        i = np.arange(n)
        m = (w[i, np.maximum(c - 1, 0) // 2] + w[i, np.minimum(c // 2, NEAR - 1)]) / 2
        return np.where(c >= 3, m, np.nan)

    return level(-1), level(1)


def departures(v: np.ndarray, seg: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each reading departs from the levels around it, as a member of a departure of one, two or three readings; else 0.

    All members lie on the far side of both levels, and the readings next to them, before and after, stay within half of
    that distance: a longer departure, a step to a new level or a swell of many readings gives 0.
    """
    n = len(v)
    best = np.zeros(n)
    for size in (1, 2, 3):
        if n < size + 2:
            break
        i = np.arange(1, n - size)
        j = i + size - 1
        b, a = before[i], after[j]
        ok = (seg[i - 1] == seg[j + 1]) & np.isfinite(b) & np.isfinite(a)
        far = np.full(len(i), np.inf)
        for e in range(size):
            up, down = v[i + e] - np.maximum(a, b), np.minimum(a, b) - v[i + e]
            far = np.minimum(far, np.maximum(up, down))
        near = np.maximum(np.abs(v[i - 1] - b), np.abs(v[j + 1] - a))
        far = np.where(ok & (far > 0) & (near <= far / 2), far, 0.0)
        for e in range(size):
            np.maximum.at(best, i + e, far)
    return best


def runs_of(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each reading's run, place within it, its length); a run has one value and one segment."""
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (seg[1:] != seg[:-1])
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return run, np.arange(len(v)) - start[run], np.bincount(run)[run]


def spikes_of(x: np.ndarray, seg: np.ndarray, calm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(departure, distance from the level) of each reading from the calm ones around it; 0 and NaN for those that are not calm."""
    far, rest = np.zeros(len(x)), np.full(len(x), np.nan)
    if calm.any():
        w, s = x[calm], seg[calm]
        before, after = side_levels(w, s)
        far[calm] = departures(w, s, before, after)
        rest[calm] = np.abs(w - (before + after) / 2)
    return far, rest


def scatter_of(rest: np.ndarray) -> tuple[float | None, int]:
    r = rest[np.isfinite(rest)]
    return (1.4826 * float(np.median(r)) / WIDER if len(r) else None), len(r)


def kept_ranks(v: np.ndarray, bad: np.ndarray, group: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which readings an edge tells of, seen from the start (or end) of each group, and how many such lie nearer to it."""
    if backwards:
        keep, rank = kept_ranks(v[::-1], bad[::-1], group[-1] - group[::-1], False)
        return keep[::-1], rank[::-1]
    keep = (runs_of(v, group)[1] < STUCK) & ~bad
    keep |= bad & (runs_of(bad.astype(float), group)[1] == 0)
    seen = np.cumsum(keep) - keep
    return keep, seen - seen[np.searchsorted(group, group)]


def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pass: what each block decides by itself (rows with a kind), and one row with its edges and statistics."""
    for batch, _ in whole_groups(batches, 150_000, "t"):
        batch = batch.filter(pa.array(~np.isnan(floats(batch, "value"))))
        if not batch.num_rows:
            continue
        starts = group_starts(batch)
        sizes = np.diff(np.append(starts, batch.num_rows))
        group = np.repeat(np.arange(len(starts)), sizes)
        v, t, period, columns = floats(batch, "value"), ints(batch, "t"), ints(batch, "period_s"), ints(batch, "columns")[starts]
        k = t // period
        bad = (v < floats(batch, "low")) | (v > floats(batch, "high")) | np.isinf(v)
        n = len(v)
        _, place, length = runs_of(v, group)
        stuck = (length >= STUCK) & ~bad
        calm = ~bad & ~stuck
        x, sparse = v.copy(), np.ones(n, bool)
        for g in range(len(starts)):
            i = starts[g] + np.flatnonzero(calm[starts[g] : starts[g] + sizes[g]])
            if len(i) >= LEAST:
                shape, hit = normal_course(k[i], v[i], int(columns[g]), bool(columns[g] * period[i[0]] * 2 > 86400))
                x[i], sparse[i] = v[i] - shape, hit
        far, rest = spikes_of(x, group, calm)
        keep_head, from_start = kept_ranks(v, bad, group, False)
        keep_tail, from_end = kept_ranks(v, bad, group, True)
        inner = (from_start >= MARGIN) & (from_end >= MARGIN)
        kinds = np.full(n, -1)
        kinds[inner & sparse & (far > 0)] = 2
        kinds[stuck], kinds[bad] = 1, 0
        hit = np.flatnonzero(kinds >= 0)
        none = lambda size, kind: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(hit)) for c in (*SERIES, "block")), pa.array(t[hit]), pa.array(["impossible", "stuck", "spike"]).take(pa.array(kinds[hit])), pa.array(far[hit]), *(none(len(hit), f.type) for f in list(ARROW)[6:])],
            schema=ARROW,
        )
        points = pa.StructArray.from_arrays([pa.array(t), pa.array(v), pa.array(x), pa.array(sparse), pa.array(bad)], fields=list(POINTS))

        def edge_of(keep, rank):
            i = np.flatnonzero(keep & (rank < EDGE))
            return lists(points.take(pa.array(i)), np.bincount(group[i], minlength=len(starts)))

        paired = np.bincount(group, place >= 0, len(starts)).astype(int) - 1
        equal = np.bincount(group, place > 0, len(starts)).astype(int)
        scatters = [scatter_of(np.where(inner, rest, np.nan)[a : a + b]) for a, b in zip(starts, sizes)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(starts)) for c in (*SERIES, "block")),
                *(none(len(starts), f.type) for f in list(ARROW)[3:6]),
                pa.array(paired),
                pa.array(equal),
                pa.array([s for s, _ in scatters], pa.float64()),
                pa.array([m for _, m in scatters]),
                edge_of(keep_head, from_start),
                edge_of(keep_tail, from_end),
            ],
            schema=ARROW,
        )


def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second pass, over rows of (head, tail, before, after): what lies near the edges of a block, and the block's pair with the reading before it."""
    for batch in batches:
        labels = batch.column("label")
        out: dict[str, list] = {c: [] for c in FOUND_ARROW.names}

        def points(name, i):
            got = batch.column(name)[i].as_py() or []
            return [(p["t"], p["v"], p["x"], p["sparse"], p["bad"]) for p in got]

        for i in range(batch.num_rows):
            head, tail, before, after = (points(c, i) for c in ("head", "tail", "before", "after"))
            label = labels[i].as_py()
            if len(head) < EDGE or head[-1][0] >= tail[0][0]:  # the two edges are or overlap one another
                whole = sorted(set(head) | set(tail))
                parts = [(before, whole, after)]
            else:
                parts = [(before, head, []), ([], tail, after)]
            rests = []
            for left, own, right in parts:
                p = left + own + right
                v, x = np.array([q[1] for q in p]), np.array([q[2] for q in p])
                sparse, bad = np.array([q[3] for q in p]), np.array([q[4] for q in p])
                seg = np.zeros(len(p), int)
                stuck = (runs_of(v, seg)[2] >= STUCK) & ~bad
                calm = ~bad & ~stuck
                far, rest = spikes_of(x, seg, calm)
                place = np.arange(len(p)) - len(left)
                mine = (place >= 0) & (place < len(own))
                edge = mine.copy()
                if len(parts) == 2:  # what lies further in has been decided
                    edge &= place < MARGIN if own is head else place >= len(own) - MARGIN
                rests.append(rest[edge])
                for j in np.flatnonzero(mine & stuck):
                    add(out, label, p[j][0], "stuck", 0.0)
                for j in np.flatnonzero(edge & calm & sparse & (far > 0)):
                    add(out, label, p[j][0], "spike", float(far[j]))
            scatter, n = scatter_of(np.concatenate(rests))
            pair = int(bool(before))
            for c, y in zip(out, (label, None, None, None, pair, int(bool(before) and before[-1][1] == head[0][1]), scatter, n)):
                out[c].append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in FOUND_ARROW], schema=FOUND_ARROW)


def add(out: dict[str, list], label: str, t: int, kind: str, departure: float) -> None:
    for c, y in zip(out, (label, t, kind, departure, None, None, None, None)):
        out[c].append(y)


def faulty_readings(readings: DataFrame, info: DataFrame) -> DataFrame:
    """label, epoch_s, kind, departure, scatter: the readings that hold, have a value and are faulty.

    ``impossible``: outside the collection's limits (an infinite value always is); of no other kind. ``stuck``: one of at least
    STUCK successive readings with exactly the same value, whatever time lies between them. ``spike``: in the sparse part of its profile matrix, and a departure of at most three successive readings from the level
    before and after by more than DEPARTURE times the label's scatter, both without the day's normal course. A label most of whose readings equal the one before has neither stuck readings nor spikes. Versions,
    ties and readings left out are those of versions(); null and NaN values are skipped. A limit that is null does not limit. An empty table gives no rows. Writes one table of findings and edges.
    """
    ship(readings.sparkSession)
    slots = F.greatest(F.lit(1), F.floor(F.lit(86400) / F.col("period_s")))
    rows = versions(readings, info).withColumn("columns", F.floor(slots / F.ceil(slots / COLUMNS)))
    periods = F.col("columns") * F.greatest(F.lit(16), F.least(F.lit(64), F.floor(CELLS / F.col("columns"))))
    rows = rows.withColumn("block", F.floor(F.floor(F.col("t") / F.col("period_s")) / periods))
    placed = rows.repartition(*SERIES, "block").sortWithinPartitions(*SERIES, "block", "t", "ver", "value")
    first = written(placed.mapInArrow(inside, T._parse_datatype_string(SCHEMA)), "faulty")
    edges = carried(first.where("head is not null").select(*SERIES, "block", "head", "tail"), SERIES, EDGE)
    second = edges.select("label", "head", "tail", "before", "after").mapInArrow(at_edges, T._parse_datatype_string(FOUND))
    found = written(first.select(*FOUND_ARROW.names).unionByName(second), "faults")
    by_label = found.where("kind is null").groupBy("label").agg((2 * F.sum("equal_pairs") > F.sum("pairs")).alias("steady"), (F.sum(F.col("scatter") * F.col("n_scatter")) / F.sum("n_scatter")).alias("scatter"))
    # a run over an edge is seen from both sides
    hit = found.where("kind is not null").groupBy("label", "epoch_s", "kind").agg(F.max("departure").alias("departure")).join(by_label, "label")
    spike = (F.col("kind") == "spike") & (F.col("departure") > DEPARTURE * F.coalesce("scatter", F.lit(0.0)))
    kept = (F.col("kind") == "impossible") | (~F.col("steady") & ((F.col("kind") == "stuck") | spike))
    return hit.where(kept).select("label", "epoch_s", "kind", "departure", "scatter")
