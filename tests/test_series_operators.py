"""Regular grids and faulty readings: against exact Gaussian conditioning, SQL-like brute force and planted faults."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows

from tideline.operators import grid, spikes

READINGS = "collection string, label string, timestamp timestamp_ntz, pubtime timestamp_ntz, value double, block int, k string"
INFO = "collection string, period_s int, unit string, low double, high double"
EPOCH = dt.datetime(1970, 1, 1)


def at(s):
    return None if s is None else EPOCH + dt.timedelta(seconds=s)


def readings(spark, data):
    """(label, t, pub, value)"""
    return spark.createDataFrame([("c", x, at(t), at(p), v, 1, "z") for x, t, p, v in data], READINGS)


@pytest.fixture
def info(spark):
    return spark.createDataFrame([("c", 10, "m", -100.0, 100.0), ("c", 10, "m", -100.0, 100.0), ("empty", 0, None, None, None), (None, 5, None, None, None)], INFO)


def exact(y, d, r, q):
    """Posterior level by conditioning all at once."""
    n = len(y)
    prior = np.zeros((2 * n, 2 * n))
    step, noise = np.array([[1, 1], [0, 1]]), q * np.array([[1 / 3, 1 / 2], [1 / 2, 1]])
    p = np.eye(2) * 1e6
    covs = [p]
    for _ in range(n - 1):
        covs.append(step @ covs[-1] @ step.T + noise)
    for i in range(n):
        c = covs[i]
        for j in range(i, n):
            prior[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = c
            prior[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = c.T
            c = c @ step.T
    seen = np.flatnonzero(np.isfinite(y))
    h = np.zeros((len(seen), 2 * n))
    for k, i in enumerate(seen):
        h[k, 2 * i], h[k, 2 * i + 1] = 1, d[i]
    s = h @ prior @ h.T + r * np.eye(len(seen))
    gain = np.linalg.solve(s, h @ prior).T
    mean = gain @ y[seen]
    cov = prior - gain @ h @ prior
    return mean[::2], np.diag(cov)[::2]


def test_smoother_is_exact():
    rng = np.random.default_rng(1)
    n = 40
    y = np.cumsum(np.cumsum(rng.normal(0, 0.1, n))) + rng.normal(0, 0.3, n)
    d = rng.uniform(0, 0.9, n)
    y[[3, 4, 5, 20, 21, 22, 23, 24, 25, 30]] = np.nan
    mean, var = exact(y, d, 0.09, 0.01)
    old, grid.GATE = grid.GATE, 1e9
    try:
        level, v = grid.smooth(y[:, None], d[:, None], np.ones((n, 1)), np.array([0.09]), np.array([0.01]))
    finally:
        grid.GATE = old
    assert np.allclose(level[:, 0], mean, atol=2e-3) and np.allclose(v[:, 0], var, rtol=2e-2)


def brute_missing(data, period=10):
    held = {}
    for x, t, p, v in data:
        if x is None or t is None:
            continue
        has = v is not None and v == v
        rank = (float("-inf") if p is None else p, has)
        if (x, t) not in held or rank > held[x, t][0]:
            held[x, t] = (rank, has)
    valued = {}
    for (x, t), (_, has) in held.items():
        if has:
            valued.setdefault(x, set()).add(t // period)
    return sorted((x, k * period) for x, ks in valued.items() for k in range(min(ks), max(ks) + 1) if k not in ks), sum(max(ks) - min(ks) + 1 for ks in valued.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grid_against_sets(spark, info, seed):
    rng = random.Random(seed)
    data = []
    for label, n in (("hot", 600), ("a", 40), ("b", 1), ("nothing", 3)):
        t = -500 if label == "a" else 0
        for _ in range(n):
            t += rng.choice([3, 9, 10, 11, 25, 25, 700 if label == "hot" else 40])
            v = rng.choice([rng.gauss(0, 1)] * 6 + [None, float("nan"), float("inf"), 500.0]) if label != "nothing" else rng.choice([None, float("nan")])
            data.append((label, t, rng.choice([None, t + 1]), v))
            if rng.random() < 0.2:
                data.append((label, t, t + rng.choice([1, 2]), rng.choice([None, 1.0, float("nan")])))
            if rng.random() < 0.1:
                data.append(data[-1])
    data += [(None, 5, 5, 1.0), ("a", None, 5, 1.0)]
    rng.shuffle(data)
    df = grid.regular_grid(readings(spark, data), info, periods=64)
    missing, total = brute_missing(data)
    assert rows(df.where("missing"), "label", "period_start") == missing
    assert df.count() == total and df.select("label", "period_start").distinct().count() == total
    assert df.where("missing and (observed is not null or n_readings > 0)").count() == 0


def test_blocks_agree_with_one_block(spark, info):
    rng = np.random.default_rng(4)
    t = np.arange(0, 20000, 10) + rng.integers(0, 10, 2000)
    v = 5 * np.sin(t / 900) + rng.normal(0, 0.2, 2000)
    data = [("s", int(a), int(a), float(b)) for a, b in zip(t, v) if not 4000 < a < 4150]
    one = {r.period_start: (r.value, r.sd) for r in grid.regular_grid(readings(spark, data), info, 4096).collect()}
    many = {r.period_start: (r.value, r.sd) for r in grid.regular_grid(readings(spark, data), info, 500).collect()}
    assert one.keys() == many.keys()
    assert max(abs(one[k][0] - many[k][0]) for k in one) < 0.02 and max(abs(one[k][1] - many[k][1]) for k in one) < 0.01
    truth = lambda k: 5 * np.sin(k / 900)
    assert np.mean([abs(many[k][0] - truth(k)) for k in many]) < 0.1
    gap = [k for k in many if 4010 < k < 4140]
    assert min(many[k][1] for k in gap) > np.median([x[1] for x in many.values()])


def test_pause_over_edges(spark, info):
    """A pause longer than several blocks is filled from both sides, as one smoother over everything would."""
    rng = np.random.default_rng(7)
    t = np.concatenate([np.arange(300), np.arange(3300, 3600)]) * 10
    v = np.concatenate([np.zeros(300), np.full(300, 60.0)]) + rng.normal(0, 0.2, 600)
    df = readings(spark, [("s", int(a), int(a), float(b)) for a, b in zip(t, v)])
    one, many = ({r.period_start: (r.value, r.sd) for r in grid.regular_grid(df, info, p).collect()} for p in (4096, 500))
    assert len(one) == len(many) == 3600
    sd = {k: x[1] for k, x in one.items()}
    assert max(abs(one[k][0] - many[k][0]) / (1 + sd[k]) for k in one) < 0.02
    assert max(abs(one[k][1] / many[k][1] - 1) for k in one) < 0.05
    middle = [many[k * 10][0] for k in (1000, 1800, 2600)]
    assert middle[0] < middle[1] < middle[2] and abs(middle[1] - 30) < 5


def test_grid_of_nothing(spark, info):
    assert grid.regular_grid(readings(spark, []), info).count() == 0
    assert grid.regular_grid(readings(spark, [("a", 1, 1, None), ("a", 2, 2, float("nan"))]), info).count() == 0
    only = grid.regular_grid(readings(spark, [("a", 1, 1, float("inf"))]), info).collect()
    assert len(only) == 1 and only[0].value is None and not only[0].missing


def planted(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 10 + rng.integers(0, 8, n)
    v = np.round(20 + 3 * np.sin(np.arange(n) / 300) + rng.normal(0, 0.1, n), 3)
    kinds = {}

    def put(i, values, kind):
        for j, x in enumerate(values):
            v[i + j] = x
            kinds[int(t[i + j])] = kind

    put(300, [v[300] + 3], "spike")
    put(500, [v[500] - 4, v[501] + 5, v[502] + 3], "spike")
    put(4096 // 10 * 7, [v[2863] + 2.5, v[2864] + 2.6], "spike")
    put(800, [500.0, float("inf")], "impossible")
    put(1000, [v[1000]] * 8, "stuck")
    put(1100, [v[1100]] * 40, "stuck")
    v[1300:1307] = v[1300]  # one too short
    v[1500:1505] += 3  # a longer departure
    v[1700:] += 6  # a new level
    v[2000:2030] += 4 * np.hanning(30)  # a swell
    return t, v, kinds


def test_planted_faults(spark, info):
    t, v, kinds = planted()
    data = [("s", int(a), int(a), float(b)) for a, b in zip(t, v)]
    data += [("s", int(t[10]), int(t[10]) - 5, 90.0), ("s", int(t[20]), int(t[20]), float(v[20]))]  # superseded, repeated
    data += [("valve", int(a), int(a), float(i // 50 % 3)) for i, a in enumerate(t)] + [("valve", int(t[-1]) + 5, 1, -200.0)]
    data += [("n", 1, 1, None), (None, 2, 2, 1.0), ("n", None, 2, 1.0), ("few", 1, 1, 1.0), ("few", 11, 1, 1000.0)]
    random.Random(1).shuffle(data)
    got = rows(spikes.faulty_readings(readings(spark, data), info), "label", "epoch_s", "kind")
    expected = [("s", x, k) for x, k in kinds.items()] + [("valve", int(t[-1]) + 5, "impossible"), ("few", 11, "impossible")]
    assert got == sorted(expected)


def test_divided_runs(spark, info):
    """Successive readings are successive whatever lies between them: years, empty blocks, blocks of one reading."""
    far = 10 * 20_000
    data = [("run", i * 10, 1, 3.0) for i in range(4)] + [("run", far + i * 10, 1, 3.0) for i in range(4)] + [("run", far + 1000 + i * 10, 1, float(i % 5)) for i in range(40)]
    data += [("sparse", i * far, 1, 7.0 if 5 <= i < 13 else float(i)) for i in range(30)]
    data += [("short", i * far, 1, 7.0 if 5 <= i < 12 else float(i)) for i in range(30)]
    data += [("long", i * 997, 1, 2.5 if 100 <= i < 1500 else float(i % 7)) for i in range(3000)]
    got = rows(spikes.faulty_readings(readings(spark, data), info).where("kind = 'stuck'"), "label", "epoch_s")
    expected = [("run", i * 10) for i in range(4)] + [("run", far + i * 10) for i in range(4)] + [("sparse", i * far) for i in range(5, 13)] + [("long", i * 997) for i in range(100, 1500)]
    assert got == sorted(expected)


def test_spikes_at_edges_and_after_pauses(spark, info):
    """The level before and after a spike lies beyond edges and pauses."""
    rng = np.random.default_rng(5)
    data, spikes_at = [], []
    for label, step in (("daily", 86400), ("slow", 4321), ("fine", 10)):
        t = np.arange(700) * step
        t[350:] += 10 * 500_000
        v = 20 + rng.normal(0, 0.1, 700)
        for i in (8, 64, 128, 347, 352, 460, 690):
            v[i] += 5
            spikes_at.append((label, int(t[i])))
        data += [(label, int(a), 1, float(b)) for a, b in zip(t, v)]
    got = rows(spikes.faulty_readings(readings(spark, data), info).where("kind = 'spike'"), "label", "epoch_s")
    assert got == sorted(spikes_at)


def test_normal_course_decides(spark):
    """A peak that every day has is normal; a day without it is not. Without the principal components it would be the other way round."""
    info = spark.createDataFrame([("c", 900, "m", -1000.0, 1000.0)], INFO)
    rng = np.random.default_rng(3)
    n = 96 * 40
    v = 20 + 10 * np.sin(np.arange(n) % 96 / 96 * 2 * np.pi) + rng.normal(0, 0.1, n)
    v[np.arange(n) % 96 == 30] += 40  # every morning
    v[96 * 17 + 30] -= 40  # but one
    v[96 * 23 + 70] += 6
    df = readings(spark, [("s", i * 900, 1, float(x)) for i, x in enumerate(v)])
    found = lambda: rows(spikes.faulty_readings(df, info), "epoch_s", "kind")
    assert found() == [((96 * 17 + 30) * 900, "spike"), ((96 * 23 + 70) * 900, "spike")]
    cell = np.arange(n)
    shape, sparse = spikes.normal_course(cell, v, 96)
    assert abs(shape[30] - shape[29] - 40) < 2 and not sparse[96 * 5 + 30] and sparse[96 * 17 + 30] and sparse[96 * 23 + 70]
    plain, _ = spikes.spikes_of(v, np.zeros(n, int), np.ones(n, bool))
    assert (plain[30::96] > 30).sum() == 39 and plain[96 * 17 + 30] == 0


def test_faults_of_nothing(spark, info):
    assert spikes.faulty_readings(readings(spark, []), info).count() == 0


def test_robust_pca_parts():
    rng = np.random.default_rng(2)
    low = np.outer(rng.normal(size=20), rng.normal(size=200))
    sparse = np.zeros((20, 200))
    hit = rng.integers(0, 4000, 60)
    sparse.reshape(-1)[hit] = rng.choice([-8, 8], 60)
    a, b = spikes.robust_pca(low + sparse, rounds=100)
    assert np.abs(a - low).max() < 0.3
    assert (np.abs(b.reshape(-1)[hit]) > 5).all()
