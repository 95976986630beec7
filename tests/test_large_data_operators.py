"""Small files, snapshots, rejected rows: against brute force, with every kind of dirt."""

import csv
import io
import random
import re

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.operators import compaction, rejects, snapshots

MANIFEST = "label string, start long, stop long, digest string, length long, closed string, n_records int"
STORED = "digest string, timestamp long, value double, label string"


def test_compaction(spark):
    manifest = [("a", 0, 9, "f1", 3, "b"), ("a", 0, 9, "f1", 3, "b"), ("a", 10, 19, "f2", None, "l"), ("a", 20, 29, "big", 1, "b"), ("b", 0, 9, "f1", 99, "b"), ("b", 5, 6, "none", 0, "b"), ("c", 0, 9, "f1", 3, "b"), (None, 0, 1, "f1", 1, "b"), ("d", 0, 1, None, 1, "b")]
    stored = [("f1", 1, 1.0), ("f1", 1, 1.0), ("f1", 2, None), ("f1", 3, float("nan")), ("f2", 11, 5.0), ("orphan", 1, 1.0), (None, 1, 1.0), ("f1", None, 2.0)] + [("big", t, 0.5) for t in range(64)]
    m = spark.createDataFrame([(*r, 7) for r in manifest], MANIFEST)
    s = spark.createDataFrame([(*r, "x") for r in stored], STORED)
    done = compaction.compact(m, s)
    assert rows(done.merged, "label", "digest") == [("a", "f1"), ("a", "f2"), ("b", "f1"), ("b", "none")]
    got = [(r.label, r.digest, r.timestamp, None if r.value is None else str(r.value)) for r in done.table.collect()]
    f1 = [(1, "1.0"), (2, None), (3, "nan")]
    assert sorted(got, key=str) == sorted([(x, "f1", t, v) for x in "ab" for t, v in f1] + [("a", "f2", 11, "5.0")], key=str)
    assert rows(done.report) == [("a", 2, 1, 4), ("b", 2, 1, 3)]
    new = done.manifest.collect()
    assert sorted((r.label, r.start, r.stop, r.length, r.closed) for r in new) == [("a", 1, 11, 4, "b"), ("b", 1, 3, 3, "b")]
    assert all(len(r.digest) == 40 and spark.read.parquet(r.path).where(f"label = '{r.label}'").count() == r.length for r in new)


def test_compaction_notices_a_lost_record(spark, monkeypatch):
    """A record that gets lost after the first reading, in the join already, stops the commit."""
    m = spark.createDataFrame([("a", 0, 1, f"d{i}", 1, "b", 0) for i in range(9)], MANIFEST)
    s = spark.createDataFrame([(f"d{i}", t, float(t), "") for i in range(9) for t in range(5)], STORED)
    whole, calls = compaction.held, []

    def leaky(records):
        calls.append(1)
        return whole(records) if len(calls) == 1 else whole(records).where("not (digest = 'd3' and timestamp = 2)")

    monkeypatch.setattr(compaction, "held", leaky)
    with pytest.raises(RuntimeError, match="not committed"):
        compaction.compact(m, s)
    assert len(calls) == 2


def test_compaction_of_nothing(spark):
    done = compaction.compact(spark.createDataFrame([], MANIFEST), spark.createDataFrame([], STORED))
    assert done.merged.count() == 0 and done.table.count() == 0


def test_compaction_hot_label_few_files(spark):
    m = spark.createDataFrame([("hot", 0, 1, f"d{i}", 1, "b", 0) for i in range(400)] + [("cold", 0, 1, f"d{i}", 1, "b", 0) for i in range(3)], MANIFEST)
    s = spark.createDataFrame([(f"d{i}", t, float(t), "") for i in range(400) for t in range(10)], STORED)
    done = compaction.compact(m, s)
    assert done.table.count() == 4030 and done.table.distinct().count() == 4030
    assert len(done.table.inputFiles()) <= 8


SNAP = "snapshot_no int, label string, start long, stop long, digest string, length long, closed string, delivered_at timestamp_ntz, change_kind string"


def test_snapshots_against_dicts(spark):
    import datetime as dt

    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(3)]
    spell_label = lambda x: rng.choice([x, x.upper(), f" {x} "])
    spell_digest = lambda h: h if h is None else rng.choice([h, h.upper(), f"sha1:{h}", h + " "])
    data, held = [], {}
    for no in (1, 2, 4, 7):
        for _ in range(120):
            key = (no, rng.choice(["hot", "hot", "hot", "x", "y"]), rng.randint(0, 25))
            at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=len(data))
            value = (rng.choice([None, 1, 2]), rng.choice([None, *hexes]))
            data.append((key[0], spell_label(key[1]), key[2], value[0], spell_digest(value[1]), rng.choice([None, 5]), "b", at, "?"))
            held[key] = value
    data += [data[0], data[5], (1, None, 1, 1, None, 1, "b", None, "?"), (1, "x", None, 1, None, 1, "b", None, "?"), (None, "x", 1, 1, None, 1, "b", None, "?")]
    rng.shuffle(data)
    got = rows(snapshots.snapshot_changes(spark.createDataFrame(data, SNAP), 3).select("snapshot_no", "label", "start", "change_kind"))
    expected = []
    for old, new in ((1, 2), (2, 4), (4, 7)):
        a, b = ({k[1:]: v for k, v in held.items() if k[0] == n} for n in (old, new))
        for k in a.keys() | b.keys():
            if k not in a:
                expected.append((new, *k, "added"))
            elif k not in b:
                expected.append((new, *k, "removed"))
            elif a[k] != b[k]:
                expected.append((new, *k, "changed"))
    assert got == sorted(expected)


def test_snapshots_in_two_sessions(spark, tmp_path):
    """The index is found again by a session that has never heard of its tables, and what it no longer needs is gone."""
    folder, row = f"file://{tmp_path}", "label string, start long, stop long, digest string"
    snapshot = lambda data: spark.createDataFrame(data, row)
    first = snapshots.SnapshotIndex(spark, folder, 3)
    assert first.load(snapshot([("a", 1, 2, "x"), ("a", 2, 3, None), ("b", 1, None, "z")]), 10).count() == 0
    spark.sql(f"drop table tideline_{first.current['table']}")
    second = snapshots.SnapshotIndex(spark.newSession(), folder, 99)
    assert second.number == 10 and second.buckets == 3
    got = second.load(snapshot([("a", 1, 2, "x"), ("a", 2, 3, "y"), ("c", 1, 1, None)]), 11)
    assert rows(got) == [("a", 2, "changed", 3, None, 3, "y"), ("b", 1, "removed", None, "z", None, None), ("c", 1, "added", None, None, 1, None)]
    tables = [p.name for p in tmp_path.iterdir() if p.name.startswith("snapshot_")]
    assert tables == [second.current["table"]] and not any(t.name.endswith(first.current["table"]) for t in spark.catalog.listTables())
    assert second.load(snapshot([("c", 1, 1, None)]), 12, values=False).count() == 2 and got.count() == 3
    spark.sql(f"drop table tideline_{second.current['table']}")


def test_one_join_for_a_snapshot(spark):
    """Without old values a snapshot costs one join, and the bucketed sides are not shuffled for it."""
    import unittest.mock

    kind = type(spark.range(1))
    plans, write = [], kind.write

    def spy(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return write.fget(self)

    data = [(n, "a", i, i + n, "", 1, "b", None, "?") for n in (1, 2, 3) for i in range(50)]
    with unittest.mock.patch.object(kind, "write", property(spy)):
        assert snapshots.snapshot_changes(spark.createDataFrame(data, SNAP), 3, values=False).count() == 100
    probes = [p for p in plans if "Join" in p]
    assert len(probes) == 2 and all(p.count("ShuffledHashJoin") == 1 and "Exchange" not in p and "Sort " not in p for p in probes)


def test_snapshots_of_nothing(spark):
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


LINES = "file_no long, line_no int, label string, line string, good string"


def reason(header: str, line: str | None) -> str | None:
    """Character by character."""
    if line is None:
        return "columns"
    line = line.rstrip("\r")
    cells, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            text, i = "", i + 1
            while True:
                if i >= n:
                    return "quoting"
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < n and line[i] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return "quoting"
            i = j
        cells.append(text)
        if i >= n:
            break
        i += 1
    names = next(csv.reader(io.StringIO(header.lstrip("﻿"))))
    if not line.strip(" ") or len(cells) != len(names):
        return "columns"
    t, v = (cells[names.index(c)].strip(" ") for c in ("timestamp", "value"))
    import datetime as dt

    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?", t):
        return "timestamp"
    try:
        dt.datetime.fromisoformat(t)
    except ValueError:
        return "timestamp"
    if v.lower() != "nan" and not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", v):
        return "value"
    return None


CELL = st.sampled_from(["2023-02-28", "2023-02-30", "2023-02-28T10:30", "2023-02-28 10:30:59", "2023-02-28  10:30", "2023-02-28T24:00", "1.5", "-.5", "5.", "+1e3", "1e", "nan", "NaN", "inf", "", " 7 ", '"7"', '"a,b"', '"say ""x"""', '"', 'a"b', '""', '"x" ', ' "x"', "ü", "\r", "٣"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(CELL, min_size=1, max_size=4).map(",".join), min_size=40, max_size=60))
def test_rejects_against_characters(spark, lines):
    headers = {1: "timestamp,value", 2: '"value","timestamp"', 3: "﻿category,timestamp,value\r"}
    data = [(f, 1, "x", h, "") for f, h in headers.items()]
    data += [(f, i + 2, "x", line + ("\r" if i % 3 == 0 else ""), "") for f in headers for i, line in enumerate(lines)]
    data += [(f, 999, "x", None, "") for f in headers] + [data[-1]]
    df = spark.createDataFrame(data, LINES)
    got = {(r.file_no, r.line_no): r.reason for r in rejects.rejected(df).collect()}
    expected = {(f, n): why for f, n, _, line, _ in data if n > 1 and (why := reason(headers[f].rstrip("\r"), line))}
    assert got == expected
    assert rejects.loaded(df).count() == len({(f, n) for f, n, *_ in data if n > 1}) - len(expected)


def test_rejects_values_and_missing_header(spark):
    df = spark.createDataFrame([(1, 1, "x", "note,value,timestamp", ""), (1, 2, "x", '"a ""b"", c",1e2,2024-02-29T01:02', ""), (2, 2, "x", "1,2024-01-01", ""), (3, 1, "x", None, ""), (3, 2, "x", "1", ""), (None, 1, "x", "a", "")], LINES)
    ok = rejects.loaded(df).collect()
    assert len(ok) == 1 and ok[0].note == 'a "b", c' and ok[0].value == 100.0 and str(ok[0].timestamp) == "2024-02-29 01:02:00"
    assert rows(rejects.rejected(df), "file_no", "line_no", "reason") == [(2, 2, "columns"), (3, 2, "columns")]
    both = rejects.rejected(spark.createDataFrame([(1, 1, "x", "timestamp,value", ""), (1, 2, "x", "a,b", "")], LINES)).collect()[0]
    assert both.reasons == ["timestamp", "value"]


def test_no_character_is_special(spark):
    """No stand-in for commas: whatever a quoted field holds comes out as it is."""
    odd = '"a\ue0f2b\x00,c\ue0f2"'
    df = spark.createDataFrame([(1, 1, "x", "timestamp,value,note", ""), (1, 2, "x", f"2024-01-01,1,{odd}", ""), (1, 3, "x", "2024-01-01,1,\ue0f2", "")], LINES)
    assert [r.note for r in rejects.loaded(df).orderBy("line_no").collect()] == ["a\ue0f2b\x00,c\ue0f2", "\ue0f2"]


def test_rejects_long_lines(spark):
    df = spark.createDataFrame([(1, 1, "x", "timestamp,value,note", ""), (1, 2, "x", '2024-01-01,1,"' + 'a""' * 200_000 + '"', ""), (1, 3, "x", "2024-01-01,1," + "," * 100_000, "")], LINES)
    assert rows(rejects.rejected(df), "line_no", "reason") == [(3, "columns")]


@pytest.mark.parametrize("f", [rejects.rejected, rejects.loaded])
def test_rejects_of_nothing(spark, f):
    assert f(spark.createDataFrame([], LINES)).count() == 0
