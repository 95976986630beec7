"""Frames: ranges with every kind of end, order, conversion, schemas."""

import datetime as dt

import pytest

from tideline.operators import frame as ops
from tideline.operators.frame import Frame
from tideline.operators.trigrams import label_search, trigram_index, trigram_search
from tideline.plans.overshadow import visible
from tideline.store.bounds import Closed
from tideline.store.schema import TYPES, Schema, SchemaColumn, records

X = Schema(x="int*")


@pytest.fixture(scope="module")
def frame(spark):
    return Frame.create(spark, X, {"x": [5, 1, 2, 3, 4, 5, 5, 6]})


@pytest.mark.parametrize("a,b,closed,expected", [(2, 4, "b", [2, 3, 4]), (2, 4, "l", [2, 3]), (2, 4, "r", [3, 4]), (2, 4, "n", [3]), (5, 5, "b", [5, 5, 5]), (5, 5, "l", []), (0, 2, "b", [1, 2]), (None, 3, "l", [1, 2]), (5, None, "n", [6])])
def test_islice(frame, a, b, closed, expected):
    assert frame.islice(a, b, closed)["x"] == expected


@pytest.mark.parametrize("s", [slice(1, None), slice(None, 2), slice(2, 5), slice(-3, None), slice(None, -2), slice(-4, -1), slice(0, 100), slice(5, 2)])
def test_positions(frame, s):
    assert frame.slice(s.start, s.stop)["x"] == [1, 2, 3, 4, 5, 5, 5, 6][s]


def test_misc(frame, spark):
    assert frame[5:]["x"] == [5, 5, 5, 6]
    assert frame.start == (1,) and frame.stop == (6,) and len(frame) == 8 and not frame.empty
    assert not frame.is_sorted() and frame.sorted().is_sorted()
    assert Frame.concat() is None and len(Frame.concat(frame, frame)) == 16
    with pytest.raises(ValueError):
        Frame.concat(frame, frame.rename({"x": "y"}))
    assert frame.rename({"x": "y"}).schema.idx == ["y"] and "x" in frame and frame.keys() == ["x"]
    empty = Frame.create(spark, X, {"x": []})
    assert empty.start is None and empty.empty and empty.is_sorted() and list(ops.paged(empty.df, ["x"], 3)) == []


def test_closed():
    for name, left, right in (("l", True, False), ("RIGHT", False, True), ("both", True, True), ("none", False, False)):
        c = Closed.cast(name)
        assert (c.left, c.right) == (left, right) and Closed.cast(c.word) == Closed.cast(c.word[0]) == c
    with pytest.raises(ValueError):
        Closed.cast("x")


def test_records(spark):
    s = Schema(read_at="timestamp*", day="date", level="float", boats="int")
    df = s.create(spark, {"read_at": [86_400 * 3 + 61, 1_000_000_000], "day": [3, 11_574], "level": [0.25, 7], "boats": [12, 0]})
    assert list(records(df))[0] == {"read_at": dt.datetime(1970, 1, 4, 0, 1, 1), "day": dt.date(1970, 1, 4), "level": 0.25, "boats": 12}
    assert list(records(df, "epoch"))[1] == {"read_at": 1_000_000_000, "day": 11_574 * 86_400, "level": 7.0, "boats": 0}
    assert Frame.from_records(spark, s, list(records(df))) == Frame(df, s)


def test_schema(spark):
    s = Schema("timestamp timestamp*", "value float | delta zstd")
    assert s.idx == ["timestamp"] and s["value"].codecs == ("delta", "zstd") and s.numeric == ["value"]
    assert Schema.loads(s.dumps()) == s and Schema.kv(a="int*").kind == "kv"
    assert list((s @ ["a", "b"])) == ["a", "b"]
    for bad in ({"a": "int"}, {"a": "nope*"}, {"a": ""}):
        with pytest.raises(ValueError):
            Schema(**bad)
    df = spark.createDataFrame([("2020-01-01 10:00:00.9", "7", 1)], "timestamp string, value string, extra int")
    assert tuple(s.cast(df).first()) == (dt.datetime(2020, 1, 1, 10), 7.0)
    assert Schema.from_frame(df, ["timestamp"]).idx == ["timestamp"] and len(Schema.from_frame(df).idx) == 3
    for name in TYPES:
        SchemaColumn("x", name).zero
    with pytest.raises(ValueError):
        s.create(spark, {"timestamp": [1, 2], "value": [1]})


def test_overshadow(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 2, 1), ("a", 9, 1), ("b", 2, 0), (None, 1, 0), ("a", None, 0)], "label string, x int, seq int")
    writes = spark.createDataFrame([("a", 0, None, None, "b"), ("b", 0, None, None, "b"), ("a", 1, 2, 3, "l"), ("b", 2, 2, 2, "n")], "label string, seq int, start int, stop int, closed string")
    assert sorted(tuple(r) for r in visible(rows, writes, "x").collect()) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("b", 2, 0)]


def test_upsert_and_update_edges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (2, "a"), (None, "m")], "k int, v string")
    assert sorted(map(tuple, ops.kv_upsert(a, b, ["k"]).collect()), key=str) == sorted([(1, "x"), (2, "a"), (None, "m")], key=str)
    s = Schema(k="int*", v="str", w="int")
    old = s.create(spark, {"k": [], "v": [], "w": []})
    assert [tuple(r) for r in ops.update_columns(old, spark.createDataFrame([(1, "q")], "k long, v string"), s).collect()] == [(1, "q", 0)]


def test_spans(spark):
    assert [r.timestamp.hour for r in ops.drange(spark, "2020-01-01", "2020-01-01T06:00", "2 hours").collect()] == [0, 2, 4]
    w = [(r.start.day, r.stop.day) for r in ops.windows(spark, "2020-01-01", "2020-01-09", "3 days").collect()]
    assert w == [(1, 4), (4, 7), (7, 9)]


def test_trigrams(spark):
    df = spark.createDataFrame([(1, "Éléphant"), (2, "elegant"), (3, "ab"), (4, None), (5, "")], "k int, t string")
    index = trigram_index(df, "k", "t")
    assert sorted(r.trigram for r in index.where("k = 1").collect()) == sorted(["ele", "lep", "eph", "pha", "han", "ant"])
    assert [r.k for r in trigram_search(index, "k", "ele", "PHANT").collect()] == [1]
    assert trigram_search(index, "k", "ab").count() == 0
    assert [r.k for r in label_search(df, "t", "GANT", "ab").orderBy("k").collect()] == [2, 3]


def test_trigrams_of_any_script(spark):
    """Marks go, characters of two units stay whole, long texts take one pass."""
    from tideline.operators.trigrams import trigram_index, trigram_search

    df = spark.createDataFrame([(1, "Ærø 👩🏽x"), (2, "ŁÓDŹ"), (3, None), (4, "ab"), (5, "Ξένος"), (6, "abc" * 100_000), (7, "e\u0301te")], "k long, t string")
    index = trigram_index(df, "k", "t")
    got = {k: sorted(r.trigram for r in index.where(f"k = {k}").collect()) for k in range(1, 8)}
    assert got[1] == sorted(["ærø", "rø ", "ø 👩", " 👩🏽", "👩🏽x"]) and got[2] == sorted(["łod", "odz"]) and got[3] == got[4] == []
    assert got[5] == sorted(["ξεν", "ενο", "νος"]) and got[6] == ["abc", "bca", "cab"] and got[7] == ["ete"]
    assert [r.k for r in trigram_search(index, "k", "ÉTÉ").collect()] == [7]
