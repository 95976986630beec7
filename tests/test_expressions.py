"""The expression language: constants, columns, grouping, names."""

import datetime as dt
import math

import pytest

from tideline.functions.sexpr import Alias, Compiler, KWargs, evaluate, is_aggregate, names, parse
from tideline.functions.times import pretty_nb
from tideline.operators.frame import Frame
from tideline.store.schema import Schema

TIDES = Schema(timestamp="timestamp*", category="str*", value="int")
DATA = {"timestamp": [7200, 7200, 7200, 90_000, 90_000], "category": ["neap", "spring", "surge", "neap", "surge"], "value": [5, 40, 7, 9, 1]}


@pytest.fixture(scope="module")
def frame(spark):
    return Frame.create(spark, TIDES, DATA)


TRUE = [
    "true", "(~ (and true false))", "(= (+ 4 (- 9 2) (* 3 -1)) 8)", "(= (/ 1 8) 0.125)", "(= (/ 90 9 4) 2.5)", "(or (< 3 2) (>= 3 3))", "(in 'ebb' (list 'flood' 'ebb'))", "(~ (in 4 (list 1 2 3)))",
    "(= (% -11 4) 1)", "(= (% 11 -4) -1)", "(= (- 2.5) -2.5)", "(= (max (list 8 21 13)) 21)", "(= (quantile (list 10 20 30 40) 0.6 'higher') 30)", "(!= 'a' 'b')",
]


@pytest.mark.parametrize("text", TRUE)
def test_true(text):
    assert evaluate(text) is True


@pytest.mark.parametrize("text", ["(2.5)", "('tide')", "(7", "(ebb flood)", "", "()", "(> 3 2 1)", ")", "nowhere", "(floor 'x')", "(false false)"])
def test_malformed(text):
    with pytest.raises(Exception):
        evaluate(text)


def test_constants():
    assert isinstance(evaluate("(kw 'return_index' true)"), KWargs)
    assert evaluate("port", {"port": "Brackholm"}) == "Brackholm"
    assert evaluate("(dict 'low' -2 'high' 15)") == {"low": -2, "high": 15}
    assert evaluate("(unique marks (kw 'return_counts' true))", {"marks": [9, 4, 9, 9]}) == ([4, 9], [1, 3])
    assert evaluate("(unique marks (kw 'return_index' true))", {"marks": [9, 4, 9, 9]}) == ([4, 9], [1, 0])
    assert evaluate("(char.upper ports)", {"ports": ["quay", "Dock"]}) == ["QUAY", "DOCK"]
    assert evaluate("(as (asarray (list 6 5)) 'pair')") == Alias([6, 5], "pair")
    assert evaluate("gauge.upper.mark", {"gauge": {"upper": {"mark": 31}}}) == 31
    assert math.isinf(evaluate("(/ 1 0)")) and math.isnan(evaluate("(/ 0 0)"))
    assert evaluate("(+ 1 2) # a remark") == 3


def test_forms():
    form = parse("(* self.level (+ self.offset (max self.mark)))")
    assert names(form) == ["*", "self.level", "+", "self.offset", "max", "self.mark"]
    assert is_aggregate(form) and not is_aggregate(parse("(- self.min 'min')"))


#: By category (neap, spring, surge) and by day.
GROUPED = {
    "min": ([5, 40, 1], [5, 1]), "max": ([9, 40, 7], [40, 9]), "sum": ([14, 40, 8], [52, 10]), "mean": ([7, 40, 4], [52 / 3, 5]), "average": ([7, 40, 4], [52 / 3, 5]), "first": ([5, 40, 7], [5, 9]),
    "last": ([9, 40, 1], [7, 1]), "count": ([2, 1, 2], [3, 2]), "len": ([2, 1, 2], [3, 2]), "median": ([7, 40, 4], [7, 5]), "quantile": ([7, 40, 4], [7, 5]),
}


@pytest.mark.parametrize("op", GROUPED)
def test_grouped(frame, op):
    by_category, by_day = GROUPED[op]
    assert frame.reduce(category="category", value=f"({op} self.value)")["value"] == pytest.approx(by_category)
    assert frame.reduce(timestamp='(floor self.timestamp "D")', value=f"({op} self.value)")["value"] == pytest.approx(by_day)


def test_global(frame, spark):
    got = frame.reduce(a="(sum self.value)", b="(/ (sum self.value) (count self.value))", c="(quantile self.value 0.4 'nearest')", d="(first self.category)").df.first()
    assert tuple(got) == (62, 12.4, 7.0, "neap")
    none = Frame(frame.df.limit(0), TIDES).reduce(a="(sum self.value)", b="(max self.value)", c="(len self.value)").df.first()
    assert tuple(none) == (0, None, 0)
    nan = Frame.create(spark, Schema(x="int*", v="float"), {"x": [1, 2], "v": [1.0, float("nan")]})
    assert math.isnan(nan.reduce(m="(min self.v)").df.first()[0]) and math.isnan(nan.reduce(m="(max self.v)").df.first()[0])


@pytest.mark.parametrize("how", ["lower", "higher", "midpoint", "nearest"])
@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 1.0])
def test_ranked_quantiles(spark, how, q):
    import random

    import numpy as np

    rng = random.Random(1)
    data = {"k": [rng.choice(["hot", "hot", "hot", "a", None]) for _ in range(500)], "v": [rng.choice([None, 1, 2, 2, 2, rng.random()]) for _ in range(500)]}
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in zip(data["k"], data["v"])], "k string, v double")
    f = Frame(df, Schema(k="str*", v="float"))
    got = {r.k: r.q for r in f.reduce("k", q=f"(quantile self.v {q} '{how}')").df.collect()}
    for k in ("hot", "a", None):
        assert got[k] == np.quantile([float(v) for x, v in zip(data["k"], data["v"]) if x == k and v is not None], q, method=how)
    assert f.reduce(q=f"(+ 1 (quantile self.v {q} '{how}'))").df.first().q == 1 + np.quantile([float(v) for v in data["v"] if v is not None], q, method=how)
    assert Frame(df.limit(0), f.schema).reduce(q=f"(quantile self.v {q} '{how}')").df.first().q is None


def test_projection(frame):
    assert frame == frame.reduce(timestamp="timestamp", category="category", value="value")
    assert sorted(frame.reduce(value="(% self.value 4)")["value"]) == [0, 1, 1, 1, 3]
    assert frame.reduce("timestamp", "value", new="(+ self.value self.timestamp)").sorted("value").df.first().new == dt.datetime(1970, 1, 2, 1, 0, 1)
    assert frame.reduce("(as self.value 'v')").df.columns == ["v"]
    frame.env["twice"] = lambda c: c * 2
    assert sorted(frame.reduce(x="(twice self.value)")["x"]) == [2, 10, 14, 18, 80]
    with pytest.raises(ValueError):
        frame.reduce(x="(+ self.nothing 1)")


def test_ieee(spark):
    f = Frame.create(spark, Schema(k="int*", a="float", b="float"), {"k": [1, 2, 3, 4], "a": [1.0, -1.0, 0.0, 7.0], "b": [0.0, 0.0, 0.0, -3.0]})
    got = [r for r in f.reduce("k", q="(/ self.a self.b)", m="(% self.a self.b)", l="(log self.a)").sorted("k").df.collect()]
    assert got[0].q == math.inf and got[1].q == -math.inf and math.isnan(got[2].q) and got[3].m == -2
    assert math.isnan(got[0].m) and got[2].l == -math.inf and math.isnan(got[1].l)


def test_mask(frame):
    assert sorted(frame.mask("(= (% self.value 3) 1)")["value"]) == [1, 7, 40]
    assert frame.mask([False, True, True, False, True])["value"] == [40, 7, 1]
    assert [r.value for r in frame[[4, 0, 4]].df.collect()] == [1, 5, 1]
    assert sorted(frame.mask("(> self.value limit)", {"limit": 6})["value"]) == [7, 9, 40]
    assert frame.mask("true").df.count() == 5


def test_floor_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(id) as t", "id").write.parquet(str(tmp_path / "t"))
    f = Frame(spark.read.parquet(str(tmp_path / "t")), Schema(t="M8[us]*", id="int")).mask("(= (floor self.t 'D') '2020-01-03')")
    assert "GreaterThanOrEqual(t,2020-01-03" in f.df._jdf.queryExecution().executedPlan().toString() and f["id"] == [2]
    for unit, t, n in (("Y", "2020", 10), ("M", "2020-01", 10), ("D", "2020-01-03T01:00", 0)):
        assert Frame(spark.read.parquet(str(tmp_path / "t")), f.schema).mask(f"(= (floor self.t '{unit}') '{t}')").df.count() == n


@pytest.mark.parametrize("x,text", [(0, "0"), (1, "1.00"), (1234, "1.23k"), (-5e6, "-5.00M"), (0.002, "2.00m"), (999.9, "999.90")])
def test_pretty(spark, x, text):
    assert pretty_nb(x) == text
    assert spark.range(1).select(pretty_nb(__import__("pyspark").sql.functions.lit(float(x)))).first()[0] == text


def test_as_tz_over_the_years(spark):
    from zoneinfo import ZoneInfo

    f = Frame.create(spark, Schema(t="timestamp*"), {"t": [i * 86400 * 37 + 3600 for i in range(600)]})
    for zone in ("Europe/Brussels", "America/New_York", "Asia/Kolkata"):
        for r in f.reduce(t="t", local=f"(as-tz self.t '{zone}')").df.collect():
            assert r.local == r.t.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def test_clock_changes_of_the_session_do_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    data = {"t": ["2023-03-26T02:30:15", "2023-10-29T02:59:59", "1969-12-31T23:59:59"]}
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Brussels")
        f = Frame.create(spark, Schema(t="timestamp*"), data)
        f.env["zero"] = dt.datetime(1970, 1, 1)
        for r in f.reduce("t", secs="(- self.t zero)", back="(+ zero (- self.t zero))", **{u: f"(floor self.t '{u}')" for u in "YMWDhms"}).df.collect():
            assert r.secs == (r.t - dt.datetime(1970, 1, 1)).total_seconds() and r.back == r.t and str(r.t).replace(" ", "T") in data["t"]
            assert (r.Y, r.M, r.D) == (r.t.replace(month=1, day=1, hour=0, minute=0, second=0), r.t.replace(day=1, hour=0, minute=0, second=0), r.t.replace(hour=0, minute=0, second=0))
            assert (r.h, r.m, r.s) == (r.t.replace(minute=0, second=0), r.t.replace(second=0), r.t) and r.W.weekday() == 0 and 0 <= (r.t - r.W).days < 7
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_running(frame, spark):
    f = Frame.create(spark, Schema(x="int*", v="int"), {"x": [3, 1, 2], "v": [30, 10, 20]})
    assert [(r.x, r.c, r.d) for r in f.reduce("x", c="(cumsum self.v)", d="(diff self.v)").sorted("x").df.collect()] == [(1, 10, None), (2, 30, 10), (3, 60, 10)]


def test_compiler_without_frame():
    assert Compiler().eval("(+ 1 (* 2 3))") == 7
