"""Every operator as a query over whole tables, next to the SQL that gives the same."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import times
from tideline.operators import frame as ops
from tideline.operators.frame import Frame
from tideline.operators.trigrams import label_search, trigram_index, trigram_search
from tideline.plans.overshadow import visible
from tideline.plans.shared import new_path
from tideline.sources.transfer import export_collections, import_collections
from tideline.store.repo import Repo
from tideline.store.schema import Schema
from tideline.streaming.sink import write_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENTS = Schema(ts="M8[us]*", value="float", event_id="int", user_id="int", event_type="str")
ORDERS = Schema(o_orderdate="M8[us]*", o_orderkey="int*", o_totalprice="float")
#: Two times, each within a label's rows.
T1, T2 = "2024-01-06 00:00:00", "2024-01-21 12:30:00"
D1, D2 = "1996-03-01", "1998-09-15"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> Frame:
    return Frame(table(spark, d, "events").select("ts", "value", "event_id", "user_id", "event_type"), EVENTS)


def orders(spark, d) -> Frame:
    return Frame(table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), ORDERS)


def items(spark, d) -> Frame:
    return Frame(table(spark, d, "lineitem"), Schema(l_orderkey="int*", l_linenumber="i4*", l_partkey="int", l_suppkey="int", l_quantity="float", l_extendedprice="float", l_discount="float", l_tax="float", l_returnflag="str", l_linestatus="str", l_shipdate="M8[us]"))


def parts(spark, d) -> Frame:
    return Frame(table(spark, d, "part"), Schema(p_partkey="int*", p_name="str", p_brand="str", p_type="str", p_size="i4", p_retailprice="float"))


def new_repo(spark: SparkSession) -> Repo:
    return Repo(spark, new_path(spark, "store"))


# --- ranges, projection, order

for _closed, _low, _high in (("left", ">=", "<"), ("right", ">", "<="), ("both", ">=", "<="), ("none", ">", "<")):
    query(f"select o_orderdate, o_orderkey, o_totalprice from orders where o_orderdate {_low} timestamp '{D1}' and o_orderdate {_high} timestamp '{D2}'", f"range_{_closed}")(lambda spark, d, c=_closed: orders(spark, d).islice(D1, D2, c).df)
    query(
        f"select o_orderdate, o_orderkey, o_totalprice from orders where (o_orderdate > timestamp '{D1}' or (o_orderdate = timestamp '{D1}' and o_orderkey {_low} 500)) and (o_orderdate < timestamp '{D2}' or (o_orderdate = timestamp '{D2}' and o_orderkey {_high} 1000))", f"range_multi_index_{_closed}"
    )(lambda spark, d, c=_closed: orders(spark, d).islice((D1, 500), (D2, 1000), c).df)


@query(f"select ts, value, event_id from events where ts >= timestamp '{T1}'")
def range_open_end(spark, d):
    return events(spark, d).islice(start=T1).select("ts", "value", "event_id").df


@query("select p_partkey, p_name, p_size from part")
def project_select(spark, d):
    return parts(spark, d).select("p_size", "p_name", "p_partkey").df


@query("select p_size, p_partkey from part")
def project_list(spark, d):
    return parts(spark, d)[["p_size", "p_partkey"]].df


@query("select p_partkey, p_name, p_brand, p_size from part")
def project_drop(spark, d):
    return parts(spark, d).drop("p_type", "p_retailprice").df


@query("select p_partkey as id, p_name as name, p_brand, p_type, p_size, p_retailprice from part")
def rename_cols(spark, d):
    return parts(spark, d).rename({"p_partkey": "id", "p_name": "name"}).df


@query("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice * 2 as p_retailprice from part")
def set_column(spark, d):
    return parts(spark, d).with_column("p_retailprice", "(* self.p_retailprice 2)").df


@query("select o_orderdate, o_orderkey, o_totalprice from orders order by o_orderdate, o_orderkey, o_totalprice limit 100 offset 50")
def limit_offset(spark, d):
    return orders(spark, d).slice(50, 150).df


@query("select o_orderdate, o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn > 10 and rn <= 40")
def slice_negative(spark, d):
    return orders(spark, d).slice(-40, -10).df


@query("select ts, event_id, value from (select * from events order by ts desc limit 25)")
def tail_n(spark, d):
    return events(spark, d).tail(25).select("ts", "event_id", "value").df


@query(f"select ts, event_id from (select * from (select * from events where ts < timestamp '{T2}' order by ts desc limit 50) order by ts limit 10 offset 5)")
def tail_range_limit_offset(spark, d):
    return events(spark, d).islice(stop=T2).tail(50, limit=10, offset=5).select("ts", "event_id").df


@query("select event_id, ceil(row_number() over (partition by event_type order by ts) / 100.0)::bigint as page from events")
def page_numbers(spark, d):
    return ops.page_numbers(events(spark, d).df, ["ts"], 100, ["event_type"]).select("event_id", "page")


@query("select event_id, ceil(row_number() over (order by ts) / 300.0)::bigint as page from events")
def page_numbers_all(spark, d):
    return ops.page_numbers(events(spark, d).df, ["ts"], 300).select("event_id", "page")


@query("select event_id, row_number() over (order by value, ts) - 1 as pos, row_number() over (order by ts) - 1 as at from events where event_type = 'error'")
def argsort_values(spark, d):
    e = events(spark, d).mask("(= self.event_type 'error')")
    ids = e["event_id"]
    return spark.createDataFrame([(ids[at], pos, at) for pos, at in enumerate(e.argsort("value"))], "event_id long, pos long, at long")


@query("select event_id, ceil(row_number() over (order by ts) / (select ceil(count(*) / 4.0) from events))::int as page from events")
def paginate_series(spark, d):
    """Four pages by continuation of the index."""
    e = events(spark, d)
    step = -(-e.df.count() // 4)
    pages = [p.select("event_id", F.lit(i + 1).alias("page")) for i, p in enumerate(ops.paged(e.df, ["ts"], step))]
    return ops.concat(*pages)


@query("select s_name, row_number() over (order by s_nationkey, s_acctbal, s_suppkey) as rn from supplier")
def sorted_custom(spark, d):
    from pyspark.sql import Window as W

    df = Frame(table(spark, d, "supplier"), Schema(s_suppkey="int*", s_name="str", s_nationkey="i4", s_acctbal="float")).sorted("s_nationkey", "s_acctbal", "s_suppkey").df
    return df.select("s_name", F.row_number().over(W.orderBy("s_nationkey", "s_acctbal", "s_suppkey")).cast("long").alias("rn"))


@query("select 'by time' as what, true as is_sorted union all select 'backwards', false union all select 'by price', false")
def is_sorted_check(spark, d):
    o, idx = orders(spark, d), ["o_orderdate", "o_orderkey"]
    cases = {"by time": o.sorted().df, "backwards": o.df.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")), "by price": o.sorted("o_totalprice").df}
    return ops.concat(*(ops.is_sorted(df, idx).select(F.lit(what).alias("what"), "is_sorted") for what, df in cases.items()))


@query("select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey, n_name, n_regionkey from nation")
def concat_all(spark, d):
    n = table(spark, d, "nation")
    return ops.concat(n, n)


@query("select p_partkey, p_name from (select *, row_number() over (order by p_partkey) - 1 as rn from part) where rn in (7, 2, 5)")
def mask_positions(spark, d):
    return parts(spark, d)[[7, 2, 5]].select("p_partkey", "p_name").df


# --- masks

MASKS = {
    "mask_arith": ("(> (* self.l_extendedprice (- 1 self.l_discount)) 50000)", "l_extendedprice * (1 - l_discount) > 50000"),
    "mask_mod": ("(= (% self.l_partkey 7) 3)", "l_partkey % 7 = 3"),
    "mask_bool": ("(and (>= self.l_quantity 10) (or (= self.l_returnflag 'R') (< self.l_discount 0.03)))", "l_quantity >= 10 and (l_returnflag = 'R' or l_discount < 0.03)"),
    "mask_isin": ("(in self.l_returnflag (list 'A' 'N'))", "l_returnflag in ('A', 'N')"),
    "mask_numpy_isin": ("(isin self.l_suppkey (list 1 5 7))", "l_suppkey in (1, 5, 7)"),
    "mask_not": ("(~ (= self.l_linestatus 'O'))", "not l_linestatus = 'O'"),
    "mask_compare": ("(and (!= self.l_linenumber 1) (<= self.l_tax 0.04))", "l_linenumber <> 1 and l_tax <= 0.04"),
    "mask_time": ("(>= self.l_shipdate '1997-05-01T00:00')", "l_shipdate >= timestamp '1997-05-01'"),
    "mask_floor_range": ("(= (floor self.l_shipdate 'M') '1997-05')", "date_trunc('month', l_shipdate) = timestamp '1997-05-01'"),
}
for _name, (_expr, _sql) in MASKS.items():
    query(f"select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where {_sql}", _name)(lambda spark, d, e=_expr: items(spark, d).mask(e).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").df)

# --- expressions


@query("select event_id, value + 1 + event_id as a, value - 2.5 as b, -value as c, value * value as d, (event_id % 7 + 7) % 7 as e, ((-event_id) % 7 + 7) % 7 as f, ((event_id % -7) - 7) % -7 as g from events")
def expr_arith(spark, d):
    return events(spark, d).reduce("event_id", a="(+ self.value 1 self.event_id)", b="(- self.value 2.5)", c="(- self.value)", d="(* self.value self.value)", e="(% self.event_id 7)", f="(% (- self.event_id) 7)", g="(% self.event_id (- 7))").df


@query("select l_orderkey, l_linenumber, case when l_discount = 0 then case when l_tax = 0 then 'nan'::double else 'inf'::double end else l_tax / l_discount end as q from lineitem")
def expr_div_zero_ieee(spark, d):
    return items(spark, d).reduce("l_orderkey", "l_linenumber", q="(/ self.l_tax self.l_discount)").df


@query("select p_partkey, round(sqrt(p_retailprice), 6) as a, round(exp(p_size / 50), 6) as b, round(ln(p_retailprice), 6) as c, round(log10(p_retailprice), 6) as d, round(pow(p_size, 2), 6) as e, sign(p_size - 25)::double as f, ceil(p_retailprice)::double as g, greatest(p_size, 20) as h, round(sin(p_size), 6) as i, round(atan2(p_size, 3), 6) as j, round_even(p_retailprice, 0) as k, floor(p_retailprice / 7)::double as l from part")
def expr_math_fns(spark, d):
    r = lambda e: f"(around6 {e})"
    f = parts(spark, d)
    f.env["around6"] = lambda c: F.round(c, 6)
    return f.reduce(
        "p_partkey",
        a=r("(sqrt self.p_retailprice)"),
        b=r("(exp (/ self.p_size 50))"),
        c=r("(log self.p_retailprice)"),
        d=r("(log10 self.p_retailprice)"),
        e=r("(power self.p_size 2)"),
        f="(sign (- self.p_size 25))",
        g="(ceil self.p_retailprice)",
        h="(maximum self.p_size 20)",
        i=r("(sin self.p_size)"),
        j=r("(arctan2 self.p_size 3)"),
        k="(around self.p_retailprice)",
        l="(floor_divide self.p_retailprice 7)",
    ).df


@query("select p_partkey, lower(p_brand) as a, upper(p_name) as b, length(p_name)::bigint as c, instr(p_name, 'ing') - 1 as d, replace(p_name, ' ', '_') as e, starts_with(p_type, 'ECO') as f, p_brand || '/' || p_type as g, trim(p_name) as h, p_brand = 'Brand#2' as i from part")
def expr_string_fns(spark, d):
    return parts(spark, d).reduce("p_partkey", a="(char.lower self.p_brand)", b="(char.upper self.p_name)", c="(char.str_len self.p_name)", d="(char.find self.p_name 'ing')", e="(char.replace self.p_name ' ' '_')", f="(char.startswith self.p_type 'ECO')", g="(+ self.p_brand '/' self.p_type)", h="(char.strip self.p_name)", i="(char.equal self.p_brand 'Brand#2')").df


@query("select p_partkey, case when p_size > 25 then p_retailprice else 0.0 end as a, least(greatest(p_size, 10), 40) as b from part")
def expr_where_clip(spark, d):
    return parts(spark, d).reduce("p_partkey", a="(where (> self.p_size 25) self.p_retailprice 0.0)", b="(clip self.p_size 10 40)").df


@query("select event_id, ts + interval 90 second as a, ts - interval 1 day as b, datediff('second', timestamp '2024-01-01', date_trunc('second', ts)) as c from events")
def expr_time_arith(spark, d):
    f = events(spark, d)
    f.env["start"] = dt.datetime(2024, 1, 1)
    return f.reduce("event_id", a="(+ self.ts 90)", b="(- self.ts 86400)", c="(- (floor self.ts 's') start)").df


for _u, _word in (("Y", "year"), ("M", "month"), ("W", "week"), ("D", "day"), ("h", "hour"), ("m", "minute"), ("s", "second")):
    query(f"select event_id, date_trunc('{_word}', ts)::timestamp as t from events", f"expr_floor_{'min' if _u == 'm' else _u}")(lambda spark, d, u=_u: events(spark, d).reduce("event_id", t=f"(floor self.ts '{u}')").df)


@query("select event_id, timezone('Europe/Brussels', timezone('UTC', ts)) as t from events")
def expr_as_tz(spark, d):
    return events(spark, d).reduce("event_id", t="(as-tz self.ts 'Europe/Brussels')").df


@query("select o_orderkey, case when o_totalprice >= 1e6 then printf('%.2fM', o_totalprice / 1e6) when o_totalprice >= 1e3 then printf('%.2fk', o_totalprice / 1e3) else printf('%.2f', o_totalprice) end as nb from orders")
def expr_pretty_nb(spark, d):
    return orders(spark, d).reduce("o_orderkey", nb="(pretty_nb self.o_totalprice)").df


NUMBERS = {
    "absolute": ("(abs (- self.p_size 25))", "abs(p_size - 25)::double"), "cbrt": ("(cbrt self.p_size)", "cbrt(p_size)"), "square": ("(square self.p_size)", "p_size * p_size"), "exp2": ("(exp2 (/ self.p_size 10))", "pow(2, p_size / 10)"),
    "expm1": ("(expm1 (/ self.p_size 50))", "exp(p_size / 50) - 1"), "log2": ("(log2 self.p_retailprice)", "log2(p_retailprice)"), "log1p": ("(log1p self.p_size)", "ln(1 + p_size)"), "trunc": ("(trunc (/ (- self.p_size 25) 4))", "trunc((p_size - 25) / 4)"),
    "rint": ("(rint (/ self.p_size 4))", "round_even(p_size / 4, 0)"), "cos": ("(cos self.p_size)", "cos(p_size)"), "tan": ("(tan self.p_size)", "tan(p_size)"), "arcsin": ("(arcsin (/ self.p_size 50))", "asin(p_size / 50)"), "arccos": ("(arccos (/ self.p_size 50))", "acos(p_size / 50)"),
    "arctan": ("(arctan self.p_size)", "atan(p_size)"), "sinh": ("(sinh (/ self.p_size 10))", "(exp(p_size / 10) - exp(-p_size / 10)) / 2"), "cosh": ("(cosh (/ self.p_size 10))", "(exp(p_size / 10) + exp(-p_size / 10)) / 2"),
    "tanh": ("(tanh (/ self.p_size 10))", "(exp(p_size / 5) - 1) / (exp(p_size / 5) + 1)"), "degrees": ("(degrees self.p_size)", "degrees(p_size)"), "deg2rad": ("(deg2rad self.p_size)", "radians(p_size)"), "hypot": ("(hypot self.p_size 7)", "sqrt(p_size * p_size + 49)"),
    "mod": ("(mod (- self.p_size 25) 7)", "((p_size - 25) % 7 + 7) % 7"), "fmod": ("(fmod (- self.p_size 25) 7)", "((p_size - 25) % 7)::double"), "minimum": ("(minimum self.p_size 30)", "least(p_size, 30)"), "nan_to_num": ("(nan_to_num (/ (- self.p_size 25) (- self.p_size 25)))", "case when p_size = 25 then 0 else 1 end"),
}


@query("select p_partkey, " + ", ".join(f"round(({sql})::double, 6) as {n}" for n, (_, sql) in NUMBERS.items()) + " from part")
def expr_numeric_registry(spark, d):
    f = parts(spark, d)
    f.env["r6"] = lambda c: F.round(c.cast("double"), 6)
    return f.reduce("p_partkey", **{n: f"(r6 {e})" for n, (e, _) in NUMBERS.items()}).df


@query("""select p_partkey, p_size > 10 and p_size < 40 as a, p_size < 5 or p_size > 45 as b, (p_size > 25) <> (p_partkey % 2 = 0) as c, not p_size > 25 as d, p_size = 7 as e, p_size <> 7 as f, p_size < 7 as g, p_size <= 7 as h, p_size > 7 as i, p_size >= 7 as j,
    false as k, true as l, p_size = 0 as m, true as n, false as o, upper(p_brand[1]) || lower(p_brand[2:]) as p, ends_with(p_name, 't') as q, p_brand <> 'Brand#2' as r, p_name || '.' as s, trim(p_name) as t, p_size not in (3, 5) as u from part""")
def expr_logical_registry(spark, d):
    return parts(spark, d).reduce(
        "p_partkey", a="(logical_and (> self.p_size 10) (< self.p_size 40))", b="(logical_or (< self.p_size 5) (> self.p_size 45))", c="(logical_xor (> self.p_size 25) (= (% self.p_partkey 2) 0))", d="(logical_not (> self.p_size 25))", e="(equal self.p_size 7)",
        f="(not_equal self.p_size 7)", g="(less self.p_size 7)", h="(less_equal self.p_size 7)", i="(greater self.p_size 7)", j="(greater_equal self.p_size 7)", k="(isnan self.p_retailprice)", l="(isfinite self.p_retailprice)", m="(isinf (/ 1 self.p_size))", n="(or true false)",
        o="(and true false)", p="(char.capitalize self.p_brand)", q="(char.endswith self.p_name 't')", r="(char.not_equal self.p_brand 'Brand#2')", s="(char.add self.p_name '.')", t="(char.lstrip (char.rstrip self.p_name))", u="(isin self.p_size (list 3 5) (kw 'invert' true))",
    ).df


@query("select n_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' else 'elsewhere' end as side from nation")
def expr_dict(spark, d):
    """A dictionary made in an expression, handed to a function of the environment by keyword."""
    f = Frame(table(spark, d, "nation"), Schema(n_nationkey="i4*", n_name="str", n_regionkey="i4"))

    def lookup(c, known, otherwise):
        out = F.lit(otherwise)
        for k, v in known.items():
            out = F.when(c == int(k), F.lit(v)).otherwise(out)
        return out

    f.env["lookup"] = lookup
    return f.reduce("n_nationkey", side="(lookup self.n_regionkey (dict '0' 'south' '1' 'west') (kw 'otherwise' 'elsewhere'))").df


@query(f"select event_id from events where ts >= timestamp '{T1}' and ts < timestamp '{T2}'")
def frame_slice(spark, d):
    return events(spark, d)[T1:T2].select("event_id").df


@query("select true as same, false as other")
def frame_equality(spark, d):
    o = orders(spark, d)
    return spark.createDataFrame([(o == o.sorted("o_totalprice"), o == o.slice(1))], "same boolean, other boolean")


@query("select event_id, (isodow(ts) - 1)::int as wd, sha1(event_type) as sha, lpad(lower(printf('%x', epoch_us(ts) // 1000)), 11, '0') as hex, substr(sha1(event_type), 1, 2) || '/' || substr(sha1(event_type), 3, 2) || '/' || substr(sha1(event_type), 5) as path from events")
def expr_helpers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", times.day_of_week_num(F.col("ts")).alias("wd"), times.hexdigest(F.col("event_type")).alias("sha"), times.hextime(F.col("ts")).alias("hex"), times.hashed_path(times.hexdigest(F.col("event_type"))).alias("path"))


@query("select n_nationkey, n_name || '!' as shout from nation")
def udf_env(spark, d):
    f = Frame(table(spark, d, "nation"), Schema(n_nationkey="i4*", n_name="str", n_regionkey="i4"))
    f.env["shout"] = lambda c, mark: F.concat(c, F.lit(mark))
    return f.reduce("n_nationkey", shout="(shout self.n_name '!')").df


@query("select l_returnflag, round(exp(avg(ln(l_quantity))), 6) as geometric, round(sum(l_extendedprice * l_discount) / sum(l_discount), 4) as weighted, count(*) as n from lineitem group by 1")
def udaf_env(spark, d):
    """Aggregates of one's own, by the environment."""
    f = items(spark, d)
    f.env |= {"r": F.round, "geometric": ops.aggregate(lambda c: F.exp(F.avg(F.ln(c)))), "weighted": ops.aggregate(lambda c, w: F.sum(c * w) / F.sum(w))}
    return f.reduce("l_returnflag", geometric="(r (geometric self.l_quantity) 6)", weighted="(r (weighted self.l_extendedprice self.l_discount) 4)", n="(count self.l_quantity)").df


@query("select event_id, (props ->> 'k')::int as k from events")
def json_object_col(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("select event_id, epoch(date_trunc('second', ts))::bigint as ts, epoch(date_trunc('day', ts))::bigint as day from events")
def epoch_records(spark, d):
    from tideline.store.schema import epoch

    e = table(spark, d, "events").select("event_id", F.col("ts"), F.col("ts").cast("date").alias("day"))
    kinds = {f.name: f.dataType for f in e.schema}
    return e.select("event_id", epoch(F.col("ts"), kinds["ts"]).alias("ts"), epoch(F.col("day"), kinds["day"]).alias("day"))


# --- aggregates

GLOBAL = {
    "min": ("(min self.l_extendedprice)", "min(l_extendedprice)"),
    "max": ("(max self.l_shipdate)", "max(l_shipdate)"),
    "sum": ("(sum self.l_partkey)", "sum(l_partkey)::bigint"),
    "mean": ("(mean self.l_quantity)", "avg(l_quantity)"),
    "count": ("(count self.l_quantity)", "count(*)"),
    "len": ("(len self.l_quantity)", "count(*)"),
}
for _name, (_expr, _sql) in GLOBAL.items():
    query(f"select {_sql} as x from lineitem", f"agg_global_{_name}")(lambda spark, d, e=_expr: items(spark, d).reduce(x=e).df)

for _how, _sql in {
    "linear": "quantile_cont(o_totalprice, 0.4)",
    "lower": "list_extract(list(o_totalprice order by o_totalprice), floor(0.4 * (count(*) - 1))::int + 1)",
    "higher": "list_extract(list(o_totalprice order by o_totalprice), ceil(0.4 * (count(*) - 1))::int + 1)",
    "midpoint": "(list_extract(list(o_totalprice order by o_totalprice), floor(0.4 * (count(*) - 1))::int + 1) + list_extract(list(o_totalprice order by o_totalprice), ceil(0.4 * (count(*) - 1))::int + 1)) / 2",
    "nearest": "list_extract(list(o_totalprice order by o_totalprice), round_even(0.4 * (count(*) - 1), 0)::int + 1)",
}.items():
    query(f"select {_sql} as q from orders", f"agg_quantile_{_how}")(lambda spark, d, h=_how: orders(spark, d).reduce(q=f"(quantile self.o_totalprice 0.4 '{h}')").df)


@query("select l_returnflag, l_linestatus, min(l_quantity) as lo, max(l_quantity) as hi, round(sum(l_extendedprice), 2) as total, round(avg(l_discount), 9) as mean, count(*) as n, sum(l_partkey)::double as keys from lineitem group by 1, 2")
def agg_group_all(spark, d):
    f = items(spark, d)
    f.env["r"] = F.round
    return f.reduce("l_returnflag", "l_linestatus", lo="(min self.l_quantity)", hi="(max self.l_quantity)", total="(r (sum self.l_extendedprice) 2)", mean="(r (average self.l_discount) 9)", n="(count self.l_quantity)", keys="(sum self.l_partkey)").df


@query("select user_id, arg_min(event_id, ts) as first_id, arg_max(event_type, ts) as last_type, arg_max(value, ts) as last_value from events group by 1")
def agg_group_first_last(spark, d):
    return events(spark, d).reduce("user_id", first_id="(first self.event_id)", last_type="(last self.event_type)", last_value="(last self.value)").df


@query("select date_trunc('day', ts)::timestamp as ts, max(value) as value, count(*) as n from events where event_type = 'click' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' group by 1")
def agg_floor_group(spark, d):
    return events(spark, d).islice("2024-01-05", "2024-01-25").mask("(= self.event_type 'click')").reduce(ts="(floor self.ts 'D')", value="(max self.value)", n="(len self.value)").df


@query("select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem")
def agg_expr_inside(spark, d):
    f = items(spark, d)
    f.env["r"] = F.round
    return f.reduce(revenue="(r (sum (* self.l_extendedprice (- 1 self.l_discount))) 2)").df


@query("select l_returnflag, round(sum(l_extendedprice) / count(*), 4) as per_item, round(max(l_tax) - min(l_tax), 9) as span from lineitem group by 1")
def agg_expr_over(spark, d):
    f = items(spark, d)
    f.env["r"] = F.round
    return f.reduce("l_returnflag", per_item="(r (/ (sum self.l_extendedprice) (count self.l_tax)) 4)", span="(r (- (max self.l_tax) (min self.l_tax)) 9)").df


@query("select l_returnflag as flag, quantile_cont(l_quantity, 0.9) as q from lineitem group by 1")
def agg_group_quantile(spark, d):
    return items(spark, d).reduce("(as self.l_returnflag 'flag')", q="(quantile self.l_quantity 0.9)").df


@query("select l_returnflag as flag, list_extract(list(l_extendedprice order by l_extendedprice), floor(0.25 * (count(*) - 1))::int + 1) / 2 as half from lineitem group by 1")
def agg_group_quantile_lower(spark, d):
    return items(spark, d).reduce("(as self.l_returnflag 'flag')", half="(/ (quantile self.l_extendedprice 0.25 'lower') 2)").df


@query("select event_type, round(stddev_pop(value), 6) as sd, median(value) as med from events group by 1")
def agg_array_functions(spark, d):
    f = events(spark, d)
    f.env["r"] = F.round
    return f.reduce("event_type", sd="(r (std self.value) 6)", med="(median self.value)").df


@query("select event_type, user_id from events")
def reduce_without_aggregate(spark, d):
    return events(spark, d).reduce("event_type", "user_id").df


@query("select event_id, round(sum(value) over (order by ts), 4) as total, round(value - lag(value) over (order by ts), 9) as step from events")
def running_sum_diff(spark, d):
    f = events(spark, d)
    f.env["r"] = F.round
    return f.reduce("event_id", total="(r (cumsum self.value) 4)", step="(r (diff self.value) 9)").df


@query("select o_orderdate, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def latest_version_per_time(spark, d):
    return ops.latest_version(orders(spark, d).df, "o_orderdate", ["o_orderdate", "o_orderkey"])


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def native_cube(spark, d):
    """What the engine returns is a DataFrame: grouping sets, joins and windows are there as they are."""
    return items(spark, d).df.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select n.n_name, count(*) as n from customer c join nation n on n.n_nationkey = c.c_nationkey group by 1")
def native_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


# --- writes


def event_store(spark, d):
    c = new_repo(spark).create_collection(Schema(ts="M8[us]*", event_id="int*", value="float"), "events")
    c.write(table(spark, d, "events").select(F.col("event_type").alias("label"), "ts", "event_id", "value"))
    return c


def correction(spark, d):
    """Rows of label click strictly inside the span with small values, which come out larger."""
    return table(spark, d, "events").where(f"event_type = 'click' and value < 20 and ts > timestamp_ntz '{T1}' and ts < timestamp_ntz '{T2}'").select("ts", "event_id", (F.col("value") + 1000).alias("value"))


OVERWRITTEN = """select event_type as label, ts, event_id, value from events where not (event_type = 'click' and ts {low} timestamp '{a}' and ts {high} timestamp '{b}')
union all select event_type, ts, event_id, value + 1000 from events where event_type = 'click' and value < 20 and ts > timestamp '{a}' and ts < timestamp '{b}'"""
for _c, _low, _high in (("b", ">=", "<="), ("l", ">=", "<"), ("r", ">", "<="), ("n", ">", "<")):

    def _overwrite(spark, d, closed=_c):
        c = event_store(spark, d)
        (c / "click").write(correction(spark, d), start=T1, stop=T2, closed=closed)
        return c.df()

    query(OVERWRITTEN.format(low=_low, high=_high, a=T1, b=T2), f"write_overwrite_closed_{_c}")(_overwrite)

HISTORY = [("2024-01-03", "2024-01-12", "b"), ("2024-01-08", "2024-01-15", "l"), ("2024-01-01", "2024-01-05", "r"), ("2024-01-11", "2024-01-22", "n"), ("2024-01-14", "2024-01-16", "b")]
_values = ", ".join(f"({i + 1}, timestamp '{a}', timestamp '{b}', '{c}')" for i, (a, b, c) in enumerate(HISTORY))
_inside = "e.ts >= w.a and e.ts <= w.b and (w.c in ('l', 'b') or e.ts > w.a) and (w.c in ('r', 'b') or e.ts < w.b)"
HISTORY_SQL = f"""with w(seq, a, b, c) as (values {_values}),
r as (select event_id, ts, value, 0 as seq from events union all select e.event_id, e.ts, e.value + w.seq * 1000, w.seq from events e join w on {_inside} where e.value > w.seq * 3)
select event_id, ts, value from r e where not exists (select 1 from w where w.seq > e.seq and {_inside})"""


@query(HISTORY_SQL)
def write_history_fold(spark, d):
    """Five overlapping writes to one series, folded into a manifest."""
    e = table(spark, d, "events").select("ts", "event_id", "value")
    s = new_repo(spark).create_collection(Schema(ts="M8[us]*", event_id="int*", value="float"), "c") / "all"
    s.write(e)
    for i, (a, b, closed) in enumerate(HISTORY):
        inside = ops.islice(e, s.schema, a, b, closed).where(F.col("value") > (i + 1) * 3)
        s.write(inside.withColumn("value", F.col("value") + (i + 1) * 1000), start=a, stop=b, closed=closed)
    return s.df()


@query(HISTORY_SQL)
def write_history_relational(spark, d):
    """The same history as one plan over all rows ever written."""
    e = table(spark, d, "events").select(F.lit("all").alias("label"), "ts", "event_id", "value")
    schema = Schema(ts="M8[us]*", event_id="int*", value="float")
    rows = [e.withColumn("seq", F.lit(0))]
    for i, (a, b, closed) in enumerate(HISTORY):
        rows.append(ops.islice(e, schema, a, b, closed).where(F.col("value") > (i + 1) * 3).withColumn("value", F.col("value") + (i + 1) * 1000).withColumn("seq", F.lit(i + 1)))
    writes = spark.createDataFrame([("all", 0, None, None, "b")] + [("all", i + 1, a, b, c) for i, (a, b, c) in enumerate(HISTORY)], "label string, seq int, start string, stop string, closed string")
    writes = writes.select("label", "seq", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "closed")
    return visible(ops.concat(*rows), writes, "ts").select("event_id", "ts", "value")


@query(f"select event_type as label, ts, event_id, value from events where not (event_type = 'click' and ts between timestamp '{T1}' and timestamp '{T2}')")
def delete_range(spark, d):
    c = event_store(spark, d)
    (c / "click").delete(start=T1, stop=T2)
    return c.df()


@query(f"select o_orderdate, o_orderkey, case when o_orderdate between timestamp '{D1}' and timestamp '{D2}' then o_totalprice * 2 else o_totalprice end as o_totalprice, o_orderstatus from orders")
def update_columns(spark, d):
    s = new_repo(spark).create_collection(Schema(o_orderdate="M8[us]*", o_orderkey="int*", o_totalprice="float", o_orderstatus="str"), "c") / "orders"
    s.write(table(spark, d, "orders").select(*s.schema))
    s.update(s.df(D1, D2, closed="b").select("o_orderdate", "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")))
    return s.df()


UPSERT = "select c_custkey, case when c_mktsegment = 'HOUSEHOLD' then c_acctbal + 1 else c_acctbal end as c_acctbal from customer union all select c_custkey + 10000000, c_acctbal from customer where c_acctbal < 0"


def customers(spark, d):
    """Balances, and those that change or are new."""
    c = table(spark, d, "customer")
    changed = c.where("c_mktsegment = 'HOUSEHOLD'").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return c.select("c_custkey", "c_acctbal"), changed.union(c.where("c_acctbal < 0").select(F.col("c_custkey") + 10000000, "c_acctbal"))


@query(UPSERT)
def kv_upsert(spark, d):
    s = new_repo(spark).create_collection(Schema.kv(c_custkey="int*", c_acctbal="float"), "c") / "customers"
    base, new = customers(spark, d)
    s.write(base)
    s.write(new)
    return s.df()


@query(UPSERT)
def kv_upsert_relational(spark, d):
    return ops.kv_upsert(*customers(spark, d), ["c_custkey"])


@query("select c_custkey, c_acctbal from customer where c_custkey not in (5, 17, 100)")
def kv_delete_keys(spark, d):
    s = new_repo(spark).create_collection(Schema.kv(c_custkey="int*", c_acctbal="float"), "c") / "customers"
    s.write(table(spark, d, "customer").select("c_custkey", "c_acctbal"))
    s.delete(5, 17, 100)
    return s.df()


@query("select c_custkey, c_name from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def kv_delete_by_table(spark, d):
    keys = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return ops.kv_delete(table(spark, d, "customer"), keys, ["c_nationkey"]).select("c_custkey", "c_name")


@query("select event_type as label, ts, event_id, value from events where event_type = 'click'")
def time_travel(spark, d):
    c = event_store(spark, d)
    s = c / "click"
    after = s.delete(start=T1, stop=T2)[0]
    return s.df(before=after.child).select(F.lit("click").alias("label"), "ts", "event_id", "value")


MERGED = f"""select ts, event_id, value + 1 as value from events where ts >= timestamp '{T1}'
union all select ts, event_id, value from events where ts < timestamp '{T1}'"""


@query(MERGED)
def merge_branches(spark, d):
    """Two branches from the root; the newer one covers the later part."""
    e = table(spark, d, "events").select("ts", "event_id", "value")
    s = new_repo(spark).create_collection(Schema(ts="M8[us]*", event_id="int*", value="float"), "c") / "x"
    s.write(e.where(f"ts < timestamp_ntz '{T2}'"))
    s.write(e.where(f"ts >= timestamp_ntz '{T1}'").withColumn("value", F.col("value") + 1), root=True)
    s.collection.merge()
    return s.df()


@query(MERGED)
def push_pull_merge(spark, d):
    """Two stores write apart, a third pulls and merges."""
    e = table(spark, d, "events").select("ts", "event_id", "value")
    schema = Schema(ts="M8[us]*", event_id="int*", value="float")
    a, b, central = (new_repo(spark) for _ in range(3))
    (a.create_collection(schema, "c") / "x").write(e.where(f"ts < timestamp_ntz '{T2}'"))
    (b.create_collection(schema, "c") / "x").write(e.where(f"ts >= timestamp_ntz '{T1}'").withColumn("value", F.col("value") + 1))
    central.pull(a)
    b.push(central, "c", shallow=True)
    c = central.collection("c")
    c.merge()
    return (c / "x").df()


@query("select s_suppkey, s_name as name, s_acctbal, 5 as rating, '' as remark from supplier")
def clone_schema(spark, d):
    repo = new_repo(spark)
    c = repo.create_collection(Schema(s_suppkey="int*", s_name="str", s_nationkey="i4", s_acctbal="float"), "old")
    (c / "x").write(table(spark, d, "supplier"))
    to = repo.create_collection(Schema(s_suppkey="int*", name="str", s_acctbal="float", rating="i4", remark="str"), "new")
    c.clone(to, {"s_name": "name"}, {"rating": 5})
    return (to / "x").df()


@query("select case when event_type = 'click' then 'view' else event_type end as label, event_id from events e where event_type <> 'view' or ts < (select min(ts) from events where event_type = 'click') or ts > (select max(ts) from events where event_type = 'click')")
def rename_series(spark, d):
    c = event_store(spark, d)
    c.rename("click", "view")
    return c.df().select("label", "event_id")


@query("select event_type as label, event_id, value from events")
def multi_write(spark, d):
    """A write per label, one revision."""
    e = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    c = new_repo(spark).create_collection(Schema(ts="M8[us]*", event_id="int*", value="float"), "c")
    with c.multi():
        for label in [r[0] for r in e.select("event_type").distinct().collect()]:
            (c / label).write(e.where(F.col("event_type") == label).drop("event_type"))
    assert len(c.changelog.log()) == 1
    return c.df().select("label", "event_id", "value")


@query("select event_type as label, count(*) as n, true as there, false as gone from events group by 1")
def series_len_bool(spark, d):
    c = event_store(spark, d)
    return spark.createDataFrame([(s.label, len(s), bool(s), bool(c / f"{s.label} of old")) for s in c], "label string, n long, there boolean, gone boolean")


@query("select distinct event_type as label from events")
def labels_distinct(spark, d):
    return spark.createDataFrame([(x,) for x in event_store(spark, d).ls()], "label string")


@query("select event_type as label, count(*) as n from events group by 1")
def collection_len(spark, d):
    return event_store(spark, d).df().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"select ts, event_id from events where event_type = 'error' and ts >= timestamp '{T1}' and ts < timestamp '{T2}'")
def series_range_read(spark, d):
    return (event_store(spark, d) / "error").df(T1, T2, select=["ts", "event_id"])


@query("select ts, event_id, value from (select * from events where event_type = 'error' order by ts desc limit 20) order by ts limit 8 offset 4")
def series_tail(spark, d):
    return (event_store(spark, d) / "error").tail(20, limit=8, offset=4)


@query("select ts, event_id, value from events where event_type = 'error'")
def series_paginate(spark, d):
    return ops.concat((event_store(spark, d) / "error").paginate(700))


@query("select ts, event_id, value from events")
def defrag_series(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", "value")
    s = new_repo(spark).create_collection(Schema(ts="M8[us]*", event_id="int*", value="float"), "c") / "x"
    days = ["2024-01-01", "2024-01-04", "2024-01-08", "2024-01-12", "2024-01-16", "2024-01-20", "2100-01-01"]
    for a, b in zip(days, days[1:]):
        s.write(e.where(f"ts >= timestamp_ntz '{a}' and ts < timestamp_ntz '{b}'"), start=a, stop=b, closed="l")
    s.collection.squash()
    s.repo.gc(timeout=0)
    s.repo.gc(timeout=0)
    return s.df()


@query("select ts, event_id, value, 1 as tables_left, 1 as tables_removed from events")
def gc_orphans(spark, d):
    """A series that was written over whole, after garbage collection: all of its rows, the tables that remain and those that went."""
    c = event_store(spark, d)
    with c.multi():
        for label in c.ls():
            (c / label).delete()
    (c / "one").write(table(spark, d, "events").select("ts", "event_id", "value"))
    c.trim(dt.datetime(2100, 1, 1))
    c.repo.gc(timeout=0)
    removed, _ = c.repo.gc(timeout=0)
    return (c / "one").df().select("*", F.lit(len(c.repo.files.ls("data"))).alias("tables_left"), F.lit(removed).alias("tables_removed"))


@query("select event_type as label, event_id from events where event_type <> 'click'")
def collection_delete(spark, d):
    c = event_store(spark, d)
    c.delete("click")
    return c.df().select("label", "event_id")


@query("select event_type as label, ts, event_id, value from events")
def pull_missing(spark, d):
    """A store that has an older state pulls what it lacks, and nothing twice."""
    a, b = event_store(spark, d), new_repo(spark)
    b.pull(a.repo)
    have = set(b.files.ls("data"))
    (a / "late").write(table(spark, d, "events").select("ts", "event_id", "value"))
    b.pull(a.repo)
    assert len(set(b.files.ls("data")) - have) == 1 and b.collection("events").pull(a) == 0
    b.collection("events").delete("late")
    return b.collection("events").df()


CATALOG = "select * from (values ('collection', 'kept'), ('collection', 'new name'), ('archive', 'put away'), ('collection', 'from the other branch')) t(namespace, label)"


@query(CATALOG)
def repo_catalog(spark, d):
    """Collections made, renamed, archived, deleted and merged from two branches of the registry."""
    schema = Schema(k="int*")
    repo = new_repo(spark)
    repo.create_collection(schema, "kept", "old name", "put away", "gone")
    base = repo.registry.leaf()
    repo.rename("old name", "new name")
    repo.archive("put away")
    repo.delete("gone")
    other = Repo(spark, repo.files.root)
    known = other._catalog_at(base)
    known["collection"]["from the other branch"] = known["collection"]["kept"]
    other.registry.commit(json.dumps(known), [base.child])
    repo.merge()
    return spark.createDataFrame([(n, x) for n in ("collection", "archive") for x in repo.ls(n)], "namespace string, label string")


@query("select c_custkey, c_acctbal + case when c_mktsegment = 'BUILDING' then 3 when c_mktsegment = 'MACHINERY' then 2 else 0 end as c_acctbal from customer")
def kv_upserts_in_one_block(spark, d):
    """Overlapping upserts of one block: the second goes over what the first has changed."""
    c = table(spark, d, "customer")
    s = new_repo(spark).create_collection(Schema.kv(c_custkey="int*", c_acctbal="float"), "c") / "customers"
    s.write(c.select("c_custkey", "c_acctbal"))
    raised = lambda segments, by: c.where(F.col("c_mktsegment").isin(segments)).select("c_custkey", (F.col("c_acctbal") + by).alias("c_acctbal"))
    with s.collection.multi():
        s.write(raised(["BUILDING", "MACHINERY"], 2))
        s.write(raised(["BUILDING"], 3))
    return s.df()


for _kind in ("csv", "parquet"):

    def _transfer(spark, d, kind=_kind):
        c = event_store(spark, d)
        folder = new_path(spark, "export")
        export_collections(c.repo, folder, kind=kind)
        target = new_repo(spark)
        import_collections(target, folder)
        return target.collection("events").df()

    query("select event_type as label, ts, event_id, value from events", f"export_import_{_kind}")(_transfer)


@query("select n_nationkey, n_name from nation")
def from_records(spark, d):
    rows = [r.asDict() for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()]  # 25 nations
    return Frame.from_records(spark, Schema(n_nationkey="i4*", n_name="str"), rows).df


@query("select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31' - interval 6 hour, interval 6 hour)) as timestamp")
def drange_spine(spark, d):
    return ops.drange(spark, "2024-01-01", "2024-01-31", "6 hours")


@query("with s as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 7 day)) as start) select start, least(start + interval 7 day, timestamp '2024-01-31') as stop, count(event_id) as n from s left join events on ts >= start and ts < least(start + interval 7 day, timestamp '2024-01-31') group by 1, 2")
def interval_windows(spark, d):
    w = ops.windows(spark, "2024-01-01", "2024-01-31", "7 days")
    e = table(spark, d, "events").where("ts < timestamp_ntz '2024-01-31'").groupBy(ops.window_start(F.col("ts"), "2024-01-01", 7).alias("start")).agg(F.count("event_id").alias("n"))
    return w.join(e, "start", "left").select("start", "stop", F.coalesce("n", F.lit(0)).alias("n"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_name), 'ring')")
def label_search_parts(spark, d):
    return label_search(table(spark, d, "part"), "p_name", "RED", "ring").select("p_partkey", "p_name")


TRIGRAMS = "with p as (select p_partkey, translate(lower(p_name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') as t from part), x as (select p_partkey, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) as trigram from p)"


@query(f"{TRIGRAMS} select distinct trigram, p_partkey from x where length(trigram) = 3")
def trigram_index_parts(spark, d):
    return trigram_index(table(spark, d, "part"), "p_partkey", "p_name")


@query(f"{TRIGRAMS} select p_partkey from x where trigram in ('wid', 'idg', 'dge', 'get') group by 1 having count(distinct trigram) = 4")
def trigram_search_parts(spark, d):
    return trigram_search(trigram_index(table(spark, d, "part"), "p_partkey", "p_name"), "p_partkey", "widget")


@query("select event_type as label, event_id, value + case when event_id % 4 = 0 then 0.5 else 0 end as value from events")
def stream_into_series(spark, d):
    """The events as a stream of five files, each a micro-batch and a revision, which interleave in time; the last corrects a quarter of the rows."""
    source = table(spark, d, "events").select(F.col("event_type").alias("label"), "ts", "event_id", "value")
    folder = new_path(spark, "incoming")
    for i in range(4):
        source.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(folder)
    source.where("event_id % 4 = 0").withColumn("value", F.col("value") + 0.5).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("label string, ts timestamp_ntz, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(folder)
    c = new_repo(spark).create_collection(Schema(ts="M8[us]*", event_id="int*", value="float"), "c")
    q = write_stream(stream, c, new_path(spark, "stream-checkpoint"), f"q{new_path(spark, 'x')[-8:]}")
    q.awaitTermination()
    c.refresh()
    assert len(c.changelog.log()) == 5
    return c.df().select("label", "event_id", "value")


PAGES = "with p as (select doc_id, strip_accents(lower(text)) as t from documents), x as (select distinct doc_id, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) as trigram from p)"


@query(f"{PAGES} select trigram, count(*) as pages from x where length(trigram) = 3 group by 1")
def trigram_index_documents(spark, d):
    """How many pages hold each trigram: the whole inverted index of whole texts, counted."""
    return trigram_index(table(spark, d, "documents"), "doc_id", "text").groupBy("trigram").agg(F.count(F.lit(1)).alias("pages"))


@query(f"{PAGES} select doc_id from x where trigram in ('har', 'arb', 'rbo', 'bou', 'our', 'fré', 'fre') group by 1 having count(distinct trigram) = 6")
def trigram_search_documents(spark, d):
    return trigram_search(trigram_index(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "Harbour", "Fré")


@query("select case when 30 * 86400 <= epoch(max(ts)) - epoch(min(ts)) then 'M' when 7 * 86400 <= epoch(max(ts)) - epoch(min(ts)) then 'W' else 'D' end as unit from events")
def natural_period(spark, d):
    """The unit of time whose pages suit the events."""
    e = table(spark, d, "events")
    return spark.createDataFrame([(ops.natural_period(e.select("ts"), "ts", e.count()),)], "unit string")
