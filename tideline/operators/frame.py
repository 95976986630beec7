"""Operators on sorted, indexed tables: ranges, masks, computed columns, grouped reduction, pages, tails, upserts.

Each is a function from DataFrame to DataFrame without an action, save where its docstring says so; Frame bundles them with a schema. Order is a property
of the index, not of partitions: what depends on it sorts by the index, with the other columns as a tie-break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import arrays
from tideline.functions.sexpr import Alias, Compiler, Quoted, is_aggregate, names, parse
from tideline.plans.shared import written
from tideline.store.bounds import Interval
from tideline.store.schema import Schema, records

#: Entries of a list typed or computed on the driver up to which it is broadcast.
BROADCAST_ROWS = 100_000

# --- ranges and positions


def islice(df: DataFrame, schema: Schema, start: Any = None, stop: Any = None, closed: Any = "l") -> DataFrame:
    """Rows whose index lies in a range; bounds may be a prefix of the index. Rows with a null in a compared index column are in no bounded range."""
    p = Interval.of(schema, start, stop, closed).predicate(schema)
    return df if p is None else df.where(p)


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """Ascending by some columns, then by all others that can be compared, so that the order is the same each time."""
    rest = [f.name for f in df.schema if f.name not in by and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(*(F.col(f"`{c}`") for c in [*by, *rest]))


def slice_rows(df: DataFrame, by: list[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows by position in the order of the index, as a Python slice counts. Only a mixture of a negative and a positive end counts the rows first."""
    start = start or 0
    if start < 0 and stop is None:
        return tail(df, by, -start)
    if start < 0 or (stop is not None and stop < 0):
        n = df.count()
        start = max(0, n + start) if start < 0 else start
        stop = n if stop is None else n + stop if stop < 0 else stop
    out = ordered(df, by).offset(start)
    return out if stop is None else out.limit(max(0, stop - start))


def tail(df: DataFrame, by: list[str], length: int, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The last rows in ascending order; limit and offset count within them."""
    rest = [f.name for f in df.schema if f.name not in by and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    last = df.orderBy(*(F.col(f"`{c}`").desc() for c in [*by, *rest])).limit(length)
    out = last.orderBy(*(F.col(f"`{c}`") for c in [*by, *rest]))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def in_ranges(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows, written once in ranges of their order (see ordered()), with their range in ``_p``. Ranges are cut by all columns, so that rows with equal index values need not lie together."""
    every = order_columns(df, by)
    return written(df.repartitionByRange(*every).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*every), name)


def order_columns(df: DataFrame, by: list[str]) -> list[Column]:
    rest = [f.name for f in df.schema if f.name not in by and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.col(f"`{c}`") for c in [*by, *rest]]


def running(df: DataFrame, by: list[str], wanted: list[tuple[str, Column, str]]) -> DataFrame:
    """Columns over the order of the rows: (kind, value, name) with the kinds cumsum, lag and count (of rows, from 1 on).

    Each range of rows is summed by itself and told what lies before it; of the ranges there is one small row each. No task sees more than its range. Writes one table. A lag is null at the first row; nulls add nothing.
    """
    values = {f"_x{i}": x for i, (_, x, _) in enumerate(wanted)}
    plain = df.columns
    spread = in_ranges(df.withColumns(values), by, "running") if values else in_ranges(df, by, "running")
    spread = spread.withColumn("_o", F.monotonically_increasing_id()) if not by else spread
    order = order_columns(df, by)
    inner, ranges = W.partitionBy("_p").orderBy(*order), W.partitionBy(F.lit(1)).orderBy("_p")  # one row per range
    up_to = inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.struct(*order)
    aggs = []
    for i, (kind, _, _) in enumerate(wanted):
        aggs.append({"cumsum": F.sum(f"_x{i}"), "count": F.count(F.lit(1)), "lag": F.max_by(F.struct(F.col(f"_x{i}").alias("v")), place)}[kind].alias(f"_a{i}"))
    parts = spread.groupBy("_p").agg(*aggs)
    before = ranges.rowsBetween(W.unboundedPreceding, -1)
    told = parts.select("_p", *(F.lag(f"_a{i}").over(ranges).alias(f"_b{i}") if kind == "lag" else F.sum(f"_a{i}").over(before).alias(f"_b{i}") for i, (kind, _, _) in enumerate(wanted)))
    out = spread.join(told, "_p")
    first = F.row_number().over(inner) == 1
    for i, (kind, _, name) in enumerate(wanted):
        x, b = F.col(f"_x{i}"), F.col(f"_b{i}")
        if kind == "lag":
            out = out.withColumn(name, F.when(first, b["v"]).otherwise(F.lag(x).over(inner)))
        else:
            own = F.sum(x).over(up_to) if kind == "cumsum" else F.row_number().over(inner).cast("long")
            out = out.withColumn(name, F.when(own.isNull(), b).otherwise(own + F.coalesce(b, F.lit(0))))
    return out.select(*(F.col(f"`{c}`") for c in plain), *(n for _, _, n in wanted))


class Pages(Iterator[DataFrame]):
    """Pages of at most ``step`` rows, none empty: at the first use the rows are put in order, numbered and written once; a page reads the files that hold it.

    Each page is a plan of its own, for reading one after the other. A union of them has a branch for each; rest() has all in one plan that doesn't grow with their number. ``made``: what becomes of a page's rows.
    """

    def __init__(self, df: DataFrame, by: list[str], step: int, made: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.df, self.by, self.step, self.made = df, by, step, made
        self.next = 0

    @cached_property
    def table(self) -> DataFrame:
        numbered = running(self.df, self.by, [("count", F.lit(1), "_n")]).withColumn("_page", F.floor((F.col("_n") - 1) / self.step))
        return written(numbered.repartitionByRange("_n").sortWithinPartitions("_n"), "pages")

    @cached_property
    def number(self) -> int:
        last = self.table.agg(F.max("_page")).first()[0]
        return 0 if last is None else last + 1

    def __next__(self) -> DataFrame:
        if self.next >= self.number:
            raise StopIteration
        self.next += 1
        return self._rows(F.col("_page") == self.next - 1)

    def rest(self) -> DataFrame:
        """The rows of all pages that are still to come, in their order; none are to come then."""
        first, self.next = self.next, self.number
        return self._rows(F.col("_page") >= first)

    def _rows(self, where: Column) -> DataFrame:
        return self.made(self.table.where(where).orderBy("_n").select(*(F.col(f"`{c}`") for c in self.df.columns)))


def paged(df: DataFrame, by: list[str], step: int) -> Pages:
    """Pages of at most ``step`` rows in the order of the index, see Pages."""
    return Pages(df, by, step)


def page_numbers(df: DataFrame, by: list[str], step: int, within: list[str] | None = None) -> DataFrame:
    """A column ``page`` from 1 on, for writing many pages at once; ``within``: pages of each group for itself. Without groups the rows are numbered range by range, see running()."""
    if not within:
        return running(df, by, [("count", F.lit(1), "_n")]).withColumn("page", F.ceil(F.col("_n") / step).cast("long")).drop("_n")
    rn = F.row_number().over(W.partitionBy(*within).orderBy(*by))
    return df.withColumn("page", F.ceil(rn / step).cast("long"))


def is_sorted(df: DataFrame, by: list[str]) -> DataFrame:
    """One row, column ``is_sorted``: whether rows as stored come in the order of the index. Partitions are compared within and at their borders, none is gathered."""
    key = F.struct(*(F.col(f"`{c}`") for c in by))
    marked = df.select(key.alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    inner = marked.withColumn("before", F.lag("k").over(W.partitionBy("p").orderBy("i")))
    parts = inner.groupBy("p").agg(F.bool_and(F.coalesce(F.col("before") <= F.col("k"), F.lit(True))).alias("ok"), F.min("k").alias("a"), F.max("k").alias("b"))
    w = W.partitionBy(F.lit(1)).orderBy("p")  # one row per partition
    return parts.withColumn("prev", F.lag("b").over(w)).agg(F.coalesce(F.bool_and(F.col("ok") & F.coalesce(F.col("prev") <= F.col("a"), F.lit(True))), F.lit(True)).alias("is_sorted"))


# --- expressions


def reduce_frame(df: DataFrame, order: list[str], columns: list[str] | tuple[str, ...] = (), aliases: dict[str, str] | None = None, env: dict | None = None) -> DataFrame:
    """Computed columns, grouped by those without an aggregate if any has one.

    A column is a name or a ``(...)`` expression; keywords and ``(as ...)`` name it. Without aggregates this is a projection of all rows. Grouped sums, minima and maxima of numbers are floats;
    first and last go by ``order``. Over an empty table a global sum is 0, a count 0, all else null.
    """
    items = [(c, parse(c) if c.lstrip().startswith("(") else ["as", f"self.{c}", Quoted(c)], None) for c in columns]
    items += [(n, parse(e) if e.lstrip().startswith("(") else f"self.{e}", n) for n, e in (aliases or {}).items()]
    own = {n for n, f in (env or {}).items() if getattr(f, "aggregates", False)}
    aggregated = [is_aggregate(form, env) or any(w in own or (w in arrays.AGGREGATES and w not in (env or {})) for w in names(form)) for _, form, _ in items]
    keyed = any(aggregated) and not all(aggregated)
    compiler = Compiler(df, env, order, grouped=keyed)
    compiler.ranked, compiler.running = [], []
    made = []
    for (text, form, alias), agg in zip(items, aggregated):
        value = compiler.eval(form)
        name = alias or text
        if isinstance(value, Alias):
            name, value = alias or value.name, value.value
        made.append((name, compiler.column(value).alias(name), agg))
    if compiler.running:
        df = running(df, order, [(kind, x, f"_r{i}") for i, (kind, x) in enumerate(compiler.running)])
    if not any(aggregated):
        return df.select(*(c for _, c, _ in made))
    keys = [c for _, c, agg in made if not agg]
    for i, (c, q, how) in enumerate(compiler.ranked):
        df = with_quantile(df, keys, c, q, how, f"_q{i}")
    aggs = [c for _, c, agg in made if agg]
    if not keyed:
        return df.agg(*aggs).select(*(f"`{n}`" for n, _, _ in made))
    return df.groupBy(*keys).agg(*aggs).select(*(f"`{n}`" for n, _, _ in made))


def quantile_ranks(df: DataFrame, keys: list[Column], value: Column, q: float, how: str) -> DataFrame:
    """_k0, _k1, ..., _v: the value at a quantile's rank in each group, by linear, lower, higher, midpoint or nearest.

    Values are counted first, then spread by range and numbered within each range; ranges know what lies before them from their counts. So no
    group lies in one task, however large. Nulls are skipped, a NaN is the largest value. Writes one table.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    counted = df.select(*(c.alias(n) for c, n in zip(keys, k)), value.cast("double").alias("_x")).where("_x is not null").groupBy(*k, "_x").agg(F.count(F.lit(1)).alias("_n"))
    spread = written(counted.repartitionByRange(*k, "_x").withColumn("_p", F.spark_partition_id()), "ranks")
    parts = spread.groupBy(*k, "_p").agg(F.sum("_n").alias("_s"))
    by_key = W.partitionBy(*(k or [F.lit(1)]))  # as many rows as partitions
    parts = parts.withColumn("_before", F.sum("_s").over(by_key.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_s")).withColumn("_all", F.sum("_s").over(by_key))
    on = [*k, "_p"]
    right = parts.select(*(F.col(c).alias(f"{c}_r") for c in on), "_before", "_all")
    joined = spread.join(right, fold(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on)))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*on).orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow))
    rank = F.lit(float(q)) * (F.col("_all") - 1)
    low, high = {"lower": (F.floor, F.floor), "higher": (F.ceil, F.ceil), "nearest": (F.rint, F.rint), "midpoint": (F.floor, F.ceil), "linear": (F.floor, F.ceil)}[how]
    at = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")), F.col("_x")))
    out = joined.withColumn("_upto", upto).groupBy(*k).agg(at(low(rank)).alias("_a"), at(high(rank)).alias("_b"), F.max(rank).alias("_rank"))
    up = F.col("_rank") - F.floor("_rank") if how == "linear" else F.lit(0.5)
    between = (1 - up) * F.col("_a") + up * F.col("_b")
    return out.select(*k, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("_v"))


def with_quantile(df: DataFrame, keys: list[Column], value: Column, q: float, how: str, name: str) -> DataFrame:
    """The rows with their group's quantile as a further column."""
    found = quantile_ranks(df, keys, value, q, how)
    if not keys:
        got = found.first()
        return df.withColumn(name, F.lit(got[0] if got else None).cast("double"))
    on = fold(lambda a, b: a & b, (c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)))
    return df.join(found.withColumnRenamed("_v", name), on, "left").select(*df.columns, name)


def aggregate(f):
    """Marks a function of columns as one that turns the rows of a group into one value, so that expressions may call it like ``sum``; it is put into an environment like any other."""
    f.aggregates = True
    return f


def mask(df: DataFrame, expression: str, order: list[str] | None = None, env: dict | None = None) -> DataFrame:
    """Rows for which an expression is true."""
    value = Compiler(df, env, order).eval(parse(expression))
    return df.where(value if isinstance(value, Column) else F.lit(bool(value)))


def take_rows(df: DataFrame, by: list[str], chosen: list) -> DataFrame:
    """Rows by a list of truth values, or of positions (in that order, also repeated), in the order of the index. The list lies on the driver, so no more rows than it tells of are numbered, and those range by range; it is broadcast up to BROADCAST_ROWS entries."""
    if len(chosen) and all(isinstance(x, bool) or type(x).__name__ == "bool_" for x in chosen):
        chosen = [i for i, x in enumerate(chosen) if x]
    chosen = [int(x) for x in chosen]
    want = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(chosen)], "_p0 long, _i long")
    head = ordered(df, by).limit(max(chosen, default=-1) + 1)
    numbered = running(head, by, [("count", F.lit(1), "_n")]).withColumn("_p0", F.col("_n") - 1)
    return numbered.join(F.broadcast(want) if len(chosen) <= BROADCAST_ROWS else want, "_p0").orderBy("_i").drop("_p0", "_i", "_n")


# --- sets


def united(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns in the same order. Put together pair by pair, so that no plan is looked through more than a few times however many there are."""
    while len(frames) > 1:
        frames = [a[0].union(a[1]) if len(a) == 2 else a[0] for a in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def concat(*frames: DataFrame | Pages) -> DataFrame | None:
    """All rows of frames of one schema; ValueError if they differ. Pages come in whole, however many there are."""
    if not frames:
        return None
    frames = [x.rest() if isinstance(x, Pages) else x for x in frames]
    kinds = [[(f.name, f.dataType) for f in x.schema] for x in frames]
    if any(k != kinds[0] for k in kinds):
        raise ValueError("frames differ in their schemas")
    return fold(DataFrame.unionByName, frames)


def kv_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, the first of each key, and the old rows whose key is not among them. Which of equal keys is first goes by the other columns, nulls first."""
    rest = [c for c in new.columns if c not in keys]
    first = new
    if rest:
        first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    else:
        first = new.distinct()
    return first.unionByName(old.join(first.select(*(F.col(k).alias(f"_{k}") for k in keys)), fold(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti"))


def kv_delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Without the rows whose key is among ``keys``."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def update_columns(old: DataFrame, new: DataFrame, schema: Schema) -> DataFrame:
    """``old`` with the columns of ``new`` taken over where the index agrees; rows of ``new`` before the first and after the last old one are added, with zero values where ``new`` has no column.

    ValueError (after two actions) if, between the first and the last old row, index values differ.
    """
    idx = schema.idx
    given = [c for c in new.columns if c not in idx]
    left = old.select("*", F.lit(True).alias("_old"))
    right = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns), F.lit(True).alias("_new"))
    on = fold(lambda a, b: a & b, (F.col(c) == F.col(f"_n_{c}") for c in idx))
    both = left.join(right, on, "full_outer")
    key = F.struct(*(F.coalesce(F.col(c), F.col(f"_n_{c}")).alias(c) for c in idx))
    edges = old.agg(F.min(F.struct(*idx)).alias("a"), F.max(F.struct(*idx)).alias("b")).first()
    apart = F.col("_old").isNotNull()
    if edges.a is not None:
        low, high = (F.struct(*(schema[c].literal(v).alias(c) for c, v in zip(idx, edge))) for edge in (edges.a, edges.b))
        apart = apart | ((key >= low) & (key <= high))
    if not both.where("_old is null or _new is null").where(apart).isEmpty():
        raise ValueError("the update's index differs from the stored one within its range")
    out = []
    for n, c in schema.columns.items():
        if n in idx:
            out.append(F.coalesce(F.col(n), F.col(f"_n_{n}")).alias(n))
        elif n in given:
            out.append(F.when(F.col("_new"), F.col(f"_n_{n}")).otherwise(F.col(n)).alias(n))
        else:
            out.append(F.when(F.col("_old"), F.col(n)).otherwise(c.zero).alias(n))
    return both.select(*out)


def moment(x: Any) -> Column:
    return F.lit(str(x).replace("T", " ")).cast("timestamp_ntz")


def window_start(time: Column, start: Any, days: int) -> Column:
    """Where the span of so many days that a time lies in begins, spans being counted from start; so that times meet windows() by equality."""
    apart = F.timestamp_diff("SECOND", moment(start), time)
    return moment(start) + F.make_dt_interval(days=(F.floor(apart / (days * 86400)) * days).cast("int"))


def drange(spark, start: Any, stop: Any, step: str, name: str = "timestamp") -> DataFrame:
    """Times from start on, a step such as ``1 hour`` apart, before stop."""
    a, b = moment(start), moment(stop)
    return spark.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval {step}"))).alias(name)).where(F.col(name) < b)


def windows(spark, start: Any, stop: Any, step: str) -> DataFrame:
    """Consecutive spans (start, stop) of a step that fill a range; the last is cut."""
    b = F.lit(str(stop).replace("T", " ")).cast("timestamp_ntz")
    begin = drange(spark, start, stop, step, "start")
    return begin.select("start", F.least(F.col("start") + F.expr(f"interval {step}"), b).alias("stop"))


def latest_version(df: DataFrame, time: str, idx: list[str]) -> DataFrame:
    """One row per time: of several rows, that with the largest index."""
    rest = [c for c in df.columns if c != time]
    order = F.struct(*(F.col(c) for c in idx), *(F.col(c) for c in rest if c not in idx))
    return df.groupBy(time).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(time, "_r.*").select(*df.columns)


def natural_period(df: DataFrame, time: str, rows: int = 500_000) -> str:
    """The longest unit of time (Y, M, W, D, h, m) that holds at most ``rows`` rows on average; one action."""
    r = df.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not r.n:
        return "Y"
    seconds = max(1.0, (r.b - r.a).total_seconds())
    for unit, length in (("Y", 365 * 86400), ("M", 30 * 86400), ("W", 7 * 86400), ("D", 86400), ("h", 3600)):
        if r.n * length / seconds <= rows:
            return unit
    return "m"


class Frame:
    """A DataFrame with the schema that says what its index is."""

    def __init__(self, df: DataFrame, schema: Schema | None = None):
        self.df = df
        self.schema = schema or Schema.from_frame(df)
        self.env: dict[str, Any] = {}

    @classmethod
    def create(cls, spark, schema: Schema, data: Any) -> Frame:
        return cls(schema.create(spark, data), schema)

    @classmethod
    def from_records(cls, spark, schema: Schema, rows: list[dict]) -> Frame:
        return cls(schema.create(spark, rows), schema)

    def _with(self, df: DataFrame) -> Frame:
        out = Frame(df, self.schema if df.columns == list(self.schema) else Schema.from_frame(df, [c for c in self.schema.idx if c in df.columns] or None))
        out.env = self.env
        return out

    # projection
    def select(self, *keep: str) -> Frame:
        """The columns kept, in the frame's order; all if none is named."""
        keep = [k for x in keep for k in ([x] if isinstance(x, str) else x)]
        return self._with(self.df.select(*(c for c in self.df.columns if c in keep))) if keep else self

    def drop(self, *columns: str) -> Frame:
        return self._with(self.df.drop(*columns))

    def rename(self, mapping: dict[str, str]) -> Frame:
        out = self.df.withColumnsRenamed(mapping)
        return Frame(out, Schema(kind=self.schema.kind, **{mapping.get(n, n): c for n, c in self.schema.columns.items()}))

    def with_column(self, name: str, value: Any) -> Frame:
        """Adds or replaces a column by a Column, a constant or an expression, cast to its declared type."""
        if isinstance(value, str) and value.lstrip().startswith("("):
            value = Compiler(self.df, self.env, self.schema.idx).eval(parse(value))
        c = value if isinstance(value, Column) else F.lit(value)
        return self._with(self.df.withColumn(name, c.cast(self.schema[name].spark) if name in self.schema.columns else c))

    # rows
    def islice(self, start: Any = None, stop: Any = None, closed: Any = "l") -> Frame:
        return self._with(islice(self.df, self.schema, start, stop, closed))

    def slice(self, start: int | None = None, stop: int | None = None) -> Frame:
        return self._with(slice_rows(self.df, self.schema.idx, start, stop))

    def mask(self, condition: Any, env: dict | None = None) -> Frame:
        if isinstance(condition, str):
            return self._with(mask(self.df, condition, self.schema.idx, {**self.env, **(env or {})}))
        return self._with(self.df.where(condition) if isinstance(condition, Column) else take_rows(self.df, self.schema.idx, list(condition)))

    def tail(self, length: int, limit: int | None = None, offset: int | None = None) -> Frame:
        return self._with(tail(self.df, self.schema.idx, length, limit, offset))

    def sorted(self, *columns: str) -> Frame:
        return self._with(ordered(self.df, [c for x in columns for c in x.split(",")] or self.schema.idx))

    def argsort(self, *columns: str) -> list[int]:
        """Positions of the rows (in the order of the index) in the order of some columns."""
        keys = [c for x in columns for c in x.split(",")]
        numbered = running(self.df, self.schema.idx, [("count", F.lit(1), "_n")])
        return [r[0] - 1 for r in numbered.orderBy(*(F.col(f"`{c}`") for c in keys), "_n").select("_n").toLocalIterator()]

    def is_sorted(self) -> bool:
        return self.df is not None and is_sorted(self.df, self.schema.idx).first()[0]

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, str):
            return [r[0] for r in ordered(self.df, self.schema.idx).select(f"`{key}`").toLocalIterator()]
        if isinstance(key, slice):
            return self.islice(key.start, key.stop)
        if all(isinstance(k, str) for k in key):
            return self._with(self.df.select(*key))
        return self.mask(key)

    # expressions
    def eval(self, expression: str, env: dict | None = None) -> Any:
        return Compiler(self.df, {**self.env, **(env or {})}, self.schema.idx).eval(parse(expression))

    def reduce(self, *columns: str, **aliases: str) -> Frame:
        out = Frame(reduce_frame(self.df, self.schema.idx, columns, aliases, self.env))
        out.env = self.env
        return out

    @staticmethod
    def concat(*frames: Frame) -> Frame | None:
        return Frame(concat(*(f.df for f in frames)), frames[0].schema) if frames else None

    # accessors
    @property
    def start(self) -> tuple | None:
        return self._edge(F.min)

    @property
    def stop(self) -> tuple | None:
        return self._edge(F.max)

    def _edge(self, f) -> tuple | None:
        r = self.df.agg(f(F.struct(*self.schema.idx))).first()[0]
        return tuple(r) if r is not None else None

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self):
        return iter(self.df.columns)

    def __contains__(self, name: str) -> bool:
        return name in self.df.columns

    def keys(self) -> list[str]:
        return self.df.columns

    def get(self, name: str, default: Any = None) -> Any:
        """The values of a column, or the default if there is none."""
        return self[name] if name in self.df.columns else default

    def values(self) -> list[list]:
        return [self[c] for c in self.df.columns]

    def __repr__(self) -> str:
        return f"<Frame {', '.join(f'{c}*' if c in self.schema.idx else c for c in self.df.columns)}>"

    def records(self, style: str | None = "default"):
        return records(ordered(self.df, self.schema.idx), style)

    def __eq__(self, other: Any) -> bool:
        theirs = other.df if isinstance(other, Frame) else self.schema.create(self.df.sparkSession, other)
        mine = self.df.select(*self.schema)
        theirs = self.schema.cast(theirs)
        return mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
