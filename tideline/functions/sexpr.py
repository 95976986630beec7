"""Parenthesised expressions such as ``(sum (* self.price self.quantity))``, compiled to Spark columns.

Literals fold at compile time; anything that touches a column becomes a Column, so that filters reach the scan and everything
stays in generated code. Arithmetic follows IEEE and array conventions where SQL differs: division by zero gives infinities or NaN, the
remainder has the divisor's sign, and the minimum of values with a NaN is NaN.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import arrays, times

TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<paren>[()])|(?P<text>"[^"]*"|'[^']*')|(?P<word>[^\s()"'#]+)""")
INTERPOLATIONS = ("linear", "lower", "higher", "midpoint", "nearest")
AGGREGATES = ("min", "max", "sum", "first", "last", "mean", "average", "quantile", "count", "len")


def parse(text: str) -> Any:
    """The first form of a text: a word, a Quoted, or a list of forms. Closing parentheses at the end may be missing."""
    stack: list[list] = [[]]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        at = m.end()
        if m["paren"] == "(":
            stack.append([])
        elif m["paren"] == ")":
            if len(stack) == 1:
                raise ValueError(f"unexpected ')' in {text!r}")
            done = stack.pop()
            stack[-1].append(done)
        elif m["text"]:
            stack[-1].append(Quoted(m["text"][1:-1]))
        elif m["word"]:
            stack[-1].append(m["word"])
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    if not stack[0]:
        raise ValueError("empty expression")
    return stack[0][0]


class Quoted(str):
    """A text in quotes, as opposed to a name."""


@dataclass
class Alias:
    value: Any
    name: str


@dataclass
class KWargs:
    values: dict


class Frames:
    """What ``self`` stands for: a DataFrame's columns."""

    def __init__(self, df: DataFrame):
        self.df = df

    def column(self, name: str) -> Column:
        if name not in self.df.columns:
            raise ValueError(f"unknown column {name!r}")
        return F.col(f"`{name}`")


def is_aggregate(form: Any, env: dict | None = None) -> bool:
    """Whether an aggregate occurs anywhere in a form."""
    if isinstance(form, list):
        return any(is_aggregate(x, env) for x in form)
    return not isinstance(form, Quoted) and form in AGGREGATES and form not in (env or {})


def names(form: Any) -> list[str]:
    """Every word of a form, at any depth."""
    if isinstance(form, list):
        return [w for x in form for w in names(x)]
    return [] if isinstance(form, Quoted) else [form]


class Compiler:
    """Evaluates forms for one DataFrame. ``order``: the columns by which first and last are decided; ``grouped``: sums and extremes of numbers come out as floats."""

    def __init__(self, df: DataFrame | None = None, env: dict[str, Any] | None = None, order: list[str] | None = None, grouped: bool = False):
        self.df, self.order, self.grouped = df, order or [], grouped
        #: What a caller that reduces frames works out beforehand: (value, quantile, interpolation) and (kind, value) by position.
        self.ranked: list[tuple[Column, float, str]] | None = None
        self.running: list[tuple[str, Column]] | None = None
        self.env: dict[str, Any] = {**FUNCTIONS, **(env or {})}
        if df is not None:
            self.env.setdefault("self", Frames(df))

    def eval(self, form: Any) -> Any:
        if isinstance(form, str) and not isinstance(form, Quoted) and form.lstrip()[:1] in ("(", '"', "'"):
            form = parse(form)
        if not isinstance(form, list):
            return self.resolve(form)
        if not form:
            raise ValueError("empty form")
        head = form[0]
        if isinstance(head, list) or isinstance(head, Quoted):
            raise ValueError(f"not a function: {head!r}")
        args = [self.eval(x) for x in form[1:]]
        kw: dict = {}
        for a in args:
            if isinstance(a, KWargs):
                kw |= a.values
        args = [a for a in args if not isinstance(a, KWargs)]
        if head in BUILTINS:
            if isinstance(BUILTINS[head], bool):
                raise ValueError(f"not a function: {head!r}")
            return BUILTINS[head](self, *args, **kw)
        if head in AGGREGATES:
            return self.aggregate(head, *args, **kw)
        f = self.resolve(head)
        if not callable(f) or isinstance(f, Column):
            raise ValueError(f"not a function: {head!r}")
        return f(self, *args, **kw) if getattr(f, "compiled", False) else f(*args, **kw)

    def resolve(self, word: str) -> Any:
        """Constant, number, quoted text, or a name of the environment with dots for members."""
        if isinstance(word, Quoted):
            return str(word)
        if word in ("true", "false"):
            return word == "true"
        for number in (int, float):
            try:
                return number(word)
            except ValueError:
                pass
        if word in self.env:
            return self.env[word]
        first, *rest = word.split(".")
        if first in self.env:
            value = self.env[first]
            for i, part in enumerate(rest):
                if isinstance(value, Frames):
                    return value.column(".".join(rest[i:]))
                if isinstance(value, DataFrame):
                    return value[part]
                value = value[part] if isinstance(value, dict) and part in value else getattr(value, part)
            return value
        raise ValueError(f"unknown name {word!r}")

    def type(self, x: Any) -> T.DataType | None:
        if isinstance(x, Column):
            return self.df.select(x.alias("x")).schema[0].dataType if self.df is not None else None
        return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(x), T.TimestampNTZType() if isinstance(x, dt.datetime) else T.DateType() if isinstance(x, dt.date) else None)

    def column(self, x: Any) -> Column:
        if isinstance(x, Column):
            return x
        if isinstance(x, dt.datetime):
            return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
        if isinstance(x, list):
            return F.array(*(self.column(v) for v in x))
        return F.lit(x)

    def quantile(self, c: Column, q: float = 0.5, interpolation: str = "linear") -> Column:
        """Quantile of the values that are no null; between two neighbours by the named rule. Values are found by rank, which is left to the caller; without one a linear quantile holds a group's different values in one task."""
        if interpolation not in INTERPOLATIONS:
            raise ValueError(f"interpolation must be one of {', '.join(INTERPOLATIONS)}")
        if self.ranked is None and interpolation == "linear":
            return F.percentile(c.cast("double"), F.lit(float(q)))
        if self.ranked is None:
            raise ValueError(f"a quantile with interpolation {interpolation} needs a frame to reduce")
        self.ranked.append((c, q, interpolation))
        self.df = self.df.withColumn(f"_q{len(self.ranked) - 1}", F.lit(None).cast("double"))  # so that types can be found
        return F.max(f"_q{len(self.ranked) - 1}")

    def aggregate(self, name: str, *args: Any, **kw: Any) -> Any:
        if not args:
            if name in ("count", "len"):
                return F.count(F.lit(1))
            raise ValueError(f"{name} needs an argument")
        arg = args[0]
        if not isinstance(arg, Column):  # over a list of constants
            return plain(name, arg, *args[1:], **kw)
        kind = self.type(arg)
        number = isinstance(kind, T.NumericType)
        wide = arg.cast("double") if number and self.grouped else arg
        if name in ("count", "len"):
            return F.count(F.lit(1))
        if name == "sum":
            return F.coalesce(F.sum(wide), F.lit(0).cast("double" if self.grouped or not isinstance(kind, T.IntegralType) else "long"))
        if name in ("mean", "average"):
            return F.avg(arg)
        if name in ("max", "min"):
            if name == "max":
                return F.max(wide)
            if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
                return F.when(F.bool_or(F.isnan(arg)), F.lit(float("nan"))).otherwise(F.min(wide))
            return F.min(wide)
        if name in ("first", "last"):
            by = F.struct(*(F.col(f"`{c}`") for c in self.order), arg)
            return F.min_by(arg, by) if name == "first" else F.max_by(arg, by)
        return self.quantile(arg, *args[1:], **kw)


def plain(name: str, values: Any, *rest: Any, **kw: Any) -> Any:
    values = list(values)
    if name in ("count", "len"):
        return len(values)
    if name == "quantile":
        q = rest[0] if rest else kw.get("q", 0.5)
        how = rest[1] if len(rest) > 1 else kw.get("interpolation", "linear")
        s, r = sorted(values), q * (len(values) - 1)
        lo, hi = s[math.floor(r)], s[math.ceil(r)]
        return {"linear": lo + (hi - lo) * (r - math.floor(r)), "lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": s[round(r)]}[how]
    if name in ("first", "last"):
        return values[0 if name == "first" else -1]
    if name in ("mean", "average"):
        return sum(values) / len(values)
    return {"min": min, "max": max, "sum": sum}[name](values)


# --- operators


def folded(one: Callable) -> Callable:
    def f(self: Compiler, *args: Any) -> Any:
        if not args:
            raise ValueError("an operator needs arguments")
        return reduce(lambda a, b: one(self, a, b), args)

    return f


def is_time(kind: Any) -> bool:
    return isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType))


def add(self: Compiler, a: Any, b: Any) -> Any:
    if not isinstance(a, Column) and not isinstance(b, Column):
        return a + b
    ka, kb = self.type(a), self.type(b)
    if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
        return F.concat(self.column(a), self.column(b))
    if is_time(kb) and not is_time(ka):
        a, b, ka, kb = b, a, kb, ka
    if is_time(ka):
        return moved(self.column(a), ka, self.column(b))
    return self.column(a) + self.column(b)


def moved(c: Column, kind: Any, by: Column) -> Column:
    """A time some seconds later, a date some days later."""
    if isinstance(kind, T.DateType):
        return F.date_add(c, by.cast("int"))
    return c + F.make_dt_interval(secs=by.cast("decimal(18,6)"))


def subtract(self: Compiler, a: Any, b: Any) -> Any:
    if not isinstance(a, Column) and not isinstance(b, Column):
        return a - b
    ka, kb = self.type(a), self.type(b)
    ca, cb = self.column(a), self.column(b)
    if is_time(ka) and is_time(kb):
        if isinstance(ka, T.DateType) and isinstance(kb, T.DateType):
            return F.date_diff(ca, cb).cast("long")
        return times.elapsed(cb, ca)
    if is_time(ka):
        return moved(ca, ka, -cb)
    return ca - cb


def minus(self: Compiler, *args: Any) -> Any:
    if len(args) == 1:
        return -args[0]
    return folded(subtract)(self, *args)


def times_(self: Compiler, a: Any, b: Any) -> Any:
    return a * b


def divide(self: Compiler, a: Any, b: Any) -> Any:
    if not isinstance(a, Column) and not isinstance(b, Column):
        if b:
            return a / b
        return math.nan if not a or a != a else math.copysign(math.inf, a)
    a, b = self.column(a).cast("double"), self.column(b).cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def remainder(self: Compiler, a: Any, b: Any) -> Any:
    """Has the sign of the divisor; of a division by zero 0 for whole numbers, NaN for others."""
    if not isinstance(a, Column) and not isinstance(b, Column):
        return a % b
    whole = isinstance(self.type(a), T.IntegralType) and isinstance(self.type(b), T.IntegralType)
    a, b = self.column(a), self.column(b)
    safe = F.when(b != 0, b)
    if not whole:
        a, safe = a.cast("double"), safe.cast("double")
    return F.when(b == 0, F.lit(0) if whole else F.lit(math.nan)).otherwise(((a % safe) + safe) % safe)


def both(op: str, bits: str) -> Callable:
    def f(self: Compiler, a: Any, b: Any) -> Any:
        if not isinstance(a, Column) and not isinstance(b, Column):
            return a & b if op == "and" else a | b
        if isinstance(self.type(a), T.IntegralType) and isinstance(self.type(b), T.IntegralType):
            return getattr(self.column(a), bits)(self.column(b))
        return self.column(a) & self.column(b) if op == "and" else self.column(a) | self.column(b)

    return folded(f)


def compare(op: str) -> Callable:
    plain_ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}

    def f(self: Compiler, *args: Any) -> Any:
        if len(args) != 2:
            raise ValueError(f"{op} compares two values")
        a, b = args
        span = times.floor_range(op, a, b)
        if span is not None:
            return span
        if isinstance(a, Column) or isinstance(b, Column):
            # a text next to a time is read as a time, so that the comparison stays a comparison of times
            if isinstance(b, str) and is_time(self.type(a)):
                b = F.lit(b.replace("T", " ")).cast(self.type(a))
            if isinstance(a, str) and is_time(self.type(b)):
                a = F.lit(a.replace("T", " ")).cast(self.type(b))
            a, b = self.column(a), self.column(b)
            if op == "!=":
                return a != b
        return plain_ops[op](a, b)

    return f


def negate(self: Compiler, *args: Any) -> Any:
    """True where no argument is."""
    if any(isinstance(a, Column) for a in args):
        return reduce(lambda x, y: x & y, (~self.column(a).cast("boolean") for a in args))
    return all(not a for a in args)


def contains(self: Compiler, item: Any, where: Any) -> Any:
    if isinstance(where, Column):
        kind = self.type(where)
        return where.contains(self.column(item)) if isinstance(kind, T.StringType) else F.array_contains(where, item)
    if isinstance(item, Column):
        return item.isin(list(where))
    return item in where


def pairs(self: Compiler, *args: Any) -> Any:
    if len(args) % 2:
        raise ValueError("pairs of key and value are needed")
    if any(isinstance(a, Column) for a in args):
        return F.create_map(*(self.column(a) for a in args))
    return dict(zip(args[::2], args[1::2]))


BUILTINS: dict[str, Any] = {
    "true": True,
    "false": False,
    "+": folded(add),
    "-": minus,
    "*": folded(times_),
    "/": folded(divide),
    "%": folded(remainder),
    "and": both("and", "bitwiseAND"),
    "or": both("or", "bitwiseOR"),
    **{op: compare(op) for op in ("<", "<=", "=", "!=", ">=", ">")},
    "~": negate,
    "in": contains,
    "list": lambda self, *args: list(args),
    "as": lambda self, value, name: Alias(value, name),
    "dict": pairs,
    "kw": lambda self, *args: KWargs(dict(zip(args[::2], args[1::2]))),
}
FUNCTIONS: dict[str, Any] = {**arrays.REGISTRY, "floor": times.floor, "as-tz": times.as_tz, "as_tz": times.as_tz, "pretty_nb": times.pretty_nb, "day_of_week_num": times.day_of_week_num, "strpt": times.strpt}


def evaluate(text: str, env: dict | None = None, df: DataFrame | None = None) -> Any:
    """The value of an expression outside of any frame."""
    return Compiler(df, env).eval(parse(text))
