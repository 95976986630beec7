"""Array functions by name, as expressions call them: each a column function, or plain Python for constants."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable] = {}


def _is(*xs: Any) -> bool:
    return any(isinstance(x, Column) for x in xs)


def _c(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x: Any) -> Column:
    return _c(x).cast("double")


def _add(*names: str):
    def put(f: Callable) -> Callable:
        for n in names:
            REGISTRY[n] = f
        return f

    return put


def _each(name: str, column: Callable, constant: Callable) -> None:
    """One-argument functions; a list of constants is mapped."""

    def f(x: Any) -> Any:
        if _is(x):
            return column(x)
        return [constant(v) for v in x] if isinstance(x, (list, tuple)) else constant(x)

    for n in name.split():
        REGISTRY[n] = f


def _log(column: Callable) -> Callable:
    """NaN below zero and minus infinity at zero, where SQL has null."""
    return lambda x: F.when(_d(x) == 0, F.lit(-math.inf)).when(_d(x) < 0, F.lit(math.nan)).otherwise(column(_d(x)))


_each("abs absolute fabs", F.abs, abs)
_each("sign", lambda x: F.signum(_d(x)), lambda v: float((v > 0) - (v < 0)))
_each("sqrt", lambda x: F.sqrt(_d(x)), math.sqrt)
_each("cbrt", lambda x: F.cbrt(_d(x)), lambda v: math.copysign(abs(v) ** (1 / 3), v))
_each("square", lambda x: x * x, lambda v: v * v)
_each("exp", lambda x: F.exp(_d(x)), math.exp)
_each("expm1", lambda x: F.expm1(_d(x)), math.expm1)
_each("exp2", lambda x: F.pow(F.lit(2.0), _d(x)), lambda v: 2.0**v)
_each("log", _log(F.ln), math.log)
_each("log2", _log(F.log2), math.log2)
_each("log10", _log(F.log10), math.log10)
_each("log1p", lambda x: F.when(_d(x) == -1, F.lit(-math.inf)).when(_d(x) < -1, F.lit(math.nan)).otherwise(F.log1p(_d(x))), math.log1p)
_each("ceil", lambda x: F.ceil(_d(x)).cast("double"), lambda v: float(math.ceil(v)))
_each("trunc fix", lambda x: F.when(_d(x) < 0, F.ceil(_d(x))).otherwise(F.floor(_d(x))).cast("double"), lambda v: float(math.trunc(v)))
_each("rint", lambda x: F.rint(_d(x)), lambda v: float(round(v)))
for _n, _f in (("sin", "sin"), ("cos", "cos"), ("tan", "tan"), ("arcsin", "asin"), ("arccos", "acos"), ("arctan", "atan"), ("sinh", "sinh"), ("cosh", "cosh"), ("tanh", "tanh"), ("degrees", "degrees"), ("radians", "radians")):
    _each(_n, (lambda g: lambda x: g(_d(x)))(getattr(F, _f)), getattr(math, _f))
_each("rad2deg", lambda x: F.degrees(_d(x)), math.degrees)
_each("deg2rad", lambda x: F.radians(_d(x)), math.radians)
_each("isnan", lambda x: F.isnan(_d(x)), math.isnan)
_each("isinf", lambda x: F.abs(_d(x)) == F.lit(math.inf), math.isinf)
_each("isfinite", lambda x: ~F.isnan(_d(x)) & (F.abs(_d(x)) != F.lit(math.inf)), math.isfinite)
_each("logical_not", lambda x: ~_c(x).cast("boolean"), lambda v: not v)
_each("char.lower", F.lower, str.lower)
_each("char.upper", F.upper, str.upper)
_each("char.capitalize", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x)))), str.capitalize)
_each("char.title", F.initcap, str.title)
_each("char.strip", F.trim, str.strip)
_each("char.lstrip", F.ltrim, str.lstrip)
_each("char.rstrip", F.rtrim, str.rstrip)
_each("char.str_len", lambda x: F.length(x).cast("long"), len)
_each("asarray array", lambda x: x, lambda v: v)


@_add("around", "round", "round_")
def around(x: Any, decimals: int = 0) -> Any:
    """Halves go to the even neighbour."""
    return F.bround(_d(x), decimals) if _is(x) else round(x, decimals)


@_add("power", "float_power")
def power(x: Any, y: Any) -> Any:
    return F.pow(_d(x), _d(y)) if _is(x, y) else x**y


@_add("arctan2")
def arctan2(y: Any, x: Any) -> Any:
    return F.atan2(_d(y), _d(x)) if _is(x, y) else math.atan2(y, x)


@_add("hypot")
def hypot(x: Any, y: Any) -> Any:
    return F.hypot(_d(x), _d(y)) if _is(x, y) else math.hypot(x, y)


@_add("floor_divide")
def floor_divide(x: Any, y: Any) -> Any:
    return F.floor(_d(x) / F.when(_d(y) != 0, _d(y))).cast("double") if _is(x, y) else x // y


@_add("mod", "remainder")
def mod(x: Any, y: Any) -> Any:
    if not _is(x, y):
        return x % y
    x, y = _c(x), F.when(_c(y) != 0, _c(y))
    return ((x % y) + y) % y


@_add("fmod")
def fmod(x: Any, y: Any) -> Any:
    return _d(x) % F.when(_d(y) != 0, _d(y)) if _is(x, y) else math.fmod(x, y)


@_add("minimum")
def minimum(x: Any, y: Any) -> Any:
    return F.least(_c(x), _c(y)) if _is(x, y) else min(x, y)


@_add("maximum")
def maximum(x: Any, y: Any) -> Any:
    return F.greatest(_c(x), _c(y)) if _is(x, y) else max(x, y)


@_add("clip")
def clip(x: Any, low: Any, high: Any) -> Any:
    return F.least(F.greatest(_c(x), _c(low)), _c(high)) if _is(x, low, high) else min(max(x, low), high)


@_add("where")
def where(condition: Any, a: Any, b: Any) -> Any:
    return F.when(condition, _c(a)).otherwise(_c(b)) if _is(condition) else a if condition else b


@_add("nan_to_num")
def nan_to_num(x: Any, nan: float = 0.0) -> Any:
    return F.nanvl(_d(x), F.lit(float(nan))) if _is(x) else nan if x != x else x


@_add("isin")
def isin(x: Any, values: Any, invert: bool = False) -> Any:
    if not _is(x):
        hit = [v in values for v in x] if isinstance(x, (list, tuple)) else x in values
        return [not h for h in hit] if invert and isinstance(hit, list) else hit != invert if not isinstance(hit, list) else hit
    hit = F.array_contains(values, x) if _is(values) else x.isin(list(values))
    return ~hit if invert else hit


@_add("logical_and")
def logical_and(x: Any, y: Any) -> Any:
    return _c(x).cast("boolean") & _c(y).cast("boolean") if _is(x, y) else bool(x and y)


@_add("logical_or")
def logical_or(x: Any, y: Any) -> Any:
    return _c(x).cast("boolean") | _c(y).cast("boolean") if _is(x, y) else bool(x or y)


@_add("logical_xor")
def logical_xor(x: Any, y: Any) -> Any:
    return _c(x).cast("boolean") != _c(y).cast("boolean") if _is(x, y) else bool(x) != bool(y)


@_add("char.find")
def find(x: Any, what: str) -> Any:
    return (F.instr(x, what) - 1).cast("long") if _is(x) else x.find(what)


@_add("char.replace")
def replace(x: Any, old: str, new: str) -> Any:
    return F.replace(x, F.lit(old), F.lit(new)) if _is(x) else x.replace(old, new)


@_add("char.startswith")
def startswith(x: Any, what: str) -> Any:
    return x.startswith(what)


@_add("char.endswith")
def endswith(x: Any, what: str) -> Any:
    return x.endswith(what)


@_add("char.add")
def char_add(x: Any, y: Any) -> Any:
    return F.concat(_c(x), _c(y)) if _is(x, y) else x + y


for _n, _op in (("equal", "__eq__"), ("not_equal", "__ne__"), ("less", "__lt__"), ("less_equal", "__le__"), ("greater", "__gt__"), ("greater_equal", "__ge__")):
    REGISTRY[_n] = REGISTRY[f"char.{_n}"] = (lambda op: lambda x, y: getattr(_c(x), op)(_c(y)) if _is(x, y) else getattr(x, op)(y))(_op)


@_add("unique")
def unique(x: Any, return_index: bool = False, return_counts: bool = False) -> Any:
    """Sorted different values; of constants also their first positions or counts."""
    if _is(x):
        return F.array_distinct(F.sort_array(x))
    values = sorted(set(x))
    extra = ([[x.index(v) for v in values]] if return_index else []) + ([[x.count(v) for v in values]] if return_counts else [])
    return (values, *extra) if extra else values


def _compiled(*names: str):
    def put(f: Callable) -> Callable:
        f.compiled = True
        return _add(*names)(f)

    return put


def _over(self: Any, kind: str, x: Column) -> Column:
    """A value over the order of the frame's index, which the reducing frame works out range by range; elsewhere (in masks) by one window."""
    if self.running is None:
        w = W.orderBy(*(F.col(f"`{c}`") for c in self.order))
        return F.sum(x).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) if kind == "cumsum" else F.lag(x).over(w)
    self.running.append((kind, x))
    name = f"_r{len(self.running) - 1}"
    self.df = self.df.withColumn(name, F.lit(None).cast(self.type(x)))  # so that types can be found
    return F.col(name)


@_compiled("cumsum")
def cumsum(self: Any, x: Column) -> Column:
    return _over(self, "cumsum", x)


@_compiled("diff")
def diff(self: Any, x: Column) -> Column:
    """Difference to the row before; null at the first row, which keeps the length."""
    return x - _over(self, "lag", x)


@_add("std")
def std(x: Any) -> Any:
    return F.stddev_pop(x)


@_add("var")
def var(x: Any) -> Any:
    return F.var_pop(x)


@_compiled("median")
def median(self: Any, x: Any) -> Any:
    return self.quantile(x, 0.5) if _is(x) else statistics.median(x)


@_add("any")
def any_(x: Any) -> Any:
    return F.bool_or(x) if _is(x) else any(x)


@_add("all")
def all_(x: Any) -> Any:
    return F.bool_and(x) if _is(x) else all(x)


@_add("size")
def size(x: Any) -> Any:
    return F.count(F.lit(1)) if _is(x) else len(x)


#: Names of this registry that turn rows into one value.
AGGREGATES = ("std", "var", "median", "any", "all", "size")
