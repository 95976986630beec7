"""Intervals over a composite index with open or closed ends, on the driver and as predicates that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cmp_to_key
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.store.schema import HIGHEST, LOWEST, Edge, Schema


class Closed(NamedTuple):
    """Which ends of an interval belong to it; written as a word or its first letter."""

    left: bool
    right: bool

    @classmethod
    def cast(cls, x: Any) -> Closed:
        if isinstance(x, Closed):
            return x
        found = [ends for word, ends in WORDS.items() if str(x).lower() in (word, word[0])]
        if not found:
            raise ValueError(f"closed must be one of {', '.join(WORDS)}, not {x!r}")
        return found[0]

    @property
    def word(self) -> str:
        return next(word for word, ends in WORDS.items() if ends == self)


BOTH = Closed(True, True)
#: Words for ends.
WORDS = {"left": Closed(True, False), "right": Closed(False, True), "both": BOTH, "none": Closed(False, False)}


@dataclass(frozen=True)
class Interval:
    """Full-length index tuples; Edge values stand for what a prefix bound leaves open."""

    start: tuple
    stop: tuple
    closed: Closed = BOTH

    @classmethod
    def of(cls, schema: Schema, start: Any = None, stop: Any = None, closed: Any = "b") -> Interval:
        """From a user's bounds. A prefix bound that is closed takes in every index that begins with it, an open one none of them; None leaves a side open."""
        closed, n = Closed.cast(closed), len(schema.idx)
        a, b = schema.values(start) or (), schema.values(stop) or ()
        a = a + ((LOWEST if closed.left or not a else HIGHEST),) * (n - len(a))
        b = b + ((HIGHEST if closed.right or not b else LOWEST),) * (n - len(b))
        return cls(a, b, closed)

    @property
    def empty(self) -> bool:
        return below(self.stop, self.start) or (self.start == self.stop and self.closed != BOTH)

    def minus(self, other: Interval) -> list[Interval]:
        """What is left of this interval without the other: nothing, one or two pieces."""
        if self.intersect(other) is None:
            return [self]
        left = Interval(self.start, other.start, Closed(self.closed.left, not other.closed.left))
        right = Interval(other.stop, self.stop, Closed(not other.closed.right, self.closed.right))
        pieces = []
        if starts_before(self, other):
            pieces.append(left)
        if ends_after(self, other):
            pieces.append(right)
        return [p for p in pieces if not p.empty]

    def intersect(self, other: Interval) -> Interval | None:
        """The common part; where ends are equal, it is closed only if both are."""
        first = other if starts_before(self, other) else self
        last = other if ends_after(self, other) else self
        both = Interval(first.start, last.stop, Closed(first.closed.left, last.closed.right))
        return None if both.empty else both

    def covers(self, other: Interval) -> bool:
        return not starts_before(other, self) and not ends_after(other, self)

    def to_json(self, schema: Schema) -> dict:
        c = schema.idx_columns
        return {"start": [x.to_json(v) for x, v in zip(c, self.start)], "stop": [x.to_json(v) for x, v in zip(c, self.stop)], "closed": self.closed.word[0]}

    @classmethod
    def from_json(cls, schema: Schema, d: dict) -> Interval:
        c = schema.idx_columns
        return cls(tuple(x.from_json(v) for x, v in zip(c, d["start"])), tuple(x.from_json(v) for x, v in zip(c, d["stop"])), Closed.cast(d["closed"]))

    def predicate(self, schema: Schema) -> Column | None:
        """The interval as a condition on the index columns, in a form whose first column's comparison reaches Parquet; None if it holds for every row."""
        names = schema.idx

        def side(values: tuple, closed: bool, up: bool) -> Column | None:
            """None: always true. (a > x) or (a = x and rest), written as a >= x and (a > x or rest)."""
            expr: Column | None = None if closed else F.lit(False)
            for i in range(len(values) - 1, -1, -1):
                v = values[i]
                if isinstance(v, Edge):
                    expr = None if (v.side < 0) == up else F.lit(False)
                    continue
                c, x = F.col(f"`{names[i]}`"), schema[names[i]].literal(v)
                strict, loose = (c > x, c >= x) if up else (c < x, c <= x)
                last = i == len(values) - 1
                if expr is None:
                    expr = loose
                elif last:
                    expr = strict
                elif isinstance(values[i + 1], Edge):
                    expr = strict
                else:
                    expr = loose & (strict | expr)
            return expr

        parts = [p for p in (side(self.start, self.closed.left, True), side(self.stop, self.closed.right, False)) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def below(a: tuple, b: tuple) -> bool:
    """Lexicographic order in which Edge values compare with anything."""
    for x, y in zip(a, b):
        if isinstance(x, Edge) or isinstance(y, Edge):
            if x == y:
                continue
            return x.side < 0 if isinstance(x, Edge) else y.side > 0
        if x != y:
            return x < y
    return False


def starts_before(a: Interval, b: Interval) -> bool:
    return below(a.start, b.start) or (a.start == b.start and a.closed.left and not b.closed.left)


def ends_after(a: Interval, b: Interval) -> bool:
    return below(b.stop, a.stop) or (a.stop == b.stop and a.closed.right and not b.closed.right)


#: Sorts intervals by where they begin.
by_start = cmp_to_key(lambda a, b: -1 if starts_before(a, b) else 1 if starts_before(b, a) else 0)
