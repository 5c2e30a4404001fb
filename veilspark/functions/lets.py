"""Column helpers for array work inside one row.

``let`` names an intermediate value.  Catalyst may move the expression behind
a column reference into the body of a lambda, where it is evaluated once per
element; a value bound by ``let`` is a lambda argument, so it is evaluated
exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _strides(n: Column) -> Column:
    """1, 2, 4, ... below ``n``."""
    powers = F.transform(F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1),
                         lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.when(n > 1, powers).otherwise(F.array().cast("array<int>"))


def scan(values: Column, op: Callable[[Column, Column], Column], empty: Column) -> Column:
    """Inclusive running ``op`` over an array in ceil(log2 n) passes.
    ``empty`` is what ``op`` ignores."""
    return let(values, lambda v: F.aggregate(
        _strides(F.size(v)), v,
        lambda acc, d: F.transform(acc, lambda x, i: op(x, F.coalesce(F.get(acc, i - d), empty)))))


def running_sum(values: Column) -> Column:
    return scan(values, lambda a, b: a + b, F.lit(0))


def running_max(values: Column) -> Column:
    return scan(values, lambda a, b: F.greatest(a, b), F.lit(-1))


def before(values: Column, first: Column) -> Column:
    """The array moved on by one: element i is the one before it, ``first`` in front."""
    return F.slice(F.concat(F.array(first), values), F.lit(1), F.size(values))
