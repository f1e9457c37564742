"""Validity of values as columns: NULL is "no sample", NaN (or an infinity) is "invalid sample", anything finite is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def invalid() -> Column:
    return F.lit(float("nan"))


def fin(x: Column) -> Column:
    """x if finite, else NULL. Spark orders NaN after infinity, so one comparison does for all three."""
    return F.when(F.abs(x) < F.lit(INF), x)


def settle(x: Column) -> Column:
    """x if finite, else NaN: the value of a node whose inputs are there."""
    return F.coalesce(fin(x), invalid())


def finite(*xs: Column) -> Column:
    cond = F.abs(xs[0]) < F.lit(INF)
    for x in xs[1:]:
        cond = cond & (F.abs(x) < F.lit(INF))
    return F.coalesce(cond, F.lit(False))


def present(raw: Column, *xs: Column) -> Column:
    """settle(raw) where all inputs have a sample, else NULL."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, settle(raw))


def both_finite(raw: Column, *xs: Column) -> Column:
    """settle(raw) where all inputs are finite, NaN where one is invalid, NULL where one has no sample."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(missing, None).when(finite(*xs), settle(raw)).otherwise(invalid())


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def sign(x: Column) -> Column:
    """+1 for zero and above, -1 below."""
    return F.when(F.isnan(x), x).when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def guarded_div(x: Column, y: Column) -> Column:
    """x / y, NULL for y = 0 (the ANSI division would raise)."""
    return F.try_divide(x, y)
