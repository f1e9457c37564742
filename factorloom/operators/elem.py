"""Element-wise operators: expressions in a projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import both_finite, fin, finite, flag, guarded_div, invalid, present, sign

UNARY = {
    "elem_abs": lambda x: present(F.abs(x), x),
    "elem_exp": lambda x: present(F.exp(x), x),
    "elem_log": lambda x: present(F.log(x), x),
    "elem_sign": lambda x: present(sign(x), x),
    "elem_sqrt": lambda x: present(F.sqrt(x), x),
    "elem_to_int": lambda x: both_finite(flag(x != 0), x),
    "elem_not": lambda x: both_finite(flag(x == 0), x),
}


def _binary(raw):
    return lambda x, y: both_finite(raw(x, y), x, y)


BINARY = {
    "elem_add": _binary(lambda x, y: x + y),
    "elem_sub": _binary(lambda x, y: x - y),
    "elem_mul": _binary(lambda x, y: x * y),
    "elem_div": _binary(guarded_div),
    "elem_pow": _binary(F.pow),
    "elem_min": _binary(F.least),
    "elem_max": _binary(F.greatest),
    "elem_signed_power": _binary(lambda x, p: sign(x) * F.pow(F.abs(x), p)),
    "elem_lt": _binary(lambda x, y: flag(x < y)),
    "elem_le": _binary(lambda x, y: flag(x <= y)),
    "elem_gt": _binary(lambda x, y: flag(x > y)),
    "elem_ge": _binary(lambda x, y: flag(x >= y)),
    "elem_eq": _binary(lambda x, y: flag(x == y)),
    "elem_ne": _binary(lambda x, y: flag(x != y)),
    "elem_and": _binary(lambda x, y: flag((x != 0) & (y != 0))),
    "elem_or": _binary(lambda x, y: flag((x != 0) | (y != 0))),
}


def fillna(x: Column, f: Column) -> Column:
    """x where finite, else f; both must have a sample."""
    return present(F.coalesce(fin(x), f), x, f)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; invalid where x is, or where the bounds cross."""
    return both_finite(F.when(low <= high, F.least(F.greatest(x, low), high)), x, low, high)


def where(c: Column, a: Column, b: Column) -> Column:
    """a where c is not zero, else b. The condition must be finite; of the branches only the one taken."""
    return present(F.when(finite(c), F.when(c != 0, a).otherwise(b)).otherwise(invalid()), c, a, b)


TERNARY = {"elem_clip": clip, "elem_where": where}
