"""Rolling operators: window functions over an instrument's last rows.

A window counts only when it has all its samples and all are finite. All windows of a level share one partitioning and order, so one exchange and one
sort serve them, whatever their lengths.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.values import fin, finite, guarded_div, settle

#: Sums of squares at or under this count as a constant series.
TINY = 1e-12
EPS = 2.220446049250313e-16


class Rolling:
    """Builders for the column (or columns) of a series and one order column."""

    def __init__(self, instrument: str | list[str] = "instrument", ts: str = "ts"):
        self.instrument, self.ts = instrument, ts

    @property
    def series(self):
        return Window.partitionBy(self.instrument).orderBy(self.ts)

    def over(self, agg: Column, w: int) -> Column:
        return agg.over(self.series.rowsBetween(-(w - 1), 0))

    def _full(self, x: Column, w: int) -> Column:
        return self.over(F.count(fin(x)), w) == w

    def _one(self, agg, guard=None):
        """A window aggregate of one input, NaN unless the window is full (and the guard holds)."""

        def build(x: Column, w: int) -> Column:
            value = self.over(agg(fin(x)), w)
            full = self._full(x, w)
            return settle(F.when(full if guard is None else full & guard(w), value))

        return build

    def _moment(self, scaled, least: int):
        """A standardised moment; invalid for short windows and series without spread."""

        def build(x: Column, w: int) -> Column:
            if w < least:
                return settle(F.lit(None).cast("double"))
            spread = self.over(F.stddev_samp(fin(x)), w)
            return settle(F.when(self._full(x, w) & (spread > 0) & (F.pow(spread, least - 1) > EPS), scaled(x, w)))

        return build

    def _list(self, x: Column, w: int) -> Column:
        """The window's samples, oldest first; short unless the window is full."""
        return self.over(F.collect_list(fin(x)), w)

    def _of_list(self, f):
        return lambda x, w: settle(F.when(self._full(x, w), f(self._list(x, w), x, w)))

    def _pair(self, x: Column, y: Column) -> tuple[Column, Column]:
        ok = finite(x, y)
        return F.when(ok, x), F.when(ok, y)

    def _two(self, f, least: int = 1):
        def build(x: Column, y: Column, w: int) -> Column:
            if w < least:
                return settle(F.lit(None).cast("double"))
            a, b = self._pair(x, y)
            return settle(F.when(self.over(F.count(a), w) == w, f(a, b, w)))

        return build

    # --- one input

    def table(self) -> dict:
        n = float
        spread = lambda x, w: self.over(F.stddev_samp(fin(x)), w)
        skew = self._moment(lambda x, w: self.over(F.skewness(fin(x)), w) * F.lit(sqrt(n(w) * (w - 1)) / (w - 2)), 3)
        kurt = self._moment(lambda x, w: ((w + 1) * self.over(F.kurtosis(fin(x)), w) + 6) * F.lit((w - 1) / ((w - 2) * (w - 3))), 4)
        mean = lambda a, w: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / w
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        # a list's mean is needed inside another walk over it: bind it once as a one-element array
        mad = lambda a, x, w: F.get(F.transform(F.array(mean(a, w)), lambda m: total(F.transform(a, lambda v: F.abs(v - m))) / w), F.lit(0))
        rank = lambda a, x, w: ((F.size(F.filter(a, lambda v: v < x)) + 1 + F.size(F.filter(a, lambda v: v <= x))) / 2.0 - 1) / (w - 1) if w > 1 else F.lit(0.0)
        newest = lambda best: lambda a, x, w: (F.array_position(F.reverse(a), best(a)) - 1).cast("double")
        return {
            "ts_mean": self._one(F.avg),
            "ts_sum": self._one(F.sum),
            "ts_product": self._one(F.product),
            "ts_min": self._one(F.min),
            "ts_max": self._one(F.max),
            "ts_std": self._one(F.stddev_samp),
            "ts_var": self._one(lambda x: F.var_samp(x)),
            "ts_mad": self._of_list(mad),
            "ts_skew": skew,
            "ts_kurt": kurt,
            "ts_zscore": lambda x, w: settle(F.when(self._full(x, w), F.when(spread(x, w) > 0, guarded_div(x - self.over(F.avg(fin(x)), w), spread(x, w))).otherwise(0.0))),
            "ts_ewm_mean": self._of_list(lambda a, x, w: weighted(a, ewm_weights(w))),
            "ts_ewm_var": self._of_list(lambda a, x, w: F.greatest(F.lit(0.0), weighted(F.transform(a, lambda v: v * v), ewm_weights(w)) - F.pow(weighted(a, ewm_weights(w)), F.lit(2.0)))),
            "ts_decay_linear": self._of_list(lambda a, x, w: weighted(a, [2.0 * (k + 1) / (w * (w + 1)) for k in range(w)])),
            "ts_argmax": self._of_list(newest(F.array_max)),
            "ts_argmin": self._of_list(newest(F.array_min)),
            "ts_rank": self._of_list(rank),
        }

    def lag(self, x: Column, k: int) -> Column:
        return settle(F.lag(fin(x), k).over(self.series))

    def delta(self, x: Column, k: int) -> Column:
        return settle(fin(x) - F.lag(fin(x), k).over(self.series))

    def quantile(self, x: Column, w: int, q: float) -> Column:
        """Linear interpolation at q * (w - 1) of the sorted window."""
        at = q * (w - 1)
        low = int(at)
        high, part = min(low + 1, w - 1), at - low
        ordered = F.sort_array(self._list(x, w))
        a, b = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(high))
        return settle(F.when(self._full(x, w), a + (b - a) * part))

    # --- two inputs

    def pair_table(self) -> dict:
        cov = lambda a, b, w: self.over(F.covar_samp(a, b), w)
        var = lambda a, w: self.over(F.var_samp(a), w)
        moves = lambda a, w: var(a, w) * (w - 1) > TINY
        slope = lambda y, x, w: F.when(moves(x, w), guarded_div(cov(y, x, w), var(x, w)))  # noqa: E731  of y on x
        corr = lambda a, b, w: F.when(moves(a, w) & moves(b, w), guarded_div(cov(a, b, w), F.sqrt(var(a, w)) * F.sqrt(var(b, w))))
        return {
            "ts_cov": self._two(cov, 2),
            "ts_beta": self._two(lambda a, b, w: slope(a, b, w), 2),
            "ts_corr": self._two(corr, 2),
            "ts_linear_regression": self._two(lambda a, b, w: slope(b, a, w), 2),
            "ts_ewm_cov": self._two(self._ewm_cov),
        }

    def _ewm_cov(self, a: Column, b: Column, w: int) -> Column:
        both = self.over(F.collect_list(F.when(a.isNotNull(), F.struct(a.alias("x"), b.alias("y")))), w)
        v = ewm_weights(w)
        return weighted(F.transform(both, lambda s: s["x"] * s["y"]), v) - weighted(F.transform(both, lambda s: s["x"]), v) * weighted(F.transform(both, lambda s: s["y"]), v)


def ewm_weights(w: int) -> list[float]:
    """Weights (1 - 2 / (w + 1)) ** lag of a window, oldest first, summing to one."""
    raw = [(1 - 2 / (w + 1)) ** (w - 1 - k) for k in range(w)]
    return [v / sum(raw) for v in raw]


def weighted(a: Column, weights: Sequence[float]) -> Column:
    """Sum of a's elements times the weights (a full window has as many)."""
    v = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(a, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
