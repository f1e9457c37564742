"""Cross-sectional operators: windows over the instruments of one timestamp (and one group, for neutralisation)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.values import fin, finite, guarded_div, settle

TINY = 1e-12


class CrossSection:
    def __init__(self, ts: str = "ts"):
        self.ts = ts

    @property
    def all(self):
        return Window.partitionBy(self.ts)

    def rank(self, x: Column) -> Column:
        """Average rank from 0 to 1 among the valid; a single valid one has 0.

        Rank, ties (the peers in a range frame) and count all use one partitioning: one exchange.
        """
        x = fin(x)
        ordered = self.all.orderBy(x.isNull(), x)
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        n = F.count(x).over(self.all)
        return settle(F.when(x.isNotNull(), F.when(n > 1, guarded_div(F.rank().over(ordered) + (ties - 1) / 2.0 - 1, n - 1)).otherwise(0.0)))

    def zscore(self, x: Column) -> Column:
        x = fin(x)
        sd = F.stddev_pop(x).over(self.all)
        return settle(F.when(x.isNotNull(), F.when(sd > 0, guarded_div(x - F.avg(x).over(self.all), sd)).otherwise(0.0)))

    def center(self, x: Column) -> Column:
        x = fin(x)
        return settle(x - F.avg(x).over(self.all))

    def scale(self, x: Column) -> Column:
        x = fin(x)
        return settle(guarded_div(x, F.sum(F.abs(x)).over(self.all)))

    def norm(self, x: Column) -> Column:
        x = fin(x)
        low, high = F.min(x).over(self.all), F.max(x).over(self.all)
        return settle(F.when(x.isNotNull(), F.when(high > low, guarded_div(x - low, high - low)).otherwise(0.0)))

    def fillna(self, x: Column) -> Column:
        x = fin(x)
        return settle(F.coalesce(x, F.avg(x).over(self.all)))

    def _quantile(self, x: Column, q: float) -> Column:
        return F.percentile(x, F.lit(float(q))).over(self.all)

    def winsorize(self, x: Column, p: float) -> Column:
        x = fin(x)
        return settle(F.when(x.isNotNull(), F.least(F.greatest(x, self._quantile(x, p)), self._quantile(x, 1 - p))))

    def percentiles(self, x: Column, low: float, high: float) -> Column:
        """x at or beyond the two quantiles, 0 between them."""
        x = fin(x)
        return settle(F.when(x.isNotNull(), F.when((x <= self._quantile(x, low)) | (x >= self._quantile(x, high)), x).otherwise(0.0)))

    # --- neutralisation

    def _parts(self, inputs: list[Column], group: Column | None, weight: Column | None):
        """(inputs, weight) where the row takes part, NULL elsewhere; the window of its group."""
        used = [*inputs, *([group] if group is not None else [])]
        ok = finite(*used)
        if weight is not None:
            ok = ok & finite(weight) & F.coalesce(weight > 0, F.lit(False))
        w = F.when(ok, weight if weight is not None else F.lit(1.0))
        keys = [self.ts, *([F.when(ok, group)] if group is not None else [])]
        return [F.when(ok, x) for x in inputs], w, Window.partitionBy(*keys)

    def neutralize(self, df, out: str, y: Column, xs: list[Column], group: Column | None, weight: Column | None, standardize: bool):
        """df with the residual of y on 0 to 3 regressors and an intercept, by (ts, group); weighted if asked.

        Means come first, then products of centred inputs: the moments keep their digits. All windows share one
        partitioning. The small system is solved in arrays by elimination with the largest pivot; a singular one has
        slopes of 0.
        """
        (y, *xs), w, by = self._parts([y, *xs], group, weight)
        named = {f"{out}_y": y, **{f"{out}_x{k}": x for k, x in enumerate(xs)}, f"{out}_w": w}
        keep = df.columns
        df = df.withColumns(named)
        cols = [F.col(c) for c in named]
        y, xs, w = cols[0], cols[1:-1], cols[-1]
        total = F.sum(w).over(by)
        mean = lambda v: guarded_div(F.sum(w * v).over(by), total)
        df = df.withColumns({f"{out}_w_all": total} | {f"{out}_c{k}": v - mean(v) for k, v in enumerate([y, *xs])})
        enough = F.col(f"{out}_w_all") > TINY
        cy, *cx = (F.col(f"{out}_c{k}") for k in range(1 + len(xs)))
        r = F.when(enough, cy)
        if cx:
            n = len(cx)
            moment = lambda a, b: guarded_div(F.sum(w * a * b).over(by), F.col(f"{out}_w_all"))
            rows = F.array(*[F.array(*[moment(a, b) for b in cx], moment(a, cy)) for a in cx])
            df = df.withColumn(f"{out}_m", rows)
            if n == 1:
                m = F.col(f"{out}_m")[0]
                beta = [F.when(m[0] > TINY, guarded_div(m[1], m[0])).otherwise(0.0)]
            else:
                df, beta = _solve(df, f"{out}_m", n)
            for b, x in zip(beta, cx, strict=True):
                r = r - b * x
        df = df.withColumn(f"{out}_r", r)
        r = F.col(f"{out}_r")
        if standardize:
            if weight is not None:
                df = df.withColumn(f"{out}_rc", r - mean(r))
                c = F.col(f"{out}_rc")
                num = F.sum(w * c * c).over(by)
                var = guarded_div(num, F.sum(F.when(r.isNotNull(), w)).over(by))
                r = F.when(num > TINY, guarded_div(c, F.sqrt(var)))
            else:
                var = F.var_samp(r).over(by)
                r = F.when(var > TINY, guarded_div(r - F.avg(r).over(by), F.sqrt(var)))
        return df.select(*keep, settle(F.when(w.isNotNull(), r)).alias(out))


def _solve(df, name: str, n: int):
    """Columns of the solution of the n rows of [coefficients, right side] in the array column ``name``."""
    singular = F.lit(False)
    for p in range(n):
        df = _eliminate(df, name, n, p)
        singular = singular | F.col(f"{name}_s{p}")
    last = F.col(f"{name}{n}")
    return df, [F.when(singular, F.lit(0.0)).otherwise(last[k][n]) for k in range(n)]


def _eliminate(df, name: str, n: int, p: int):
    """One step: the row with the largest entry in column p is scaled, moves to place p, and clears that column elsewhere."""
    m = F.col(f"{name}{p}" if p else name)
    size = F.transform(F.slice(m, p + 1, n - p), lambda row: F.abs(row[p]))
    best = F.coalesce((F.array_position(size, F.array_max(size)) - 1 + p).cast("int"), F.lit(p))
    df = df.withColumn(f"{name}_b{p}", best)
    best = F.col(f"{name}_b{p}")
    largest = F.get(m, best)[p]
    ok = F.coalesce(F.abs(largest) > TINY, F.lit(False))
    row = F.transform(F.get(m, best), lambda v: F.when(ok, guarded_div(v, largest)).otherwise(0.0))
    df = df.withColumns({f"{name}_r{p}": row, f"{name}_s{p}": ~ok})
    pivot = F.col(f"{name}_r{p}")
    swapped = F.transform(m, lambda r, i: F.when(i == best, m[p]).otherwise(r))
    cleared = F.transform(swapped, lambda r, i: F.when(i == p, pivot).otherwise(F.zip_with(r, pivot, lambda a, b: a - r[p] * b)))
    return df.withColumn(f"{name}{p + 1}", cleared)
