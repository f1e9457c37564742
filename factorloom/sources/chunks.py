"""Long series in pieces: an instrument with a large share of all rows need not be one task.

Rows are numbered within their instrument without sorting it whole: by ranges of time first (counts of the ranges before, a small
table), then within the range. Pieces have a fixed number of rows and begin with copies of the look-back rows before
them, so that windows over a piece see what they would see over the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def split_series(panel: DataFrame, look_back: int, rows: int, instrument: str = "instrument", ts: str = "ts") -> DataFrame:
    """panel with ``__piece`` (number within the instrument) and ``__copy`` (a look-back row, to be left out of the result)."""
    rows = max(rows, look_back + 1)
    at = F.col(ts).cast("double")
    cuts = panel.agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 10_000).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = panel.withColumn("__range", F.size(F.filter(bounds, lambda b: b < at)))
    before = Window.partitionBy(instrument).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(instrument, "__range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(instrument, "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(instrument, "__range").orderBy(ts)
    numbered = ranged.join(starts, [instrument, "__range"]).withColumn("__row", F.col("__start") + F.row_number().over(within) - 1)
    piece = F.floor(F.col("__row") / rows).cast("long")
    own = F.struct(piece.alias("piece"), F.lit(False).alias("copy"))
    next_one = F.struct((piece + 1).alias("piece"), F.lit(True).alias("copy"))
    to = F.when(F.col("__row") % rows >= rows - look_back, F.array(own, next_one)).otherwise(F.array(own))
    return numbered.withColumn("__to", F.explode(to)).select(*panel.columns, F.col("__to.piece").alias("__piece"), F.col("__to.copy").alias("__copy"))
