"""Windows over two fields of different sources, each on its own clock.

Where sources don't tick together, a pair of windows lines up by position: the last w samples of one field against the
last w of the other, whatever their times. Each source keeps its own list of samples (a window over its own rows); the
lists are carried forward onto the times of either, and the statistic is taken over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidExpression
from ..functions.values import fin, guarded_div
from ..plans.planner import FieldRef, Node, compile_request
from ..sources.panel import align, carry_forward
from .ts import TINY, ewm_weights, weighted


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _sums(x: Column, y: Column, w: int) -> Column:
    """Struct of the centred sums xy, xx and yy of two lists of w samples."""

    def centred(m):
        dx, dy = F.transform(x, lambda v: v - m["x"]), F.transform(y, lambda v: v - m["y"])
        return F.struct(_total(F.zip_with(dx, dy, lambda a, b: a * b)).alias("xy"), _total(F.transform(dx, lambda v: v * v)).alias("xx"), _total(F.transform(dy, lambda v: v * v)).alias("yy"))

    return F.get(F.transform(F.array(F.struct((_total(x) / w).alias("x"), (_total(y) / w).alias("y"))), centred), F.lit(0))


def _statistic(op: str, x: Column, y: Column, s: Column, w: int) -> Column:
    if op == "ts_cov":
        return s["xy"] / (w - 1) if w > 1 else F.lit(None).cast("double")
    if op == "ts_corr":
        return F.when((s["xx"] > TINY) & (s["yy"] > TINY), guarded_div(s["xy"], F.sqrt(s["xx"] * s["yy"])))
    if op == "ts_beta":
        return F.when(s["yy"] > TINY, guarded_div(s["xy"], s["yy"]))
    if op == "ts_linear_regression":
        return F.when(s["xx"] > TINY, guarded_div(s["xy"], s["xx"]))
    v = ewm_weights(w)
    return weighted(F.zip_with(x, y, lambda a, b: a * b), v) - weighted(x, v) * weighted(y, v)


def on_own_clocks(n: Node) -> bool:
    """Whether a node is a pair window over raw fields of two sources."""
    return len(n.inputs) == 2 and bool(n.param("window")) and all(isinstance(x, FieldRef) for x in n.inputs) and n.inputs[0].source != n.inputs[1].source


def pair_window(n: Node, sources: list[DataFrame], name: str) -> DataFrame:
    """(ts, instrument, value) at the times of either source of the node; null where it is invalid."""
    w = n.param("window")
    lists = []
    for k, ref in enumerate(n.inputs):
        panel = next(p for p in sources if ref.column in p.columns).where(F.col(ref.column).isNotNull())
        frame = Window.partitionBy("instrument").orderBy("ts").rowsBetween(-(w - 1), 0)
        lists.append(panel.select("instrument", "ts", F.collect_list(fin(F.col(ref.column))).over(frame).alias(f"__a{k}")))
    both = carry_forward(align(lists), ["__a0", "__a1"])
    x, y = F.col("__a0"), F.col("__a1")
    full = both.withColumn("__full", (F.size(x) == w) & (F.size(y) == w))
    sums = full.withColumn("__s", F.when(F.col("__full"), _sums(x, y, w)))
    return sums.select("ts", "instrument", fin(F.when(F.col("__full"), _statistic(n.op, x, y, F.col("__s"), w))).alias(name))


def evaluate_on_event_clocks(expr: str, sources: list[DataFrame], name: str = "value") -> DataFrame:
    """(ts, instrument, value) at the times of either source, for one pair window over two raw fields.

    Each panel of ``sources`` has (instrument, ts, its fields) and one row for each event.
    """
    plan = compile_request([expr], [name])
    node = plan.nodes[-1]
    if len(plan.nodes) != 1 or len(node.inputs) != 2 or not all(isinstance(x, FieldRef) for x in node.inputs) or not node.param("window"):
        raise InvalidExpression(expr, "event clocks take one two-field window over raw fields")
    return pair_window(node, sources, name)
