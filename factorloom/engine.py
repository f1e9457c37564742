"""Evaluates a plan over a panel: one row for each (instrument, ts), one double column ``<source>__<field>`` for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import InvalidParameter, MissingField
from .functions.values import fin
from .operators import elem
from .operators.cs import CrossSection
from .operators.registry import OPS
from .operators.ts import Rolling
from .plans.planner import Const, FactorRequest, FieldRef, LogicalPlan, Node, Ref, compile_request
from .sources.chunks import split_series


def column_name(ref: Ref) -> str:
    return ref.column if isinstance(ref, FieldRef) else f"__n{ref.id}"


def _column(ref: Ref) -> Column:
    return F.lit(ref.value) if isinstance(ref, Const) else F.col(column_name(ref))


class Evaluator:
    def __init__(self, instrument: str | list[str] = "instrument", ts: str = "ts"):
        self.rolling, self.cross = Rolling(instrument, ts), CrossSection(ts)
        self.windows, self.pairs = self.rolling.table(), self.rolling.pair_table()

    def build(self, n: Node) -> Column | None:
        """The node's column; none for neutralisation, which takes several steps."""
        xs = [_column(x) for x in n.inputs]
        if n.op in elem.UNARY:
            return elem.UNARY[n.op](*xs)
        if n.op in elem.BINARY:
            return elem.BINARY[n.op](*xs)
        if n.op in elem.TERNARY:
            return elem.TERNARY[n.op](*xs)
        if n.op == "elem_fillna":
            return elem.fillna(*xs)
        if n.op in self.windows:
            return self.windows[n.op](*xs, n.param("window"))
        if n.op in self.pairs:
            return self.pairs[n.op](*xs, n.param("window"))
        if n.op == "ts_quantile":
            return self.rolling.quantile(*xs, n.param("window"), n.param("q"))
        if n.op in ("ts_lag", "ts_delta"):
            return getattr(self.rolling, n.op[3:])(*xs, n.param("lag"))
        if n.op == "cs_winsorize":
            return self.cross.winsorize(*xs, n.param("p"))
        if n.op == "cs_percentiles":
            return self.cross.percentiles(*xs, n.param("low"), n.param("high"))
        if OPS[n.op].shape == "x":
            return getattr(self.cross, n.op[3:])(*xs)
        return None

    def neutral(self, df: DataFrame, n: Node) -> DataFrame:
        xs = [_column(x) for x in n.inputs]
        k = n.param("regressors")
        group, weights = (xs[i] if (i := n.param(r)) is not None else None for r in ("group", "weights"))
        return self.cross.neutralize(df, f"__n{n.id}", xs[0], xs[1 : 1 + k], group, weights, n.param("standardize"))

    def run(self, plan: LogicalPlan, panel: DataFrame) -> DataFrame:
        """panel with a column for each node that it hasn't got; a level at a time, so that windows of a level share their sort."""
        df, known = panel, set(panel.columns)
        for level in plan.levels():
            level = [n for n in level if f"__n{n.id}" not in known]
            built = {f"__n{n.id}": c for n in level if (c := self.build(n)) is not None}
            df = df.withColumns(built) if built else df
            for n in level:
                if OPS[n.op].shape.startswith("neutral"):
                    df = self.neutral(df, n)
        return df


def evaluate(plan: LogicalPlan | FactorRequest | list[str] | str, panel: DataFrame, instrument: str = "instrument", ts: str = "ts", keep: tuple[str, ...] = (), inner: bool = False, piece_rows: int | None = None) -> DataFrame:
    """(ts, instrument, kept columns, outputs): invalid values are NULL.

    Rows must be unique by (instrument, ts). ``inner`` adds the columns of all nodes, named ``f{id}_{operator}``.
    ``piece_rows`` cuts long series into pieces of so many rows, each a unit of work of its own (for plans without
    cross-sectional nodes, where one instrument may hold a large share of the rows).
    """
    if not isinstance(plan, LogicalPlan):
        plan = compile_request(plan)
    for f in plan.fields:
        if f.column not in panel.columns:
            raise MissingField(f"{f.source}.{f.name}")
    # only what the plan reads goes through the shuffles
    slim = panel.select(instrument, ts, *keep, *[F.col(f.column).cast("double").alias(f.column) for f in plan.fields])
    if piece_rows is not None:
        if plan.cross_sectional():
            raise InvalidParameter("piece_rows needs a plan without cross-sectional operators")
        slim = split_series(slim, plan.look_back(), piece_rows, instrument, ts)
        df = Evaluator([instrument, "__piece"], ts).run(plan, slim).where("not __copy")
    else:
        df = Evaluator(instrument, ts).run(plan, slim)
    outputs = [fin(_column(r)).alias(name) for name, r in plan.outputs.items()]
    if inner:
        outputs += [fin(F.col(f"__n{n.id}")).alias(f"f{n.id}_{n.op}") for n in plan.nodes if f"f{n.id}_{n.op}" not in plan.outputs]
    return df.select(ts, instrument, *keep, *outputs)


def evaluate_sources(plan: LogicalPlan | FactorRequest | list[str] | str, sources: list[DataFrame]) -> DataFrame:
    """(ts, instrument, outputs) at the times of any source, for plans over several sources that don't tick together.

    Fields meet as of each time, their last values carried forward; a pair window over raw fields of two sources takes
    each one's last samples by position, on its own clock. Each panel has (instrument, ts, its fields), a row an event.
    """
    from .operators.event_clock import on_own_clocks, pair_window
    from .sources.panel import align, carry_forward

    plan = plan if isinstance(plan, LogicalPlan) else compile_request(plan)
    wanted = {f.column for f in plan.fields}
    missing = wanted - {c for p in sources for c in p.columns}
    if missing:
        raise MissingField(min(missing).replace("__", "."))
    slim = [p.select("instrument", "ts", *[F.col(c).cast("double").alias(c) for c in p.columns if c in wanted]) for p in sources]
    # an invalid window is NaN, a sample that hides the valid one before it
    windows = [pair_window(n, slim, "value").select("instrument", "ts", F.coalesce("value", F.lit(float("nan"))).alias(f"__n{n.id}")) for n in plan.nodes if on_own_clocks(n)]
    panel = carry_forward(align([p for p in slim if len(p.columns) > 2] + windows))
    panel = panel.withColumns({c: fin(F.col(c)) for w in windows for c in w.columns[2:]})
    df = Evaluator().run(plan, panel)
    return df.select("ts", "instrument", *[fin(_column(r)).alias(name) for name, r in plan.outputs.items()])


def long_form(frame: DataFrame, outputs: list[str], instrument: str = "instrument", ts: str = "ts") -> DataFrame:
    """(output, instrument, ts, value): a row for each factor and cell."""
    return frame.unpivot([instrument, ts], outputs, "output", "value").select("output", instrument, ts, "value")
