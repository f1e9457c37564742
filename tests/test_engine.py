"""One series and some cross-sections, worked out by hand or by the plain evaluator; plans and pieces."""

import math

import numpy as np
import pytest

from factorloom.engine import evaluate
from factorloom.plans.planner import compile_request
from tests import plain

PX, QTY = [8.0, 3.0, 9.5, 9.5, 1.0, 6.0, 7.5, 2.0, 4.0], [20.0, 31.0, 18.0, 25.0, 25.0, 40.0, 12.0, 33.0, 21.0]
#: Values that follow from PX and QTY by a short sum each.
BY_HAND = {
    "ts_lag(px, 2)": [None, None, 8, 3, 9.5, 9.5, 1, 6, 7.5],
    "ts_delta(px, 1)": [None, -5, 6.5, 0, -8.5, 5, 1.5, -5.5, 2],
    "ts_sum(px, 2)": [None, 11, 12.5, 19, 10.5, 7, 13.5, 9.5, 6],
    "ts_max(px, 3)": [None, None, 9.5, 9.5, 9.5, 9.5, 7.5, 7.5, 7.5],
    "ts_std(px, 1)": [None] * 9,
    "px / (qty - qty)": [None] * 9,
    "elem_where(px > 7, qty, 1 - qty)": [20, -30, 18, 25, -24, -39, 12, -32, -20],
    "~(px > 7)": [0, 1, 0, 0, 1, 1, 0, 1, 1],
    "elem_clip(px, 2.5, 8)": [8, 3, 8, 8, 2.5, 6, 7.5, 2.5, 4],
}
PLAIN = [
    "ts_cov(qty, px, 5)", "ts_zscore(qty, 4)", "ts_zscore(ts_delta(px, 1), 5)", "ts_var(ts_sum(qty, 2), 4)", "ts_beta(px, qty, 6)", "ts_beta(qty, px, 5)", "ts_ewm_mean(qty, 4)", "ts_ewm_var(qty, 5)", "ts_ewm_cov(qty, px, 4)",
    "ts_ewm_mean(ts_delta(qty, 2), 3)", "ts_quantile(qty, 5, 0.3)", "ts_quantile(ts_lag(qty, 2), 3, 0.9)", "ts_argmax(px, 3)", "ts_argmin(qty, 5)", "ts_decay_linear(qty, 3)", "ts_product(px, 3)", "ts_mad(qty, 5)", "ts_rank(px, 5)",
    "ts_sum(elem_min(px, qty / 3), 4)", "elem_sign(qty - ts_mean(qty, 4))", "qty >= 25 | px < 2", "elem_fillna(elem_div(px, qty - qty), 1.5)",
]


def near(got, want):
    return (got is None and want is None) or (got is not None and want is not None and math.isclose(got, want, rel_tol=1e-8, abs_tol=1e-9))


def test_series(spark):
    df = spark.createDataFrame([(1, t, c, v) for t, (c, v) in enumerate(zip(PX, QTY))], "instrument int, ts int, bar__px double, bar__qty double")
    panel = {"px": np.array([PX]), "qty": np.array([QTY])}
    wanted = dict(BY_HAND)
    for expr in PLAIN:
        wanted[expr] = [float(v) if np.isfinite(v) else None for v in plain.evaluate(expr, panel)[0]]
    names = [f"o{k}" for k in range(len(wanted))]
    rows = evaluate(compile_request(list(wanted), names), df).orderBy("ts").collect()
    for name, (expr, want) in zip(names, wanted.items()):
        for r, w in zip(rows, want, strict=True):
            assert near(r[name], w), (expr, r["ts"], r[name], w)


NAN, INF = float("nan"), float("inf")
SECTIONS = [
    ([(-INF,), (4.0,)], "cs_rank(px)", [None, 0.0]),
    ([(7.0,), (3.0,), (11.0,)], "cs_center(px)", [0, -4, 4]),
    ([(6.0,), (-2.0,), (NAN,)], "cs_center(px)", [4, -4, None]),
    ([(6.0,), (-2.0,), (2.0,)], "cs_scale(px)", [0.6, -0.2, 0.2]),
    ([(5.0,), (9.0,), (NAN,), (6.0,)], "cs_norm(px)", [0, 1, None, 0.25]),
    ([(5.0,), (9.0,), (INF,)], "cs_fillna(px)", [5, 9, 7]),
    ([(0.0,), (10.0,), (20.0,), (30.0,), (100.0,)], "cs_winsorize(px, 0.25)", [10, 10, 20, 30, 30]),
    # a straight line leaves no residuals; regressors that can't be told apart explain nothing
    ([(1.0, 2.0), (5.0, 4.0), (9.0, 6.0)], "cs_neutralize_ols(px, qty)", [0, 0, 0]),
    ([(1.0, 2.0), (6.0, 4.0), (8.0, 6.0)], "cs_neutralize_ols_multi(px, qty, qty)", [-4, 1, 3]),
    # within each group the mean, weighted, goes
    ([(4.0, 0.0, 3.0), (8.0, 0.0, 1.0), (1.0, 1.0, 1.0), (2.0, 1.0, 1.0)], "cs_neutralize(px, group=qty, weights=top)", [-1, 3, -0.5, 0.5]),
    ([(4.0, 0.0, 3.0), (8.0, 0.0, 5.0), (1.0, 1.0, 1.0), (2.0, 1.0, 9.0)], "cs_neutralize_ols(px, top, group=qty)", [0, 0, 0, 0]),
]


@pytest.mark.parametrize("rows,expr,want", SECTIONS)
def test_sections(spark, rows, expr, want):
    filled = [(k, 1, *(list(r) + [0.0] * 3)[:3]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(filled, "instrument int, ts int, bar__px double, bar__qty double, bar__top double")
    got = [r["v"] for r in evaluate(compile_request([expr], ["v"]), df).orderBy("instrument").collect()]
    assert all(near(g, w) for g, w in zip(got, want)), got


def test_missing_and_invalid_samples_differ(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, float("nan")), (1, 3, 4.0)], "instrument int, ts int, bar__close double")
    got = evaluate(compile_request(["elem_fillna(close, 7)", "close + 1", "elem_exp(close)"], ["f", "a", "e"]), df).orderBy("ts").collect()
    assert [r["f"] for r in got] == [None, 7.0, 4.0] and [r["a"] for r in got] == [None, None, 5.0]
    assert got[0]["e"] is None and near(got[2]["e"], math.exp(4))


def test_one_exchange_for_windows_of_a_level(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "instrument int, ts int, bar__close double")
    plan = evaluate(["ts_mean(close, 3)", "ts_std(close, 5)", "ts_max(close, 20)"], df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = evaluate(["cs_rank(close)", "cs_zscore(close)", "cs_norm(close)"], df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_series_in_pieces(spark):
    rows = [(0, t, float((t * 37) % 101)) for t in range(900)] + [(i, t * i, float(t * i % 7)) for i in (1, 2) for t in range(50)]
    df = spark.createDataFrame(rows, "instrument int, ts int, bar__close double")
    exprs = ["ts_mean(ts_lag(close, 3), 5)", "ts_rank(close, 9) + close"]
    whole = evaluate(exprs, df).collect()
    for size in (4, 64):
        assert sorted(map(repr, evaluate(exprs, df, piece_rows=size).collect())) == sorted(map(repr, whole))
    with pytest.raises(ValueError):
        evaluate(["cs_rank(close)"], df, piece_rows=10)
