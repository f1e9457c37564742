"""Random expressions over the whole registry against the plain evaluator."""

import random

import numpy as np
import pytest

from factorloom.engine import evaluate
from factorloom.operators.registry import OPS
from factorloom.plans.planner import compile_request
from tests import plain

LEAVES = ("px", "qty", "top", "gap")
#: Operators for what stands inside another: of values that stay apart from one another.
INSIDE = ("elem_add", "elem_sub", "elem_mul", "ts_mean", "ts_lag", "ts_delta", "ts_sum", "ts_ewm_mean", "cs_center", "cs_rank", "cs_norm", "elem_abs", "elem_fillna")


def inner(r, depth):
    if depth == 0 or r.random() < 0.25:
        return r.choice(LEAVES)
    return call(r, r.choice(INSIDE), depth - 1)


#: Operators that tell equal values from others: rounding decides on values that are equal but for it.
SHARP = ("ts_rank", "ts_argmax", "ts_argmin", "cs_rank", "cs_percentiles", "elem_to_int", "elem_sign")


def call(r, op, depth):
    x = lambda: inner(r, depth) if op not in SHARP else r.choice((*LEAVES, "px * qty", "top - gap"))
    shape = OPS[op].shape
    if shape == "window":
        return f"{op}({x()}, {r.randint(3, 9)})"
    if shape == "lag":
        return f"{op}({x()}, {r.randint(1, 4)})"
    if shape == "pair":
        return f"{op}({x()}, {r.choice(LEAVES[:3])}, {r.randint(4, 9)})"
    if shape == "quantile":
        return f"{op}({x()}, {r.randint(3, 8)}, {r.choice((0.1, 0.35, 0.5, 0.8))})"
    if shape == "percent":
        return f"{op}({x()}, {r.choice((0.05, 0.15, 0.3))})"
    if shape == "percents":
        return f"{op}({x()}, {r.choice((0.1, 0.25))}, {r.choice((0.6, 0.9))})"
    if shape.startswith("neutral"):
        regressors = {"neutral0": [], "neutral1": ["qty"], "neutral3": ["qty", "px", "top"][: r.randint(2, 3)]}[shape]
        extra = r.sample(["group=data.part", "weights=top"], r.randint(0, min(2, 3 - len(regressors)))) + r.choice(([], ["standardize=1"]))
        return f"{op}({', '.join([x(), *regressors, *extra])})"
    return f"{op}({', '.join(x() for _ in OPS[op].arguments)})"


def panel(n=8, t=40, seed=17):
    r = np.random.default_rng(seed)
    px = 20 * np.exp(r.normal(0, 0.05, (n, t)).cumsum(axis=1))
    gap = np.where(r.random((n, t)) < 0.1, np.nan, r.uniform(-3, 3, (n, t)))
    gap[2, 11], gap[5, 30] = -np.inf, np.inf
    return {"px": px, "qty": r.uniform(10, 90, (n, t)), "top": px + r.uniform(0.1, 2, (n, t)), "gap": gap, "part": np.repeat(np.arange(n)[:, None] % 2 * 1.0, t, axis=1)}


def cases(seed):
    r = random.Random(seed)
    return [call(r, op, 2) for op in sorted(OPS)]


@pytest.mark.parametrize("seed", [101, 202])
def test_expressions(spark, seed):
    p = panel()
    n, t = p["px"].shape
    names = {k: f"data__{k}" if k == "part" else f"bar__{k}" for k in p}
    rows = [(i, k, *(float(v[i, k]) for v in p.values())) for i in range(n) for k in range(t)]
    df = spark.createDataFrame(rows, "instrument int, ts int, " + ", ".join(f"{c} double" for c in names.values()))
    exprs = cases(seed)
    for start in range(0, len(exprs), 8):
        some = exprs[start : start + 8]
        outs = [f"o{k}" for k in range(len(some))]
        got = {(r["instrument"], r["ts"]): r for r in evaluate(compile_request(some, outs), df).collect()}
        for o, e in zip(outs, some, strict=True):
            want = plain.evaluate(e, p)
            own = np.array([[got[(i, k)][o] if got[(i, k)][o] is not None else np.nan for k in range(t)] for i in range(n)])
            assert (np.isfinite(own) == np.isfinite(want)).all(), (e, np.argwhere(np.isfinite(own) != np.isfinite(want))[:3])
            assert np.allclose(own, want, rtol=1e-6, atol=1e-7, equal_nan=True), (e, np.nanmax(np.abs(own - want)))
