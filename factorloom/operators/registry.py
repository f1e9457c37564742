"""The 62 operators: name, domain, shape of arguments, and the properties that the planner uses."""

from __future__ import annotations

from dataclasses import dataclass

from . import elem
from .ts import Rolling

#: shapes -> names of the arguments; capital ones are expressions, the others parameters.
SHAPES = {
    "x": ("X",), "xy": ("X", "Y"), "xyz": ("X", "Y", "Z"),
    "window": ("X", "window"), "lag": ("X", "lag"), "pair": ("X", "Y", "window"), "quantile": ("X", "window", "q"),
    "percent": ("X", "p"), "percents": ("X", "low", "high"), "neutral0": ("Y",), "neutral1": ("Y", "X"), "neutral3": ("Y", "X1", "X2", "X3"),
}


@dataclass(frozen=True)
class OpSpec:
    name: str
    domain: str  # elem, ts or cs
    shape: str
    commutative: bool = False
    literals: bool = False  # numbers may stand for inputs

    @property
    def arguments(self) -> tuple[str, ...]:
        return SHAPES[self.shape]


COMMUTATIVE = {"elem_add", "elem_mul", "elem_min", "elem_max", "elem_eq", "elem_ne", "elem_and", "elem_or", "ts_cov", "ts_corr", "ts_ewm_cov"}


def _registry() -> dict[str, OpSpec]:
    shapes: dict[str, str] = {}
    shapes |= dict.fromkeys(elem.UNARY, "x") | dict.fromkeys([*elem.BINARY, "elem_fillna"], "xy") | dict.fromkeys(elem.TERNARY, "xyz")
    rolling = Rolling()
    shapes |= dict.fromkeys(rolling.table(), "window") | dict.fromkeys(rolling.pair_table(), "pair") | {"ts_lag": "lag", "ts_delta": "lag", "ts_quantile": "quantile"}
    shapes |= dict.fromkeys(("cs_rank", "cs_zscore", "cs_center", "cs_scale", "cs_norm", "cs_fillna"), "x")
    shapes |= {"cs_winsorize": "percent", "cs_percentiles": "percents", "cs_neutralize": "neutral0", "cs_neutralize_ols": "neutral1", "cs_neutralize_ols_multi": "neutral3"}
    out = {n: OpSpec(n, n.split("_")[0], s, n in COMMUTATIVE, n.startswith("elem_")) for n, s in shapes.items()}
    counts = {d: sum(o.domain == d for o in out.values()) for d in ("elem", "ts", "cs")}
    if counts != {"elem": 26, "ts": 25, "cs": 11}:
        raise AssertionError(f"the registry is incomplete: {counts}")
    return out


OPS = _registry()
