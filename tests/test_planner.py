import pytest

from factorloom.errors import CompileError, EmptyRequest, InvalidArity, InvalidExpression, MissingField, UnknownOperator, UnsupportedField
from factorloom.operators.registry import OPS
from factorloom.plans.planner import FactorRequest, compile_request
from factorloom.sources.panel import bind, check_accessors


def plan(*exprs, **kw):
    return compile_request(FactorRequest(list(exprs), **kw))


def test_registry():
    assert len(OPS) == 62


def test_equal_nodes_are_shared():
    p = plan("ts_mean(close, 3) + volume", "volume + ts_mean(close, 3)", "ts_mean(close, 3)")
    assert len(p.nodes) == 2 and p.outputs["f0_elem_add"] == p.outputs["f1_elem_add"] and p.manifest.shared >= 2


def test_terms_are_ordered():
    assert len(plan("close + open + volume", "volume + (close + open)").nodes) == 2
    assert len(plan("ts_corr(close, volume, 5)", "ts_corr(volume, close, 5)").nodes) == 1
    assert len(plan("ts_beta(close, volume, 5)", "ts_beta(volume, close, 5)").nodes) == 2


def test_no_ops_of_derived_inputs_go():
    assert len(plan("ts_mean(close, 3) * 1 + 0").nodes) == 1
    assert len(plan("close * 1").nodes) == 1


def test_constants_fold():
    p = plan("ts_mean(close, 2 + 3)")
    assert p.nodes[0].param("window") == 5
    assert plan("close + 1 / 0").nodes  # a division by zero stays a node


def test_aliases_and_names():
    p = plan("close + open", "open + close", outputs=["a", "b"])
    assert p.manifest.aliases == 1 and set(p.outputs) == {"a", "b"}
    with pytest.raises(InvalidExpression):
        plan("close + open", "close - open", outputs=["a", "a"])


@pytest.mark.parametrize("text", ["close", "1", "", "close +", "close ** 2", "(close", "ts_mean(3, 2)", "cs_rank(1)", "ts_mean(close, 0)", "ts_mean(close, 1.5)", "ts_quantile(close, 3, 1.5)", "a.b.c + 1", "nope.x + 1", "cs_winsorize(close, 0.7)", "cs_neutralize(close, group=3)", "cs_neutralize(close, by=volume)", "close % 2"])
def test_rejected(text):
    with pytest.raises(InvalidExpression):
        plan(text)


@pytest.mark.parametrize("name", ["ts_delay", "log", "if_else", "Pow"])
def test_only_canonical_names(name):
    with pytest.raises(UnknownOperator):
        plan(f"{name}(close, 1)")


def test_arity_and_empty():
    with pytest.raises(InvalidArity):
        plan("ts_mean(close)")
    with pytest.raises(EmptyRequest):
        plan()
    with pytest.raises(CompileError):
        plan("close + 1", outputs=["a", "b"])


def test_precedence():
    a, b = plan("close + open * 2 < volume & high > low"), plan("((close + (open * 2)) < volume) & (high > low)")
    assert [(n.op, n.inputs) for n in a.nodes] == [(n.op, n.inputs) for n in b.nodes]
    assert plan("close < open < volume").nodes[1].op == "elem_lt"
    assert plan("-close").nodes[0].op == "elem_mul" and plan("~close").nodes[0].op == "elem_not"


def test_look_back_and_execution():
    p = plan("ts_mean(ts_lag(close, 4), 10)", "cs_rank(close)", "ts_mean(cs_rank(close), 3)", "bar.close - quote_tick.bid_price")
    assert p.look_back() == 13
    by = {n.op: p.execution(n) for n in p.nodes}
    assert by["ts_lag"] == "event" and by["cs_rank"] == "batch" and by["elem_sub"] == "barrier"


def test_binding():
    p = plan("bar.vwap + 1")
    assert bind(p, {"vwap"}) and bind(p, {"bar.vwap"})
    with pytest.raises(MissingField):
        bind(p, {"close"})
    with pytest.raises(UnsupportedField):
        check_accessors(p)
    check_accessors(plan("data.anything + tradetick.price"))
