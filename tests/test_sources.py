import pytest

from factorloom.engine import evaluate
from factorloom.errors import NonMonotonicAdvance, NotReady, PayloadMismatch, UnknownInstrument, UnsupportedField
from factorloom.plans.planner import compile_request
from factorloom.sources import panel as P
from factorloom.streaming.runtime import Advancer, FactorFrame, FactorStream

EVENTS = "instrument int, ts long, arrival long, flags int, bar__close double"


def test_late_and_revised(spark):
    e = spark.createDataFrame([(1, 10, 1, 0, 1.0), (1, 20, 2, 0, 2.0), (1, 10, 3, 0, 9.0), (1, 20, 4, 2, 5.0), (2, 5, 5, 0, 3.0), (2, 6, 6, 0, None)], EVENTS)
    assert sorted(map(tuple, P.settle_events(e, ["bar__close"]).collect())) == [(1, 10, 1.0), (1, 20, 5.0), (2, 5, 3.0)]


def test_carry_keeps_nan(spark):
    p = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, float("nan")), (1, 4, None)], "instrument int, ts long, bar__close double")
    got = [r[2] for r in P.carry_forward(p).orderBy("ts").collect()]
    assert got[:2] == [2.0, 2.0] and got[2] != got[2] and got[3] != got[3]


def test_advance(spark):
    e = spark.createDataFrame([(1, 10, 1, 0, 1.0), (2, 10, 2, 2, 3.0), (1, 20, 3, 0, 2.0)], EVENTS)
    u = spark.createDataFrame([(1,), (2,)], "instrument int")
    plan = compile_request(["cs_center(close)"], ["v"])
    a = Advancer(plan, e, u)
    f = FactorFrame(a.advance(10), ["v"])
    assert f.matrix() == [[-1.0], [1.0]] and f.flags(1) == 0 and f.flags(2) == 2 and f.factor_index("v") == 0 and f.is_valid(1, "v")
    with pytest.raises(NotReady):
        a.advance(20)
    forced = Advancer(plan, e, u, "force")
    forced.advance(10)
    f = FactorFrame(forced.advance(20), ["v"])
    assert f.matrix() == [[-0.5], [0.5]] and f.flags(1) == 1 and f.flags(2) == 1
    with pytest.raises(NonMonotonicAdvance):
        forced.advance(10)


@pytest.mark.parametrize("policy", ["strict", "force"])
def test_stream_equals_batch(spark, tmp_path, policy):
    rows = [(i, t, t * 10 + i, 0, float((i * 7 + t * 3) % 11)) for t in range(1, 9) for i in (1, 2, 3) if (i, t) != (2, 4)]
    u = spark.createDataFrame([(1,), (2,), (3,)], "instrument int")
    plan = compile_request(["cs_rank(ts_mean(close, 3))", "ts_delta(close, 1)"], ["r", "d"])
    got = []
    stream = FactorStream(spark, plan, u, str(tmp_path / "state"), lambda df, k: got.extend(df.select("ts", "instrument", "r", "d").collect()), policy)
    for k, (low, high) in enumerate(((1, 3), (4, 6), (7, 8))):
        stream.process(spark.createDataFrame([r for r in rows if low <= r[1] <= high], EVENTS), k)
    from factorloom.engine import evaluate

    settled = P.settle_events(spark.createDataFrame(rows, EVENTS), ["bar__close"])
    want = evaluate(plan, P.carry_forward(P.densify(settled, u), ["bar__close"])).select("ts", "instrument", "r", "d").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_flags_of_late_events_wait_for_the_next_frame(spark, tmp_path):
    u = spark.createDataFrame([(1,), (2,)], "instrument int")
    got = {}
    stream = FactorStream(spark, compile_request(["close + 0"], ["v"]), u, str(tmp_path / "state"), lambda df, k: got.update({(r["ts"], r["instrument"]): r["quality_flags"] for r in df.collect()}))
    batches = [[(1, 1, 1, 0, 1.0), (2, 1, 2, 0, 1.0), (1, 2, 3, 0, 1.0), (2, 2, 4, 4, 1.0)], [(1, 1, 5, 2, 9.0)], [(2, 2, 6, 8, 1.0)], [(1, 3, 7, 0, 2.0), (2, 3, 8, 0, 2.0)], [(1, 4, 9, 0, 2.0), (2, 4, 10, 0, 2.0)]]
    for k, rows in enumerate(batches):
        stream.process(spark.createDataFrame(rows, EVENTS), k)
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 0, (2, 2): 4, (3, 1): 2, (3, 2): 8, (4, 1): 0, (4, 2): 0}


def test_flags_pushed_late_go_with_the_next_frame(spark):
    u = spark.createDataFrame([(1,)], "instrument int")
    a = Advancer(compile_request(["close + 0"], ["v"]), spark.createDataFrame([(1, 10, 1, 0, 1.0)], EVENTS), u)
    assert FactorFrame(a.advance(10), ["v"]).flags(1) == 0
    a.push(spark.createDataFrame([(1, 5, 2, 2, 7.0), (1, 20, 3, 4, 3.0)], EVENTS))
    f = FactorFrame(a.advance(20), ["v"])
    assert f.flags(1) == 6 and f.matrix() == [[3.0]]
    a.push(spark.createDataFrame([(1, 30, 4, 0, 3.0)], EVENTS))
    assert FactorFrame(a.advance(30), ["v"]).flags(1) == 0


def test_windows_by_position_inside_a_plan(spark):
    from factorloom.engine import evaluate_sources

    bars = spark.createDataFrame([(1, t, x) for t, x in ((1, 1.0), (2, 4.0), (5, 2.0), (9, float("nan")), (10, 3.0))], "instrument int, ts long, bar__close double")
    quotes = spark.createDataFrame([(1, t, x) for t, x in ((3, 2.0), (4, 6.0), (7, 1.0))], "instrument int, ts long, quote_tick__bid_price double")
    got = {r["ts"]: (r["v"], r["d"]) for r in evaluate_sources(compile_request(["ts_cov(bar.close, quote_tick.bid_price, 2) + bar.close", "bar.close - quote_tick.bid_price"], ["v", "d"]), [bars, quotes]).collect()}
    # the last two closes against the last two bids, whatever their times
    assert got == {1: (None, None), 2: (None, None), 3: (None, 2.0), 4: (4 + 6.0, -2.0), 5: (2 - 4.0, -4.0), 7: (2 + 5.0, 1.0), 9: (None, None), 10: (None, 2.0)}


def test_structured_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(i, t, t, 0, float(i * t)) for t in (1, 2, 3) for i in (1, 2)], EVENTS).coalesce(1).write.parquet(str(src))
    u = spark.createDataFrame([(1,), (2,)], "instrument int")
    got = []
    s = FactorStream(spark, compile_request(["ts_sum(close, 2)"], ["v"]), u, str(tmp_path / "state"), lambda df, k: got.extend(df.collect()))
    q = s.start(spark.readStream.schema(EVENTS).parquet(str(src)), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert sorted((r["ts"], r["instrument"], r["v"]) for r in got) == [(1, 1, None), (1, 2, None), (2, 1, 3.0), (2, 2, 6.0), (3, 1, 5.0), (3, 2, 10.0)]


def test_json_rows(spark):
    plan = compile_request(["close + data.cap"], ["v"])
    lines = ['{"ts": 1, "instrument_slot": 1, "fields": {"close": 2.0, "data.cap": 3.0, "other": 1.0}}', '{"ts": 2, "instrument_slot": 1, "fields": {"close": null, "data.cap": 3.0}}', '{"ts": 3, "instrument_slot": 1, "fields": {"close": 2.0}}']
    rows = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("from_json(line, 'ts long, instrument_slot int, fields map<string, double>') as r").select("r.*")
    panel = P.from_field_maps(rows, plan)
    got = sorted((r["ts"], r["bar__close"], r["data__cap"]) for r in panel.collect())
    assert got[0] == (1, 2.0, 3.0) and got[1][1] != got[1][1] and got[2][2] is None
    assert [r["v"] for r in evaluate(plan, panel).orderBy("ts").collect()] == [5.0, None, None]


def test_rejections(spark):
    e = spark.createDataFrame([(1, 1, 1, 0, 1.0), (9, 1, 1, 0, 1.0)], EVENTS)
    u = spark.createDataFrame([(1,)], "instrument int")
    with pytest.raises(UnknownInstrument):
        P.reject_unknown(e, u)
    assert P.admit(e, u).count() == 1 and P.check_payload(e, "bar") is e
    with pytest.raises(PayloadMismatch):
        P.check_payload(e, "quote_tick")
    with pytest.raises(UnsupportedField):
        P.check_payload(e.withColumn("bar__vwap", P.F.lit(1.0)), "bar")


@pytest.mark.parametrize("name", ["source_forced_grid", "source_late_and_revised"])
def test_ties_of_arrival_do_not_hang_on_the_order_of_rows(spark, tmp_path, name):
    """Event numbers 100,003 apart arrive together; the SQL leaves their order open, so it is held here with the order that settle_events states."""
    import duckdb

    from factorloom.plans.queries import ORACLE_SQL, QUERIES

    rows = [(k + 100_003 * n, (k * 5 + n * 3) % 11 * 43_200 + n, k % 3, ("view", "error")[(k + n) % 2], float(k * 7 + n * 13 % 5)) for k in range(12) for n in range(4)]
    sql = ORACLE_SQL[name].replace("order by arrival rows", "order by arrival, ts rows").replace("arg_max(value, arrival)", "arg_max(value, (arrival, value))")
    assert sql.count("arrival, ts rows") == sql.count("(arrival, value)") == 1
    for k, some in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: r[4]))):
        d = f"{tmp_path}/{k}"
        e = spark.createDataFrame(some, "event_id long, s long, user_id long, event_type string, value double").coalesce(1)
        e.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(f"{d}/events.parquet")
        con = duckdb.connect()
        con.sql(f"create view events as select * from '{d}/events.parquet/*.parquet'")
        columns = sorted(con.sql(sql).columns)
        got = sorted(map(repr, map(tuple, QUERIES[name](spark, d).select(*columns).collect())))
        assert got == sorted(map(repr, con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()))


def test_events_without_a_value_or_a_number_count_as_in_the_sql(spark, tmp_path):
    """An event without a value makes older ones late and keeps its half day; one without a number comes last. No two of a user arrive together here."""
    import duckdb

    from factorloom.plans.queries import ORACLE_SQL, QUERIES

    rows = [(None if k >= 57 else k, k * 5 % 19 * 43_200, k % 3, "view", None if k % 4 == 1 else float("nan") if k % 7 == 0 else float(k)) for k in range(60)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    e.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(map(repr, con.sql(f"select ts, instrument, value from ({ORACLE_SQL['source_late_and_revised']})").fetchall()))
    got = sorted(map(repr, map(tuple, QUERIES["source_late_and_revised"](spark, str(tmp_path)).select("ts", "instrument", "value").collect())))
    assert got == want and any(r.endswith("None)") for r in got)
