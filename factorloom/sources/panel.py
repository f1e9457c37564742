"""Panels from events: sources aligned on (instrument, ts), last values carried forward, readiness and quality flags.

An event is a row (source, instrument, ts, arrival, flags, one column a field); ``arrival`` orders events as they came. Per
field and instrument, an event older than one that came before it is dropped, and of several with one ts the last to
come counts. Events of one arrival came in the order of ts, so that none is late against another, then of the field's value:
the result depends on the events alone, not on the order in which rows are read. NULL in a field column means that the event doesn't carry the field; NaN is a received invalid value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptyUniverse, MissingField, NotReady, PayloadMismatch, UnknownInstrument, UnsupportedField
from ..plans.planner import FieldRef, LogicalPlan

#: Fields of typed sources; "data" carries any name.
TYPED = {
    "bar": ("open", "high", "low", "close", "volume"),
    "trade_tick": ("price", "size"),
    "quote_tick": ("bid_price", "ask_price", "bid_size", "ask_size"),
    "orderbook_snapshot": (),
}
FORCED, REVISION = 1, 2


def bind(plan: LogicalPlan, catalog: set[str]) -> list[FieldRef]:
    """The plan's raw fields, if the catalog (bare or prefixed names) has them all."""
    names = {c.lower() for c in catalog}
    for f in plan.fields:
        if f.name not in names and f"{f.source}.{f.name}" not in names:
            raise MissingField(f"{f.source}.{f.name}")
    return plan.fields


def check_accessors(plan: LogicalPlan) -> None:
    for f in plan.fields:
        if f.source in TYPED and f.name not in TYPED[f.source]:
            raise UnsupportedField(f.source, f.name)


def data_columns(events: DataFrame, values: str, fields: list[str]) -> DataFrame:
    """Columns ``data__<name>`` from a map column of named values; names that no plan asks for are left out."""
    return events.select("*", *[F.try_element_at(F.col(values), F.lit(n)).cast("double").alias(f"data__{n}") for n in fields]).drop(values)


def from_table(df: DataFrame, source: str, instrument: str | Column, ts: str | Column, **fields: str | Column) -> DataFrame:
    """A panel of one source from a table: (instrument, ts, <source>__<field>...)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(instrument).alias("instrument"), col(ts).alias("ts"), *[col(c).cast("double").alias(f"{source}__{f}") for f, c in fields.items()])


def from_field_maps(rows: DataFrame, plan: LogicalPlan, instrument: str = "instrument_slot", fields: str = "fields") -> DataFrame:
    """A panel from rows (instrument, ts, map of named values), as exchanged in JSON: names are bare or ``source.field``.

    A name that is there with a null value is an invalid sample; a name that isn't there is no sample.
    """
    m = F.col(fields)

    def value(f: FieldRef) -> Column:
        names = [f"{f.source}.{f.name}", f.name]
        return F.coalesce(*[F.when(F.map_contains_key(m, n), F.coalesce(F.try_element_at(m, F.lit(n)).cast("double"), F.lit(float("nan")))) for n in names])

    return rows.select(F.col(instrument).alias("instrument"), "ts", *[value(f).alias(f.column) for f in plan.fields])


def reject_unknown(events: DataFrame, universe: DataFrame) -> DataFrame:
    """events, or an error that names an instrument outside the universe."""
    other = events.join(universe.select("instrument").distinct(), "instrument", "left_anti").select("instrument").take(1)
    if other:
        raise UnknownInstrument(f"instrument {other[0][0]} is not in the universe")
    return events


def check_payload(events: DataFrame, source: str) -> DataFrame:
    """events of one source, or an error if they carry another source's fields."""
    own = set(TYPED) | {"data"}
    if source not in own:
        raise PayloadMismatch(f"unknown source {source!r}")
    for c in events.columns:
        kind, _, name = c.partition("__")
        if name and kind in own and kind != source:
            raise PayloadMismatch(f"column {c!r} in events of source {source!r}")
        if name and kind == source and kind in TYPED and name not in TYPED[kind]:
            raise UnsupportedField(source, name)
    return events


def admit(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Events of known instruments only. The universe joins as Spark sees fit: broadcast while it is small."""
    if not universe.take(1):
        raise EmptyUniverse()
    return events.join(universe.select("instrument").distinct(), "instrument", "left_semi")


def settle_events(events: DataFrame, fields: list[str], all_count: bool = False) -> DataFrame:
    """One row for each (instrument, ts): late values dropped, revisions settled, by field. Events without an arrival come last and settle nothing.

    all_count: events with NULL in a field count for its order of times too, and their (instrument, ts) stays, with NULL where no value came.
    """
    before = Window.partitionBy("instrument").orderBy(F.asc_nulls_last("arrival"), "ts").rowsBetween(Window.unboundedPreceding, -1)
    seen = {f: F.max(F.when(F.lit(all_count) | F.col(f).isNotNull(), F.col("ts"))).over(before) for f in fields}
    on_time = {f: seen[f].isNull() | (F.col("ts") >= seen[f]) for f in fields}
    fresh = events.select("instrument", "ts", "arrival", *[F.when(on_time[f], F.col(f)).alias(f) for f in fields], on_time[fields[0]].alias("on_time"))
    last = [F.max(F.when(F.col(f).isNotNull() & F.col("arrival").isNotNull(), F.struct("arrival", F.col(f).alias("value"))))["value"].alias(f) for f in fields]
    if all_count:  # on_time is the same for every field
        return fresh.where("on_time").groupBy("instrument", "ts").agg(*last)
    return fresh.groupBy("instrument", "ts").agg(*last).where(" or ".join(f"`{f}` is not null" for f in fields))


def align(panels: list[DataFrame]) -> DataFrame:
    """Panels of several sources side by side: a row for each (instrument, ts) of any, NULL where a source has none.

    A union and one aggregation, not a chain of outer joins: one exchange for any number of sources.
    """
    fields = [c for p in panels for c in p.columns if c not in ("instrument", "ts")]
    wide = panels[0]
    for p in panels[1:]:
        wide = wide.unionByName(p, allowMissingColumns=True)
    return wide.groupBy("instrument", "ts").agg(*[F.first(c, ignorenulls=True).alias(c) for c in fields])


def carry_forward(panel: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Each field's latest value at or before the row; NaN is a value, NULL is not."""
    fields = fields or [c for c in panel.columns if c not in ("instrument", "ts")]
    w = Window.partitionBy("instrument").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def densify(panel: DataFrame, universe: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """A row for every instrument of the universe at every ts of the grid (the panel's own if none is given)."""
    grid = (panel.select("ts") if times is None else times.select("ts")).distinct()
    cells = grid.crossJoin(universe.select("instrument").distinct())
    return cells.join(panel, ["instrument", "ts"], "left")


def readiness(settled: DataFrame, universe: DataFrame, fields: list[str]) -> int | None:
    """The last ts up to which every instrument has every required field; none if one never came."""
    if not fields:
        return 2**63 - 1
    latest = settled.groupBy("instrument").agg(*[F.max(F.when(F.col(f).isNotNull(), F.col("ts"))).alias(f) for f in fields])
    full = universe.select("instrument").distinct().join(latest, "instrument", "left")
    least = F.least(*[F.col(f) for f in fields]) if len(fields) > 1 else F.col(fields[0])
    some = F.greatest(*[F.col(f).isNull().cast("int") for f in fields]) if len(fields) > 1 else F.col(fields[0]).isNull().cast("int")
    got = full.agg(F.max(some).alias("missing"), F.min(least).alias("ts")).first()
    return None if got["missing"] else got["ts"]


def advance_grid(settled: DataFrame, universe: DataFrame, times: DataFrame, fields: list[str], policy: str = "strict") -> tuple[DataFrame, DataFrame]:
    """The panel to evaluate at the times asked for, and the times themselves as (ts, forced).

    strict: times beyond the readiness are refused. force: they are evaluated with the values carried forward, flagged.
    """
    ready = readiness(settled, universe, fields)
    bound = F.lit(ready) if ready is not None else F.lit(None)
    marked = times.select("ts", F.coalesce(F.col("ts") > bound, F.lit(True)).alias("forced")).distinct()
    if policy == "strict":
        late = marked.where("forced").agg(F.min("ts")).first()[0]
        if late is not None:
            raise NotReady(late)
    panel = densify(align([settled, times.crossJoin(universe.select("instrument").distinct()).select("instrument", "ts")]), universe)
    return carry_forward(panel, fields), marked


def quality_flags(events: DataFrame, times: DataFrame, universe: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(ts, instrument, quality_flags): flags of the events since the advance before, late ones included; FORCED where it was.

    The advance that an event counts for is the next time of the grid: the last one met in one union ordered backward.
    """
    grid = times.select("ts").distinct().crossJoin(universe.select("instrument").distinct())
    both = events.select("instrument", "ts", "flags", F.lit(None).cast(times.schema["ts"].dataType).alias("at")).unionByName(grid.select("instrument", "ts", F.lit(0).alias("flags"), F.col("ts").alias("at")))
    w = Window.partitionBy("instrument").orderBy(F.desc("ts"), F.col("at").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, 0)  # backward: a frame to the end is rescanned for each row
    own = both.withColumn("at", F.last("at", ignorenulls=True).over(w)).where("at is not null").groupBy(F.col("at").alias("ts"), "instrument").agg(F.bit_or("flags").alias("quality_flags"))
    if forced is None:
        return own
    return own.join(forced, "ts", "left").select("ts", "instrument", (F.col("quality_flags").bitwiseOR(F.when(F.col("forced"), FORCED).otherwise(0))).alias("quality_flags"))
