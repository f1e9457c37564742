"""Factors over event streams: each micro-batch re-uses the batch compiler on a bounded tail of history.

A plan's outputs at one time depend on ``look_back`` earlier rows at most, so that is all the history that a batch needs: the
settled rows of the last grid times, one carried-forward row for each instrument where they begin, and each field's latest
time. They are written to the state folder under the batch's number; a batch that is run again reads the state of the one
before it, so a restart from the stream's checkpoint repeats nothing and loses nothing.

Times are emitted once, in order: with the strict policy when every instrument has every required field up to them, with the
force policy as soon as an event bears them, values carried forward and the rows flagged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..engine import evaluate
from ..errors import EmptyUniverse, NonMonotonicAdvance, NotReady
from ..plans.planner import LogicalPlan
from ..sources import panel as P

Sink = Callable[[DataFrame, int], None]


@dataclass
class FactorStream:
    """plan over events (instrument, ts, arrival, flags, one column a field); ``sink`` gets (ts, instrument, outputs, quality_flags)."""

    spark: SparkSession
    plan: LogicalPlan
    universe: DataFrame
    state: str
    sink: Sink
    policy: str = "strict"

    def __post_init__(self):
        if not self.universe.take(1):
            raise EmptyUniverse()
        if self.policy not in ("strict", "force"):
            raise ValueError("policy must be strict or force")
        P.check_accessors(self.plan)
        self.fields = [f.column for f in self.plan.fields]

    def start(self, events: DataFrame, checkpoint: str, **options):
        """Starts the query on a streaming DataFrame of events."""
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**options).start() if options else writer.start()

    def _read(self, batch: int, part: str) -> DataFrame | None:
        if batch < 0:
            return None
        try:
            return self.spark.read.parquet(f"{self.state}/{batch}/{part}")
        except AnalysisException:
            return None

    def process(self, events: DataFrame, batch: int) -> None:
        """One micro-batch. State of batch - 1 in, state of this batch and the sink's rows out."""
        rows, latest, marks = (self._read(batch - 1, p) for p in ("rows", "latest", "marks"))
        new = P.admit(events, self.universe).select("instrument", "ts", "arrival", F.coalesce("flags", F.lit(0)).cast("int").alias("flags"), *[F.col(f).cast("double") for f in self.fields])
        if latest is not None:
            seen = latest.select("instrument", *[F.col(f).alias(f"__seen_{f}") for f in self.fields])
            fresh = new.join(seen, "instrument", "left").withColumns({f: F.when(F.col(f"__seen_{f}").isNull() | (F.col("ts") >= F.col(f"__seen_{f}")), F.col(f)) for f in self.fields})
            fresh = fresh.drop(*[f"__seen_{f}" for f in self.fields])
        else:
            fresh = new
        settled = P.settle_events(fresh, self.fields)
        if rows is not None:  # a later batch's value replaces the one held for the same time
            both = rows.withColumn("age", F.lit(0)).unionByName(settled.withColumn("age", F.lit(1)))
            settled = both.groupBy("instrument", "ts").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("age"))).alias(f) for f in self.fields])
        now = settled.groupBy("instrument").agg(*[F.max(F.when(F.col(f).isNotNull(), F.col("ts"))).alias(f) for f in self.fields])
        if latest is not None:
            now = now.unionByName(latest).groupBy("instrument").agg(*[F.max(f).alias(f) for f in self.fields])
        now.write.mode("overwrite").parquet(f"{self.state}/{batch}/latest")
        now = self.spark.read.parquet(f"{self.state}/{batch}/latest")

        mark = marks.first() if marks is not None else None
        last = mark["last"] if mark else None
        ready = self._ready(now)
        top = settled.agg(F.max("ts")).first()[0]
        upto = top if self.policy == "force" else ready
        pending = new.select("ts", "instrument", "flags")
        held = self._read(batch - 1, "flags")
        if held is not None:
            pending = held.unionByName(pending)
        times = settled.select("ts").where(F.col("ts") > F.lit(last) if last is not None else F.lit(True)).where(F.col("ts") <= F.lit(upto)).distinct() if upto is not None else None
        newest = times.agg(F.max("ts")).first()[0] if times is not None else None
        if newest is not None:
            grid = P.carry_forward(P.densify(settled, self.universe), self.fields)
            values = evaluate(self.plan, grid).join(times, "ts", "left_semi")
            marked = times.select("ts", (F.col("ts") > F.lit(ready) if ready is not None else F.lit(True)).alias("forced"))
            flags = P.quality_flags(pending, times, self.universe, marked)
            self.sink(values.join(flags, ["ts", "instrument"]), batch)
            # this frame has taken the flags up to it, also of late events; without a frame all of them wait for the next one
            pending = pending.where(F.col("ts") > F.lit(newest))
        self._keep(settled, pending, last if newest is None else newest, batch)

    def _ready(self, latest: DataFrame) -> int | None:
        full = self.universe.select("instrument").distinct().join(latest, "instrument", "left")
        missing = F.greatest(*[F.col(f).isNull().cast("int") for f in self.fields], F.lit(0))
        got = full.agg(F.max(missing).alias("missing"), *[F.min(f).alias(f) for f in self.fields]).first()
        return None if got["missing"] else min(got[f] for f in self.fields)

    def _keep(self, settled: DataFrame, pending: DataFrame, emitted: int | None, batch: int) -> None:
        """Writes the tail: look_back grid times up to the last emitted one, all after, and a carried row where it begins."""
        if emitted is not None:
            past = settled.select("ts").where(F.col("ts") <= F.lit(emitted)).distinct().orderBy(F.desc("ts")).limit(self.plan.look_back() + 1)
            begin = past.agg(F.min("ts")).first()[0]
            base = P.carry_forward(settled.where(F.col("ts") <= F.lit(begin)), self.fields)
            newest = Window.partitionBy("instrument").orderBy(F.desc("ts"))
            base = base.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k").withColumn("ts", F.lit(begin).cast(settled.schema["ts"].dataType))
            tail = base.unionByName(settled.where(F.col("ts") > F.lit(begin)))
        else:
            tail = settled
        tail.select("instrument", "ts", *self.fields).write.mode("overwrite").parquet(f"{self.state}/{batch}/rows")
        pending.write.mode("overwrite").parquet(f"{self.state}/{batch}/flags")
        self.spark.createDataFrame([(emitted,)], "last long").write.mode("overwrite").parquet(f"{self.state}/{batch}/marks")


class Advancer:
    """The one-time-at-a-time interface over settled events: advance(ts) gives the frame of that time.

    Equal times may be asked for again; earlier ones may not. push() adds events that came since: those of times that
    a frame has passed are late, and their flags go with the next frame.
    """

    def __init__(self, plan: LogicalPlan, events: DataFrame, universe: DataFrame, policy: str = "strict"):
        P.check_accessors(plan)
        self.plan, self.policy, self.last = plan, policy, None
        self.fields = [f.column for f in plan.fields]
        self.events, self.universe = P.admit(events, universe), universe
        self.pending = self.events.select("instrument", "ts", "flags")

    def push(self, events: DataFrame) -> None:
        new = P.admit(events, self.universe)
        self.events = self.events.unionByName(new)
        self.pending = self.pending.unionByName(new.select("instrument", "ts", "flags"))

    def advance(self, ts: int) -> DataFrame:
        if self.last is not None and ts < self.last:
            raise NonMonotonicAdvance(ts, self.last)
        known = P.settle_events(self.events.where(F.col("ts") <= ts), self.fields)
        ready = P.readiness(P.settle_events(self.events, self.fields), self.universe, self.fields)
        forced = ready is None or ts > ready
        if forced and self.policy == "strict":
            raise NotReady(ts)
        times = known.sparkSession.createDataFrame([(ts,)], f"ts {known.schema['ts'].dataType.simpleString()}")
        cells = times.crossJoin(self.universe.select("instrument").distinct()).select("instrument", "ts")
        grid = P.carry_forward(P.densify(P.align([known, cells]), self.universe), self.fields)
        own = self.pending.where(F.col("ts") <= ts)
        flags = P.quality_flags(own, times, self.universe, times.withColumn("forced", F.lit(forced)))
        out = evaluate(self.plan, grid).where(F.col("ts") == ts).join(flags, ["ts", "instrument"])
        self.last, self.pending = ts, self.pending.where(F.col("ts") > ts)
        return out


class FactorFrame:
    """A collected frame of one time: values by instrument and factor. For small universes and tests."""

    def __init__(self, frame: DataFrame, outputs: list[str]):
        rows = {r["instrument"]: r for r in frame.collect()}
        self.instruments, self.outputs, self.rows = sorted(rows), outputs, rows

    def factor_index(self, name: str) -> int | None:
        return self.outputs.index(name) if name in self.outputs else None

    def value(self, instrument, name: str) -> float | None:
        return self.rows[instrument][name]

    def is_valid(self, instrument, name: str) -> bool:
        return self.rows[instrument][name] is not None

    def row(self, instrument) -> list[float | None]:
        return [self.rows[instrument][n] for n in self.outputs]

    def factor(self, name: str) -> list[float | None]:
        return [self.rows[i][name] for i in self.instruments]

    def matrix(self) -> list[list[float | None]]:
        return [self.row(i) for i in self.instruments]

    def flags(self, instrument) -> int:
        return self.rows[instrument]["quality_flags"]
