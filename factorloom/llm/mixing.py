"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess is shared anew by weight, which is one water level over all sources. A source's
target / words is whole copies, which all its documents take for certain, plus a chance f for one more.

That copy is drawn by Pareto order sampling with unequal probabilities: a document's inclusion odds are f / (1 - f) times
the square root of its size over the source's mean size, so a long document is likelier to come again than a short one, but
not by as much as it is longer. With U uniform from the hash of the row, documents are ranked by U / (1 - U) over
their inclusion odds, and the sample has a fixed size for each source, the words that its target leaves: in rank order a
document is taken if it still fits, until a source lacks at most a thousandth of its target. Where nothing fits any more,
the smallest document that is left is taken if that comes nearer to the target than going without.

Nothing of this depends on the number of sources or on a source's share of the rows: ranks, running sums and the level come
from tables ranged over all partitions, and the table of sources is joined as Spark's own size check finds best.

Defined results: null texts have size 0; documents without words add none, and come as often as
their source's whole copies; equal rows share one rank and one fate, and
count with the words of all; ties in rank go by the hash; no rows give no rows; reruns agree, as ranks depend on the rows
alone; rows with a null id are told apart by their text; other columns, whatever their names, are left out by ``mix`` and
kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, only, running, written

WEIGHTS = (3, 1, 2)
#: The mix holds TOTAL[0] / TOTAL[1] of all words, and at most CAP times a source's words.
TOTAL = (3, 2)
CAP = 2
#: A source is filled when it lacks no more than one NEAR-th of its target.
NEAR = 1000
HEX = 13  # digits of the hash in U: 52 bits


def measures(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """size (words) and key (32 hex digits) of a row: all that the draw needs of it besides its source."""
    text = F.coalesce(text, F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    return F.regexp_count(text, F.lit(WORD)).cast("long"), key


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, key of every row."""
    own = only(docs, doc_id=id_col, text=text_col, source=source_col)
    size, key = measures(F.col("doc_id"), F.col("text"))
    return own.select("doc_id", "source", size.alias("size"), key.alias("key"))


def rank(size: Column, key: Column) -> Column:
    """The Pareto rank of a row beside its source's chance, source_size and filled (documents with words)."""
    u = (F.conv(F.substring(key, 1, HEX), 16, 10).cast("double") + 0.5) / F.lit(float(16**HEX))
    odds = F.col("chance") / (1 - F.col("chance")) * F.sqrt(size / (F.col("source_size") / F.col("filled")))
    return (u / (1 - u)) / odds


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, filled, target, whole, chance from rows of source, size."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("filled"))
    named = sums.withColumn("no_source", F.col("source").isNull())
    by_name = running(named, ["no_source", "source"], [], "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("row") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = written(by_name.select("source", "no_source", "source_size", "filled", weight.alias("weight")), "mix-weights")
    # below the water level a source gets all it may have; the level is that of the first source that it doesn't reach
    filling = running(weighed.withColumn("full_at", CAP * F.col("source_size") / F.col("weight")), ["full_at", "no_source", "source"], ["source_size", "weight"], "mix-levels")
    filling = written(filling, "mix-levels")
    all_words, all_weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(TOTAL[0] * all_words) - TOTAL[1] * CAP * F.col("source_size_before")) / F.lit(float(TOTAL[1])) / (F.lit(all_weight) - F.col("weight_before"))
    reached = filling.select("row", "weight", "source_size", level.alias("level")).where(F.col("level") * F.col("weight") <= CAP * F.col("source_size"))
    first = reached.agg(F.min(F.struct("row", "level")).alias("m")).first()["m"]
    most = (F.col("source_size") * CAP).cast("double")
    target = F.when(F.col("row") < first["row"], most).otherwise(F.lit(first["level"]) * F.col("weight")) if first else most
    told = filling.select("source", "source_size", "filled", target.alias("target"))
    some = F.col("source_size") > 0
    whole = F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("long")
    told = told.withColumn("whole", whole)
    return told.withColumn("chance", F.when(some & (F.col("whole") < CAP), F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")


def _round(ordered: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass down the ranks of each source of ``state`` (source, free, near). ordered: rows with mass, mass_before in the
    order of ranks. Rows with what is free before them, and where the pass ends: at the first row that doesn't fit
    (skipped), or once no more than ``near`` is free."""
    starts = ordered.groupBy("source").agg(F.min("mass_before").alias("start"))
    state = written(with_source(starts, state), "mix-state")
    rows = with_source(ordered, state).withColumn("free", F.col("free") - (F.col("mass_before") - F.col("start")))
    full, near = F.col("mass") > F.col("free"), F.col("free") <= F.col("near")
    end = F.struct("row", "place", F.col("q").alias("end_q"), F.col("key").alias("end_key"), "free", "near", (full & ~near).alias("skipped"))
    ends = rows.where(full | near).groupBy("source").agg(F.min(end).alias("m")).select("source", "m.*")
    return rows, written(ends.withColumnRenamed("row", "end_row"), "mix-ends")


def draw(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows: a table of source, size, key. A row for each source: target, whole and chance, and (end_q, end_key), the rank before
    which all are drawn, if there is an end; and the (source, key) that are drawn beyond it, if any."""
    sources = written(targets(rows), "mix-targets")
    drawn = with_source(rows.where("size > 0"), sources.where("chance > 0"))
    ranked = drawn.groupBy("source", "key", rank(F.col("size"), F.col("key")).alias("q")).agg(F.sum("size").alias("mass"))
    order = ["no_source", "source", "q", "key"]
    ordered = running(ranked.withColumn("no_source", F.col("source").isNull()), order, ["mass"], "mix-ranks")
    ordered = written(ordered.withColumn("place", F.col("row")), "mix-order")
    state = sources.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("free"), (F.col("target") / NEAR).alias("near"))
    _, first = _round(ordered, state)
    # what doesn't fit is passed over, and the ranks below it are gone through for what does: a few rounds, as what is free shrinks
    ends, beyond = first, None
    while (still := ends.where("skipped").select("source", F.col("place").alias("after"), "free", "near")).take(1):
        left = with_source(ordered.drop("row", "mass_before"), still).where((F.col("place") > F.col("after")) & (F.col("mass") <= F.col("free"))).drop("after", "free", "near")
        passed, ends = _round(written(running(left, order, ["mass"], "mix-left"), "mix-left"), still.drop("after"))
        taken = passed.join(ends.select(F.col("source").alias("e_source"), "end_row"), F.col("source").eqNullSafe(F.col("e_source")), "left")
        taken = taken.where(F.col("end_row").isNull() | (F.col("row") < F.col("end_row"))).select("source", "key", "mass")
        beyond = taken if beyond is None else beyond.unionByName(taken)
        beyond = written(beyond, "mix-beyond")
    # nothing fits any more: the smallest one that comes nearer to the target than going without
    if beyond is not None:
        sums = beyond.groupBy("source").agg(F.sum("mass").alias("got")).withColumnRenamed("source", "g_source")
        short = first.where("skipped").join(sums, F.col("source").eqNullSafe(F.col("g_source")), "left").select("source", "place", "near", (F.col("free") - F.coalesce("got", F.lit(0))).alias("short"))
        short = written(short.withColumnRenamed("place", "after").where(F.col("short") > F.col("near")), "mix-short")
        had = beyond.select(F.col("source").alias("h_source"), F.col("key").alias("h_key"))
        rest = with_source(ordered, short).where((F.col("place") >= F.col("after")) & (F.col("mass") < 2 * F.col("short")))
        rest = rest.join(had, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("key") == F.col("h_key")), "left_anti")
        last = rest.groupBy("source").agg(F.min(F.struct("mass", "place", "key")).alias("m")).select("source", "m.key", "m.mass")
        beyond = written(beyond.unionByName(last).select(F.col("source").alias("b_source"), F.col("key").alias("b_key")), "mix-beyond")
    ends = first.select(F.col("source").alias("e_source"), "end_q", "end_key")
    return written(sources.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source"), "mix-draw"), beyond


def copies(rows: DataFrame, drawn: DataFrame, beyond: DataFrame | None) -> DataFrame:
    """rows with source, size, key -> the same with source_size, target, copies."""
    t = with_source(rows, drawn).withColumn("q", F.when((F.col("chance") > 0) & (F.col("size") > 0), rank(F.col("size"), F.col("key"))))
    again = F.col("end_q").isNull() | (F.col("q") < F.col("end_q")) | ((F.col("q") == F.col("end_q")) & (F.col("key") < F.col("end_key")))
    if beyond is not None:
        t = t.join(beyond, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("key") == F.col("b_key")), "left")
        again = again | F.col("b_key").isNotNull()
    return t.withColumn("copies", F.col("whole") + F.coalesce(F.col("q").isNotNull() & again, F.lit(False)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-rows")
    got = copies(rows, *draw(rows.drop("doc_id")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. Texts stay where they lie; nothing is shuffled by id."""
    drawn = draw(written(sized(docs, id_col, text_col, source_col).drop("doc_id"), "mix-rows"))
    size, key = measures(F.col(id_col), F.col(text_col))
    wide = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    taken = copies(wide, *drawn).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
