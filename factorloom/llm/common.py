"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six white-space bytes between words; a word is a run of anything else.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, renamed, so that no extra column of the caller can clash with ours."""
    return df.select(*[df[src].alias(dst) for dst, src in columns.items()])


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """mapInArrow over column lists: ``make()`` is called once a task and returns batch -> batch of lists.

    What ``make()`` returns may have a ``release``, called when the task ends: workers live on and must not keep caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_json_string

        out = to_arrow_schema(_parse_datatype_json_string(as_json))
        f = make()
        try:
            for batch in batches:
                # long texts: at most a few MB of Python objects at once
                for part in slices(batch):
                    got = f(part.to_pydict())
                    yield pa.RecordBatch.from_arrays([pa.array(got[c.name], c.type) for c in out], schema=out)
        finally:
            getattr(f, "release", lambda: None)()
            trim()

    from pyspark.sql.types import StructType

    as_json = StructType.fromDDL(schema).json()
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes, one row at least."""
    n = batch.num_rows
    step = n if batch.nbytes <= limit else max(1, n * limit // batch.nbytes)
    for at in range(0, n, max(1, step)):
        yield batch.slice(at, step)


def trim() -> None:
    """Gives memory that a task has freed back to the system, as the worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (driver and
    executors in one process, as in tests) gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="factorloom-")
        sc.setCheckpointDir(at)
        _drop_at_end(spark, f"file://{at}")
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"


def _drop_at_end(spark: SparkSession, to: str) -> None:
    """Deletes the folder when the driver's JVM ends: lazy results may read it until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for an intermediate table; it goes when the driver ends."""
    to = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _drop_at_end(spark, to)
    return to


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and Spark knows its size (it broadcasts small ones by its own check)."""
    spark, to = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder (survives lost executors, cuts the lineage; Spark's cleaner drops it)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """df with ``row``, the number of each row from 0 in the order of the columns named (which must tell all rows apart), and
    ``<sum>_before`` for each column of ``sums``, the sum over all rows before it.

    Rows are ranged by the order over all partitions and kept as a table; only a count and the sums of each partition, one
    row a partition, meet in one place.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    # a row for each partition
    starts = told.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("p_row"), *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"p_{c}") for c in sums])
    own = Window.partitionBy("part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumns({"row": F.row_number().over(own) - 1} | {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    joined = numbered.join(F.broadcast(starts), "part")
    return joined.select(*df.columns, (F.col("row") + F.col("p_row")).alias("row"), *[(F.col(f"{c}_before") + F.col(f"p_{c}")).alias(f"{c}_before") for c in sums])


def fold(column: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts: the fixed folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def hash_sample(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, those of smallest hash ``h`` of the columns named. A first cut by hash keeps somewhat more than
    that in all, so that no task holds ``limit`` rows of its own."""
    n = rows.count()
    hashed = rows.withColumn("h", F.xxhash64(*by))
    share = 1.2 * limit / max(n, 1) + 100 / max(n, 1)
    if share < 1:
        hashed = hashed.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)).cast("long"))
    return hashed.orderBy("h", *by).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, parts: int = 0, held: int = 0) -> DataFrame:
    """At most ``limit`` labelled documents (doc_id, text, y), by hash order of the id, folds equal to ``held`` left out.

    The broadcast side is at most ``limit`` pairs of numbers. A labelled id counts once however often it comes, with its
    first text in order.
    """
    own = labels.select(labels["doc_id"], labels[label].cast("int").alias("y")).where("doc_id is not null and y is not null")
    if parts:
        own = own.where(fold("doc_id", parts) != held)
    picked = hash_sample(own.groupBy("doc_id").agg(F.max("y").alias("y")), ["doc_id"], limit)
    found = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "y")), "doc_id", "inner")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
