"""Intermediate tables and small frame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors are one process, may go without it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="noteflow-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    Cuts lineage on storage that outlives executors; later reads prune columns.
    """
    path = f"{scratch_dir(df.sparkSession)}/noteflow-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables made by ``store``, when all that reads them has been stored itself."""
    for df in stored:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python tasks take at most ``rows`` rows at a time from here on: whole texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_rows(df: DataFrame, order: list[Column], name: str, weight: str | None = None, running: str | None = None) -> DataFrame:
    """Add ``name``, the 0-based place of each row in the total order ``order``.

    Rows are dealt by range and written once; the counts of the ranges give each range its
    offset.  No task holds more than its range, and only one row per range is broadcast.
    With ``weight``, ``running`` gets the sum of that column over the rows before this one.
    ``order`` should end in a key that tells rows apart: equal rows stay in one range.
    """
    bits = (1 << 33) - 1
    placed = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "order")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    if weight:
        inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_sum", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *([F.sum(weight).alias("_w")] if weight else []))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                            *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0")] if weight else []))
    out = placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_n0") + F.col("_at").bitwiseAND(F.lit(bits)))
    if weight:
        out = out.withColumn(running, F.col("_w0") + F.col("_sum"))
    return out.drop("_at", "_range", "_n0", "_sum", "_w0")
