"""Helpers shared by the operators: reading, cutting lineage, numbering rows."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """A table of the input folder, by Spark's own reader, pruned to ``columns``."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all machines share. Where none is configured, a temporary one in
    local mode; on a cluster that would lose data, so it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docquarry-"))
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``stable`` but as Parquet: smaller on disk, pruned and filtered when read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files of
    finished steps from the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def id_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``row``, its position from 0 in the order of ``order``, and the row count.

    Rows are dealt by range and numbered inside each range; only one count a range reaches
    the driver. Equal rows get different positions: an arrival number splits them, so one
    value repeated over many ranges doesn't gather in a task. ``df`` should be cheap to
    read twice (it is sampled for the ranges).
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie")
    dealt = stable(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("_part")).count().collect()
    starts, total = [], 0
    for part, count in sorted((r["_part"], r["count"]) for r in sizes):
        starts.append((part, total))
        total += count
    offsets = dealt.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    numbered = dealt.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    in_part = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return numbered.withColumn("row", F.col("_start") + in_part).drop("_part", "_start", "_at"), total


def texts_of(batches: Iterator, column: str) -> Iterator[tuple[object, list[str]]]:
    """Arrow batches with the named text column as Python strings, null as empty."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]
