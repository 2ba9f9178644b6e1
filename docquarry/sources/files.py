"""Scanning folders into rows, registering contents, and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources import formats

READ = "path string, file_path string, kind string, status string, text string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, size, modification time, SHA-256 and bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), "content")


def read_files(files: DataFrame) -> DataFrame:
    """Texts of scanned files; archives and mailboxes give a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(path, *r) for r in formats.read(content.as_py() or b"", path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], [x.split()[0] for x in READ.split(", ")])

    return files.select("path", "content").mapInArrow(run, READ)


def register(known: DataFrame, found: DataFrame) -> DataFrame:
    """The content table after an import: (hash, size, first path), new hashes added.

    A snapshot, not an update: what is known stays as it is, new rows come by an anti-join.
    """
    new = found.groupBy("hash").agg(F.first("size").alias("size"), F.min("path").alias("path"))
    return known.unionByName(new.join(known, "hash", "left_anti").select(*known.columns))


def replace_keys(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with all rows of the keys in ``new`` replaced by ``new``'s."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def retain(table: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than so many days; 0 keeps everything, and undated rows stay."""
    return table if days == 0 else table.where(F.col(column).isNull() | (F.col(column) >= F.date_sub(as_of, days)))


def merge_watermark(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """Readers' marks (reader, last_id), which never go back."""
    return marks.unionByName(seen).groupBy("reader").agg(F.max("last_id").alias("last_id"))


def safe_cell(column: Column) -> Column:
    """A spreadsheet cell that no program takes for a formula."""
    return F.when(column.rlike(r"^[\s\x00-\x1f]*[=+\-@]"), F.concat(F.lit("'"), column)).otherwise(column)


def export(df: DataFrame, path: str, kind: str = "csv", cap: int = 50_000) -> bool:
    """Writes at most ``cap`` rows; whether there were more. Texts are made safe for csv."""
    held = df.limit(cap + 1).cache()  # a stated cap on what a person downloads
    more = held.count() > cap
    out = held.limit(cap)
    if kind == "csv":
        out = out.select(*(safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes))
        out.write.option("header", "true").mode("overwrite").csv(path)
    elif kind == "json":
        out.write.mode("overwrite").json(path)
    else:
        out.write.mode("overwrite").parquet(path)
    held.unpersist()
    return more
