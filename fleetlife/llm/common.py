"""Shared pieces: what a word is, written intermediate tables, and global numbering.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. Null text has no words.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

GAP = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array (empty for null)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def fold(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: later jobs read it instead of computing
    it again, also after the loss of executors. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    spark = table.sparkSession
    jvm = spark._jvm
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def plain(frame: pd.DataFrame, *texts: str) -> pd.DataFrame:
    """Text columns as Python objects: an empty column, or one of nulls alone, would else be taken for numbers."""
    return frame.astype(dict.fromkeys(texts, object))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the place 0..n-1 of a row in the total order of ``order``, which must identify
    a row. Rows are sorted by range; the sizes of the ranges (one number per task) give each range
    its first place, so that no task sees more than its range. The sorted rows are written first:
    a task that is run again then finds the same ranges."""
    ranged = (df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
              .withColumn("_range", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id()))
    ranged = stored(ranged)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (ranged.join(F.broadcast(starts), "_range")
            .withColumn(name, F.col("_start") + F.col("_row") - F.col("_low"))
            .drop("_range", "_row", "_low", "_start"))
