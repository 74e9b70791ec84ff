"""Stored tables: prepared data written once per content key, and append-only results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import STORE_VERSION, content_hash


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialize(df: DataFrame, base: str, key: str, overwrite: bool = False,
                partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` under ``base/key`` and read it back. A complete table with the key is reused
    without running the plan, unless ``overwrite``."""
    spark, path = df.sparkSession, f"{base}/{key}"
    if overwrite or not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path).select(*df.columns)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table, or a folder of them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def source_key(spark: SparkSession, path: str) -> str:
    """Key of the files under ``path`` as they are now: names, sizes and times of change."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
    files = []
    while found.hasNext():
        f = found.next()
        files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return content_hash({"files": sorted(files), "version": STORE_VERSION})


def _stored_schema(spark: SparkSession, path: str) -> StructType | None:
    """Schema of the data files under ``path``, None where there are none."""
    try:
        return spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows in one write. Data files with other columns are an error, also those of a write that
    did not finish: mixed schemas would make the rows unreadable as one table."""
    stored = _stored_schema(df.sparkSession, path)
    if stored is not None and _shape(stored) != _shape(df.schema):
        raise ValueError(f"{path} holds {_shape(stored)} but the rows have {_shape(df.schema)}; move the old table away first")
    df.write.mode("append").parquet(path)


def _read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV files with a header each, read by name: files are grouped by their header first."""
    heads = (spark.read.text(path, wholetext=True)
             .select(F.input_file_name().alias("file"), F.trim(F.substring_index(F.regexp_replace("value", "\r", ""), "\n", 1)).alias("head"))
             .where("head <> ''").groupBy("head").agg(F.collect_list("file").alias("files")).collect())
    out = spark.createDataFrame([], schema)
    for row in heads:  # one plan per header, of which a result table has a few
        part = spark.read.option("header", "true").option("inferSchema", "false").csv(row["files"])
        own = [F.col(f"`{c}`").cast(t).alias(c) for c, t in _shape(schema) if c in part.columns]
        out = out.unionByName(part.select(*own), allowMissingColumns=True)
    return out


def read_results(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Result rows from a path, folder or glob; columns absent from a file are NULL, and their order in a file
    does not matter. Nothing there means no rows."""
    empty = spark.createDataFrame([], schema)
    try:
        return _read_csv(spark, path, empty.schema) if fmt == "csv" else spark.read.schema(empty.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise


def commit_cells(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write result rows with one partition per cell of ``keys``. Partitions replace those of the same cells and leave others
    alone; they are staged and moved into place as wholes when the job has ended, so a run that is killed leaves whole
    cells or none. The number of cells is the caller's; a cell's rows are dealt to as many tasks as they need."""
    name = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    (rows.withColumn("_cell", F.substring(name, 1, 16)).hint("rebalance", F.col("_cell")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_cell").parquet(path))


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows committed under ``path``; none where nothing is yet."""
    if _stored_schema(spark, path) is None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).select(*schema.fieldNames())
