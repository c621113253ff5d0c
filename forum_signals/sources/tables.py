"""Stored tables and reports: Parquet in and out, CSV reports, named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.session import lean_writes
from forum_signals.sources.schemas import enforce


def write_table(
    df: DataFrame, path: str, schema: T.StructType | None = None, partition_by: str | None = None
) -> DataFrame:
    """Create or replace a Parquet table and return it as read back (which cuts lineage)."""
    if schema is not None:
        df = enforce(df, schema)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    with lean_writes(df.sparkSession):
        writer.parquet(path)
    return read_table(df.sparkSession, path, schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table; with a declared schema its columns come in declared order and type."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Create or replace a catalog table bucketed by ``key``.

    The question tables are joined on ``question_id`` by every later job; with equal bucket
    counts those joins need no shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet").option("compression", "snappy")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def write_report(df: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    """A result table as one CSV file with a header, in the order ``df`` is sorted.

    Reports are bounded by topics x categories, so a single file is safe. ``columns`` renames
    columns to published headers.
    """
    if columns:
        df = df.withColumnsRenamed(columns)
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make frames available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows`` for each given table."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    report = counts[0]
    for one in counts[1:]:
        report = report.unionByName(one)
    return report
