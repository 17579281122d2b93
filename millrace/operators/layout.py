"""Stored order: copies of a table that later joins and groupings on a column need not shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.inspect import estimated_bytes

#: A bucket is one task of a join that rests on the stored order.
BUCKET_BYTES = 128 << 20
#: A bucket with more than so many times the rows of the average one is too much for a task.
SKEW = 4


def buckets_for(*tables: DataFrame) -> int:
    """A power of two for the largest of the tables, by Catalyst's estimate, up to Spark's own limit.

    Of two tables with different powers of two, a join moves only the one with fewer buckets.
    """
    size = max(estimated_bytes(t) for t in tables)
    return 1 << min(16, max(0, (size - 1) // BUCKET_BYTES).bit_length())


def store_sorted(df: DataFrame, table: str, column: str, buckets: int, path: str | None = None) -> None:
    """Write ``df`` in ``buckets`` by ``column``, sorted within each, as a table of the session catalog.

    One task writes one bucket, so there are ``buckets`` files.  Two tables stored with equal
    buckets on their join keys join without an exchange.  Where rows of few keys would fill a bucket
    far beyond the others, the copy has no buckets: it is cut into as many ranges of the column, a
    frequent value (or null) into several, and a join shuffles it and splits what is skewed.
    """
    if buckets > 1 and skewed(df, column, buckets):
        writer = df.repartitionByRange(buckets, column, F.spark_partition_id()).sortWithinPartitions(column).write
    else:
        writer = df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column)
    writer = writer.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def skewed(df: DataFrame, column: str, buckets: int) -> bool:
    """Whether one of the buckets by ``column`` would hold over ``SKEW`` times the average; counts are combined before they move."""
    bucket = F.pmod(F.hash(column), F.lit(buckets))
    fullest, total = df.groupBy(bucket.alias("bucket")).count().agg(F.max("count"), F.sum("count")).first()
    return bool(total) and fullest * buckets > SKEW * total


def stored(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def drop_stored(spark: SparkSession, table: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
