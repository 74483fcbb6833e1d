"""Day layout of fact tables: one folder per day, so windows read only their days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, day

FOLDER = "day"


def write_by_day(df: DataFrame, path: str, ts: str, mode: str = "append", max_rows: int = 5_000_000) -> None:
    """Store a fact partitioned by the UTC day of ``ts`` and sorted by it.

    Days are spread over tasks by range, so a heavy day is cut into several files instead of one task.
    """
    dated = df.withColumn(FOLDER, day(ts))
    ranged = dated.repartitionByRange(FOLDER, ts).sortWithinPartitions(FOLDER, ts)
    ranged.write.mode(mode).option("maxRecordsPerFile", max_rows).partitionBy(FOLDER).parquet(path)


def read_days(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the days from that of ``first`` to that of ``last`` (either may be open)."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(FOLDER) >= first - first % DAY)
    if last is not None:
        df = df.where(F.col(FOLDER) <= last - last % DAY)
    return df.drop(FOLDER)


def sessions_overlapping(spark: SparkSession, path: str, a: int, b: int) -> DataFrame:
    """Stored sessions that overlap ``[a, b]``: later days are not listed, earlier ones are cut by the end's statistics."""
    return read_days(spark, path, last=b).where((F.col("session_end") >= a) & (F.col("session_start") <= b))
