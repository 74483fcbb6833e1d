"""Ratios, trends and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import MINUTE


def ratio(amount: Column, total: Column, otherwise: float | None = 0.0) -> Column:
    """``amount / total``; ``otherwise`` when the total is zero."""
    return F.when(total != 0, amount.cast("double") / total).otherwise(F.lit(otherwise).cast("double"))


def int_ratio(amount: Column, total: Column, otherwise: int = 0) -> Column:
    """Integer division truncating towards zero, ``otherwise`` when the total is zero."""
    quotient = F.call_function("div", amount.cast("bigint"), F.nullif(total.cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(total != 0, quotient).otherwise(F.lit(otherwise).cast("bigint"))


def truncated(x: Column) -> Column:
    return x.cast("bigint")


def trend(before: Column, after: Column, reversed_: bool = False) -> Column:
    """struct(text = abs difference, direction '+', '-' or null, reversed)."""
    diff = after - before
    return F.struct(
        F.abs(diff).alias("difference"),
        F.when(diff > 0, F.lit("+")).when(diff < 0, F.lit("-")).alias("direction"),
        F.lit(reversed_).alias("reversed"),
    )


def trend_columns(name: str, before: Column, after: Column) -> list[Column]:
    t = trend(before, after)
    return [t["difference"].alias(f"{name}_trend"), t["direction"].alias(f"{name}_direction")]


def grouped_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, width: int = MINUTE, into: str = "quantile"
) -> DataFrame:
    """Exact interpolated quantile per key without gathering a key in one task.

    Values are counted per (key, value), the counts are summed per coarse value range, the range holding
    the wanted rank is found on that summary, and only its values are ordered.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_range", F.floor(F.col("_v") / width))
    )
    by_range = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    position = F.col("_total").cast("double") * p - p
    wanted = (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_rn"))
        .select(
            *keys,
            "_range",
            "_rn",
            F.coalesce(F.sum("_rn").over(by_range), F.lit(0)).alias("_before"),
            F.sum("_rn").over(Window.partitionBy(*keys)).alias("_total"),
        )
        .withColumn("_lo", F.floor(position))
        .withColumn("_hi", F.ceil(position))
        .withColumn("_frac", position - F.floor(position))
        .where((F.col("_before") <= F.col("_hi")) & (F.col("_lo") < F.col("_before") + F.col("_rn")))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counts.join(wanted, [*keys, "_range"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_range))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )

    def holds(rank: str) -> Column:
        return (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_upto"))

    ends = placed.groupBy(*keys).agg(
        F.max(F.when(holds("_lo"), F.col("_v").cast("double"))).alias("_vlo"),
        F.max(F.when(holds("_hi"), F.col("_v").cast("double"))).alias("_vhi"),
        F.max("_frac").alias("_f"),
    )
    return ends.select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias(into))


def ranked_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, width: int = 1, into: str = "percentile") -> DataFrame:
    """The value at zero-based rank ``floor(n·p) − 1`` of the ordered values; keys whose rank is ≤ 0 are absent."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_range", F.floor(F.col("_v") / width))
    )
    by_range = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_rn"))
        .select(
            *keys,
            "_range",
            "_rn",
            F.coalesce(F.sum("_rn").over(by_range), F.lit(0)).alias("_before"),
            (F.floor(F.sum("_rn").over(Window.partitionBy(*keys)) * F.lit(p)) - 1).alias("_rank"),
        )
        .where((F.col("_rank") > 0) & (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_rn")))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(wanted, [*keys, "_range"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_range))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        .select(*keys, F.col("_v").alias(into))
    )


