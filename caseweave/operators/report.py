"""Comparison of control-flow and data-aware ratios over result records.

Records: ``constraint, condition, n_activations, ratio, n_activations_data, ratio_data`` and an
order column that says which of two equal records came first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def above_ratio(records: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    return records.filter(F.col("ratio_data") > min_ratio)


def best_run(records: DataFrame, order: str = "run") -> DataFrame:
    """Per constraint the record with most activations, the first one on ties."""
    rank = F.struct("n_activations", -F.col(order))
    return (
        records.groupBy("constraint").agg(F.max_by(F.struct(*records.columns), rank).alias("_row")).select("_row.*")
    )


def with_difference(records: DataFrame) -> DataFrame:
    """``diff`` = ratio without data minus ratio with data (both have 3 places, so has it)."""
    return records.withColumn("diff", F.round(F.col("ratio") - F.col("ratio_data"), 3))


def compared(records: DataFrame, min_ratio: float = 0.0, order: str = "run") -> DataFrame:
    return with_difference(best_run(above_ratio(records, min_ratio), order))


def summary(differences: DataFrame) -> DataFrame:
    d = F.col("diff")
    return differences.agg(
        F.count("*").alias("total"),
        F.count_if(d > 0).alias("higher_without_data"),
        F.count_if(d < 0).alias("higher_with_data"),
        F.count_if(d == 0).alias("ties"),
    )


def describe(differences: DataFrame) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles, maximum of ``diff``.

    Counted per value first: with 3 places there are at most 2001 values, so the exact
    percentiles never see more than that.
    """
    per_value = differences.groupBy("diff").agg(F.count("*").alias("c"))
    n, total = F.sum("c"), F.sum(F.col("diff") * F.col("c"))
    squares = F.sum(F.col("diff") * F.col("diff") * F.col("c"))
    quartiles = F.percentile("diff", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c"))
    variance = F.greatest((F.col("_s") - F.col("_t") * F.col("_t") / F.col("count")), F.lit(0.0)) / (F.col("count") - 1)
    return per_value.agg(
        n.alias("count"), total.alias("_t"), squares.alias("_s"),
        F.min("diff").alias("min"), F.max("diff").alias("max"), quartiles.alias("_q"),
    ).select(
        "count",
        F.round(F.col("_t") / F.col("count"), 6).alias("mean"),
        F.round(F.sqrt(F.when(F.col("count") > 1, variance)), 6).alias("std"),
        "min",
        F.round(F.col("_q")[0], 6).alias("p25"),
        F.round(F.col("_q")[1], 6).alias("p50"),
        F.round(F.col("_q")[2], 6).alias("p75"),
        "max",
    )


def histogram(differences: DataFrame, bins: int = 20, column: str = "diff") -> DataFrame:
    """Counts in equal-width bins over [min, max]; the last bin is closed. One value, one bin."""
    # Ratios have three places: a few thousand different values, counted first, hold the bounds as well.
    values = differences.groupBy(F.col(column).alias("_x")).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy()
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    slot = F.when(lo == hi, F.lit(1)).otherwise(F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins)))
    return (
        values.select("_x", "_n", F.min("_x").over(everything).alias("_lo"), F.max("_x").over(everything).alias("_hi"))
        .groupBy(slot.cast("long").alias("bin"))
        .agg(F.sum("_n").alias("n"))
    )


def ranked(differences: DataFrame, sign: int = -1) -> DataFrame:
    """Records with a positive (``sign`` 1, largest first) or negative (-1, smallest first) diff."""
    chosen = F.col("diff") > 0 if sign > 0 else F.col("diff") < 0
    order = F.desc("diff") if sign > 0 else F.asc("diff")
    return differences.filter(chosen).orderBy(order, "constraint")


def extremes(differences: DataFrame, key: str = "constraint", order: str = "run") -> DataFrame:
    """Lowest and highest record by ``diff`` per key; once if they are the same record."""
    row = F.struct(*differences.columns)
    low = F.min_by(row, F.struct("diff", order)).alias("low")
    high = F.max_by(row, F.struct("diff", order)).alias("high")
    return (
        differences.groupBy(key)
        .agg(low, high)
        .select(F.inline(F.array_distinct(F.array("low", "high"))))
    )
