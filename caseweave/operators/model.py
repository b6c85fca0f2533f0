"""The discovered model: result windows, distinct constraints, graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.ordered import number_rows

MODEL_KEY = ("template", "first", "second", "condition")


def count_windows(results: DataFrame, order: Sequence[str], size: int = 10) -> DataFrame:
    """Tumbling windows of ``size`` results in ``order``; an unfilled last window never fires."""
    numbered = number_rows(results, order, "_n").withColumn(
        "window_id", F.floor((F.col("_n") - 1) / size).cast("long")
    )
    # The numbered rows are written down already; the input is not computed a second time.
    total = numbered.select(F.max("_n").alias("_total")).scalar()
    return numbered.filter((F.col("window_id") + 1) * size <= total).drop("_n")


def distinct_model(results: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (template, first, second, condition), per ``keys``; the first kept."""
    group = [*keys, *MODEL_KEY]
    first = F.min_by(F.struct(*results.columns), F.struct(*order)).alias("_row")
    return results.groupBy(*group).agg(first).select("_row.*")


def label_side(template: Column) -> Column:
    """The condition is written at the activation's side of the edge."""
    return F.when(template.contains("Precedence"), F.lit("left")).otherwise(F.lit("right"))


def model_edges(model: DataFrame) -> DataFrame:
    return model.select(
        "template",
        F.col("first").alias("src"),
        F.col("second").alias("dst"),
        "condition",
        label_side(F.col("template")).alias("label_side"),
    ).distinct()


def model_nodes(model: DataFrame) -> DataFrame:
    return model.select(F.explode(F.array("first", "second")).alias("id")).distinct()
