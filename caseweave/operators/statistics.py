"""Statistics of the log and of its activities, as totals and as running values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.ordered import running_sums


def log_metrics(log: DataFrame) -> DataFrame:
    """One row: events, first and last time, distinct cases (counted per case first)."""
    return log.agg(
        F.count("*").alias("Event_counter"),
        F.min("ts").alias("Log_start_timestamp"),
        F.max("ts").alias("Log_end_timestamp"),
        F.count_distinct("case_id").alias("Counter_trace_id"),
    )


def running_log_metrics(log: DataFrame) -> DataFrame:
    """The log metrics as they stood after each event, in time order.

    Events of one time and number are in the order of their cases. Events without a case are
    one case of their own.
    """
    events = log.select("case_id", "ts", "seq", F.lit(1).alias("_event"))
    # The opening of a case is a row of its own, just before the first event: one per case, whatever the ties.
    openings = (
        events.groupBy("case_id")
        .agg(F.min(F.struct("ts", "seq")).alias("_first"))
        .select("case_id", F.col("_first.ts").alias("ts"), F.col("_first.seq").alias("seq"), F.lit(0).alias("_event"))
    )
    start = events.select(F.min("ts").alias("_start")).scalar()
    return running_sums(
        events.unionByName(openings),
        [],
        ["ts", "seq", "case_id", "_event"],
        {"Event_counter": F.col("_event"), "Counter_trace_id": 1 - F.col("_event")},
    ).filter("_event = 1").select(
        "Event_counter",
        start.alias("Log_start_timestamp"),
        F.col("ts").alias("Log_end_timestamp"),
        "Counter_trace_id",
    )


def activity_frequency(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("activity").alias("Activity")).agg(F.count("*").alias("Frequency"))


def traces_per_activity(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("activity").alias("Activity")).agg(F.count_distinct("case_id").alias("Trace_count"))


def activity_statistics(log: DataFrame) -> DataFrame:
    """Frequency and number of traces per activity."""
    return log.groupBy(F.col("activity").alias("Activity")).agg(
        F.count("*").alias("Frequency"), F.count_distinct("case_id").alias("Trace_count")
    )


def statistics_feed(log: DataFrame) -> DataFrame:
    """Both kinds of statistics in one relation; fields of the other kind are NULL."""
    return log_metrics(log).unionByName(activity_statistics(log), allowMissingColumns=True)


def latest(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The last row (per key) in ``order``: a combinable aggregate, not a sort."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    grouped = df.groupBy(*keys).agg(newest) if keys else df.agg(newest)
    return grouped.select("_row.*")


def deduplicated(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Distinct rows; with ``order``, distinct in the other columns and the last one kept."""
    if not order:
        return df.distinct()
    return latest(df, order, [c for c in df.columns if c not in order])


def relation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A fixed-column view; columns that are not there become NULL."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in columns])


# The columns of the three result kinds.
LOG_METRIC_COLUMNS = ("Event_counter", "Log_start_timestamp", "Log_end_timestamp", "Counter_trace_id")
ACTIVITY_COLUMNS = ("Activity", "Frequency", "Trace_count")
MODEL_COLUMNS = (
    "Constraint",
    "Data Condition",
    "# Activations No Data",
    "Fulfilment Ratio No Data",
    "# Activations Data",
    "Fulfilment Ratio Data",
)


def by_frequency(activities: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = activities.orderBy(F.desc("Frequency"), "Activity")
    return ordered.limit(limit) if limit else ordered


def record_kind() -> Column:
    """Which of the three kinds a decoded record is."""
    return (
        F.when(F.col("Event_counter").isNotNull(), "log_metrics")
        .when(F.col("Activity").isNotNull(), "activity")
        .when(F.col("`Fulfilment Ratio No Data`").isNotNull(), "model")
        .otherwise("unknown")
    )
