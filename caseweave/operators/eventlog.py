"""The canonical event log and operators on single events and traces.

Columns: ``case_id STRING, activity STRING, ts TIMESTAMP, seq LONG, attrs MAP<STRING,STRING>,
is_end BOOLEAN``. ``(ts, seq)`` is the order inside a case; ``seq`` keeps the source order
of events with equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.scalars import parse_timestamp
from caseweave.plans.ordered import keyed_scan

LOG_COLUMNS = ("case_id", "activity", "ts", "seq", "attrs", "is_end")
ORDER = ("ts", "seq")


def canonical_log(
    df: DataFrame,
    *,
    case_id: str | Column,
    activity: str | Column,
    ts: str | Column,
    seq: str | Column,
    attrs: dict[str, str | Column] | None = None,
    is_end: Column | None = None,
) -> DataFrame:
    """Map any table to the canonical log. Absent attribute values stay out of the map."""

    def column(c):
        return F.col(c) if isinstance(c, str) else c

    entries = [F.struct(F.lit(k).alias("k"), column(v).cast("string").alias("v")) for k, v in (attrs or {}).items()]
    bag = (
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
        if entries
        else F.create_map().cast("map<string,string>")
    )
    return df.select(
        column(case_id).cast("string").alias("case_id"),
        column(activity).cast("string").alias("activity"),
        column(ts).cast("timestamp").alias("ts"),
        column(seq).cast("long").alias("seq"),
        bag.alias("attrs"),
        (F.lit(None).cast("boolean") if is_end is None else is_end).alias("is_end"),
    )


def from_wire(wire: DataFrame, seq: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Wire events to (log, rejects). Rejects are the events whose time cannot be read.

    ``seq`` should be the source position (Kafka offset, line number); without it, ties in
    time have no defined order.
    """
    parsed = wire.withColumn("_ts", parse_timestamp(F.col("time_timestamp")))
    end = F.lower(F.col("eventAttributes")["is_end_event"]) == "true"
    log = parsed.filter(F.col("_ts").isNotNull()).select(
        F.coalesce("case_concept_name", F.lit("")).alias("case_id"),
        F.coalesce("concept_name", F.lit("")).alias("activity"),
        F.col("_ts").alias("ts"),
        (F.lit(0).cast("long") if seq is None else seq.cast("long")).alias("seq"),
        F.map_filter("eventAttributes", lambda k, v: (k != "is_end_event") & v.isNotNull()).alias("attrs"),
        F.coalesce(end, F.lit(False)).alias("is_end"),
    )
    return log, parsed.filter(F.col("_ts").isNull()).drop("_ts")


def to_wire(log: DataFrame) -> DataFrame:
    """Log to wire events: all texts, ISO times, ``:`` in attribute names becomes ``_``.

    Names that become alike are one attribute, with the value of the last of them by name.
    """
    with_end = F.map_concat(
        F.map_filter("attrs", lambda k, _: k != "is_end_event"),
        F.create_map(
            F.lit("is_end_event"),
            F.when(F.coalesce("is_end", F.lit(False)), F.lit("True")).otherwise(F.lit("False")),
        ),
    )
    renamed = F.transform(
        F.array_sort(F.map_entries(with_end)),
        lambda e: F.struct(F.replace(e["key"], F.lit(":"), F.lit("_")).alias("key"), e["value"].alias("value")),
    )
    # Only names with a colon can become alike; a map without one is taken as it is.
    has_colon = F.exists(F.map_keys("attrs"), lambda k: F.contains(k, F.lit(":")))
    log = log.withColumn("_renamed", F.when(has_colon, renamed))
    last = F.filter(
        "_renamed", lambda e, i: ~F.exists(F.slice("_renamed", i + 2, F.size("_renamed")), lambda later: later["key"] == e["key"])
    )
    safe = F.when(F.col("_renamed").isNotNull(), F.map_from_entries(last)).otherwise(with_end)
    return log.select(
        F.coalesce("case_id", F.lit("")).alias("case_concept_name"),
        F.coalesce("activity", F.lit("")).alias("concept_name"),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit("")).alias("time_timestamp"),
        F.transform_values(safe, lambda _, v: F.coalesce(v, F.lit(""))).alias("eventAttributes"),
    )


def tag_trace_ends(log: DataFrame, *, hot_rows: int | None = None) -> DataFrame:
    """Set ``is_end`` on the last event of each case, for logs that are complete."""
    scanned = keyed_scan(
        log.drop("is_end"), ["case_id"], ORDER, following={"_next": F.col("seq")}, hot_rows=hot_rows
    )
    return scanned.withColumn("is_end", F.col("_next").isNull()).select(*log.columns)


def time_sorted(log: DataFrame) -> DataFrame:
    """The whole log in time order (a range-partitioned sort)."""
    return log.orderBy(*ORDER, "case_id")


def trace_history(log: DataFrame, chunk: int = 1000, *, hot_rows: int | None = None) -> DataFrame:
    """The activity sequence of each case, cut into chunks of ``chunk`` events.

    The history of the event at position p is its case's chunks up to p: same information as
    one growing list per event, but linear in the log and with arrays of bounded length.
    """
    placed = keyed_scan(log.select("case_id", "activity", *ORDER), ["case_id"], ORDER, hot_rows=hot_rows)
    return (
        placed.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk))
        .groupBy("case_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "activity"))).alias("_events"))
        .select(
            "case_id",
            "chunk",
            F.col("_events")[0]["pos"].alias("start_pos"),
            F.transform("_events", lambda e: e["activity"]).alias("activities"),
        )
    )


def neighbours(log: DataFrame, *, hot_rows: int | None = None) -> DataFrame:
    """Position and the activities immediately before and after, per event."""
    return keyed_scan(
        log,
        ["case_id"],
        ORDER,
        previous={"previous_activity": F.col("activity")},
        following={"next_activity": F.col("activity")},
        hot_rows=hot_rows,
    )
