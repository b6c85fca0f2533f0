"""Ordinary tables read as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.eventlog import canonical_log


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_log(table(spark, folder, "events"))


def events_as_log(events: DataFrame) -> DataFrame:
    """Users as cases, event types as activities."""
    return canonical_log(
        events,
        case_id="user_id",
        activity="event_type",
        ts="ts",
        seq="event_id",
        attrs={"value": "value", "k": F.get_json_object("props", "$.k")},
    )


def orders_log(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as cases, order priorities as activities."""
    return canonical_log(
        table(spark, folder, "orders"),
        case_id="o_custkey",
        activity="o_orderpriority",
        ts="o_orderdate",
        seq="o_orderkey",
        attrs={"o_totalprice": "o_totalprice", "o_orderstatus": "o_orderstatus"},
    )


def conversations_log(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as cases, roles as activities; the turn is the clock, in seconds from a
    fixed day (not from 1970, where a stream's watermark starts)."""
    return canonical_log(
        table(spark, folder, "conversations"),
        case_id="conv_id",
        activity="role",
        ts=F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2000-01-01"))) + F.col("turn")),
        seq="turn",
        attrs={"n": F.length("text")},
    )
