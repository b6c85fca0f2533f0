"""Log and activity statistics of a stream: Spark's own aggregations, one snapshot per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseweave.streaming.tables import latest_batch, write_batch

#: Schemas of the snapshots, which are also what a stream without a batch so far gives.
ACTIVITIES = "Activity string, Frequency long, first timestamp, last timestamp"
SPREAD = "Activity string, Trace_count long"
CASES = "Counter_trace_id long"


class StreamStatistics:
    """Three queries over one source: events per activity, traces per activity, traces.

    Sums, extremes and the (case, activity) seen so far are state of Spark's streaming
    aggregation and ``dropDuplicates``; nothing is added up here. The queries run in complete
    mode: a micro-batch delivers the whole result, a row per activity, and writes it to a
    folder named by its id, so a batch that is run again replaces its own snapshot.

    Distinct traces need the set of traces seen; its size grows with them, as it must.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def start(self, log: DataFrame, checkpoint: str, *, trigger: dict | None = None) -> list[StreamingQuery]:
        events = log.select("case_id", F.col("activity").alias("Activity"), "ts")
        sights = events.select("case_id", "Activity").dropDuplicates(["case_id", "Activity"])
        results = {
            "activities": events.groupBy("Activity").agg(
                F.count("*").alias("Frequency"), F.min("ts").alias("first"), F.max("ts").alias("last")),
            "spread": sights.groupBy("Activity").agg(F.count("*").alias("Trace_count")),
            "cases": events.select("case_id").dropDuplicates(["case_id"]).agg(F.count("*").alias("Counter_trace_id")),
        }
        return [
            rows.writeStream.outputMode("complete")
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .foreachBatch(self._snapshot(name))
            .trigger(**(trigger or {"processingTime": "10 seconds"}))
            .start()
            for name, rows in results.items()
        ]

    def _snapshot(self, name: str):
        path = f"{self.folder}/{name}"
        return lambda result, batch_id: write_batch(result.coalesce(1), path, batch_id)

    def _latest(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        found = latest_batch(spark, f"{self.folder}/{name}")
        return spark.createDataFrame([], schema) if found is None else found

    def log_metrics(self, spark: SparkSession) -> DataFrame:
        """One row, as of the last batch: events, first and last time, traces (0 and NULL before the first)."""
        cases = self._latest(spark, "cases", CASES)
        return self._latest(spark, "activities", ACTIVITIES).agg(
            F.coalesce(F.sum("Frequency"), F.lit(0)).alias("Event_counter"), F.min("first").alias("Log_start_timestamp"),
            F.max("last").alias("Log_end_timestamp"),
        ).withColumn("Counter_trace_id", F.coalesce(cases.select("Counter_trace_id").scalar(), F.lit(0)))

    def activity_statistics(self, spark: SparkSession) -> DataFrame:
        """Activity, Frequency, Trace_count; events without an activity have a row of their own."""
        frequency = self._latest(spark, "activities", ACTIVITIES).select("Activity", "Frequency")
        spread = self._latest(spark, "spread", SPREAD).withColumnRenamed("Activity", "_of")
        joined = frequency.join(spread, F.col("Activity").eqNullSafe(F.col("_of")), "left")
        return joined.select("Activity", "Frequency", "Trace_count")
