"""Lossy counting over a stream: the batch operator's outcome, micro-batch by micro-batch.

Events are numbered through all batches in the order of arrival (in time order within a batch).
A tracked case is one row: the sum s = f + d of its frequency and its error. At the end of a bucket
the cases with s no larger than its number are forgotten, so the table never has more than
``1 / epsilon * log(epsilon * events)`` rows, however many cases there are: it is written whole with
every batch. With the last sum s of a case known, the i-th event of the case in a batch is passed
on exactly if max(s, largest b_j - j before it) is larger than its own b_i - i (see
``operators.sampling``, where s is nothing).

Each batch writes its events, its counter and its tracked cases to folders named by its id, and
starts from the folders of the batches before; a batch that is run again after a failure, or a
stream that is started again, gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseweave.operators.sampling import bucket_width
from caseweave.plans.ordered import keyed_scan, number_rows
from caseweave.session import temporary_tables
from caseweave.streaming.tables import batch_ids, write_batch


@dataclass
class LossySampling:
    """``folder`` holds the tables; it must be visible to all executors."""

    folder: str
    epsilon: float = 0.2
    hot_rows: int | None = None

    def start(self, log: DataFrame, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
        """Run on a streaming log with case_id, ts and seq."""
        writer = log.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            self._process(batch, batch_id)

    def _before(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        ids = [b for b in batch_ids(spark, f"{self.folder}/{name}") if b < batch_id]
        return spark.read.parquet(f"{self.folder}/{name}/batch_id={ids[-1]}") if ids else None

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark, width = batch.sparkSession, bucket_width(self.epsilon)
        counted, tracked = self._before(spark, "counted", batch_id), self._before(spark, "tracked", batch_id)
        offset = counted.head().n if counted is not None else 0
        numbered = number_rows(batch, ["ts", "seq", "case_id"]).withColumn("n", F.col("n") + offset)
        numbered = numbered.withColumn("bucket", F.ceil(F.col("n") / width).cast("long"))
        slack = F.col("bucket") - F.col("_nth")
        scanned = keyed_scan(numbered, ["case_id"], ["n"], before={"_best": ("max", slack)}, position="_nth", hot_rows=self.hot_rows)
        if tracked is None:
            tracked = spark.createDataFrame([], "case_id string, s long")
        known = tracked.select(F.col("case_id").alias("_of"), F.col("s").alias("_s"))
        met = scanned.join(F.broadcast(known), F.col("case_id").eqNullSafe(F.col("_of")), "left").withColumn("_best", F.greatest("_best", "_s"))
        events = met.withColumn("_kept", F.col("_best") > slack).withColumn("_sum", F.col("_nth") + F.greatest("_best", slack))
        # Written once, with the sums; the rows passed on and the cases to track are read from here.
        done = write_batch(events.drop("_best", "_nth", "_of", "_s"), f"{self.folder}/events", batch_id)
        total = offset + done.count()
        write_batch(spark.createDataFrame([(total,)], "n long"), f"{self.folder}/counted", batch_id)
        last = done.groupBy("case_id").agg(F.max("_sum").alias("s"))
        still = tracked.join(last.select(F.col("case_id").alias("_of")), F.col("case_id").eqNullSafe(F.col("_of")), "left_anti")
        write_batch(still.unionByName(last).filter(F.col("s") > total // width), f"{self.folder}/tracked", batch_id)

    def sampled(self, spark: SparkSession) -> DataFrame:
        """The events passed on so far, with their number ``n`` and ``bucket``."""
        return spark.read.parquet(f"{self.folder}/events").filter("_kept").drop("_kept", "_sum", "batch_id")

    def tracked(self, spark: SparkSession) -> DataFrame:
        """The cases tracked after the last batch: case_id and s."""
        return self._before(spark, "tracked", 1 << 62)
