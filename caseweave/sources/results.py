"""Result records as JSON lines: append, and read runs back for the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "`Constraint` string, `Data Condition` string, `# Activations No Data` long, "
    "`Fulfilment Ratio No Data` double, `# Activations Data` long, `Fulfilment Ratio Data` string"
)


def append_results(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)


def write_result_batch(records: DataFrame, folder: str, batch_id: int) -> None:
    """For ``foreachBatch``: a repeated batch replaces its own lines instead of adding to them."""
    records.write.mode("overwrite").json(f"{folder}/batch_id={batch_id}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of one or many files (globs allowed) in the columns the reports use.

    ``file`` labels the run. ``run`` orders the lines of a file; it is made of the position
    Spark reads them at, so it is only meaningful within one file.
    """
    raw = spark.read.schema(RECORD_SCHEMA).json(path)
    return raw.select(
        F.col("`Constraint`").alias("constraint"),
        F.col("`Data Condition`").alias("condition"),
        F.col("`# Activations No Data`").alias("n_activations"),
        F.col("`Fulfilment Ratio No Data`").alias("ratio"),
        F.col("`# Activations Data`").alias("n_activations_data"),
        F.col("`Fulfilment Ratio Data`").try_cast("double").alias("ratio_data"),
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("run"),
    )


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """The result files under ``path``, sorted; empty ones too. Only the listing is read, not the lines."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).distinct().orderBy("file")
