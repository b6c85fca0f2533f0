"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash or be read."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def is_held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pack(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct: names added beside it cannot clash with them."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts one at a time, null as empty, so that a batch is never a list of Python strings at once."""
    for value in batch.column(column):
        yield value.as_py() or ""


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the folder all executors share; later reads start from there.

    Spark deletes them with the last reference where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
