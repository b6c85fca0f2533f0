"""Session helpers: a local session for tests and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "caseweave", memory: str = "6g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own. ``memory`` leaves room for
    the Python workers beside the JVM."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    """One folder per Python process, deleted when it ends."""
    folder = tempfile.TemporaryDirectory(prefix="caseweave-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local master without the setting gets a temporary folder: there, driver and
    executors are one process. Elsewhere a missing setting is an error, because a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    path = configured or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(_local_folder())
        path = sc.getCheckpointDir()
    return path.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("caseweave_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    root = _scope.get() or f"{shared_dir(spark)}/caseweave"
    return f"{root}/{label}-{uuid.uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession):
    """Frozen tables made inside are deleted at the end; results must be written before.

    Outside of it they stay in the shared folder, as checkpoints do.
    """
    folder = scratch_path(spark, "scope")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freeze(df: DataFrame, label: str = "frozen") -> DataFrame:
    """Write ``df`` to the shared folder once and return the written table.

    Used where a value must not change if a task is retried (row numbers, range blocks) or
    where an iterative job would otherwise recompute its past. Parquet rather than an RDD
    checkpoint: the reader prunes columns and the planner knows the size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
