"""Event and result topics: wire events as Avro or files, results as JSON text.

Kafka and Avro need their Spark packages on the class path (``spark-sql-kafka-0-10``,
``spark-avro``); without them the file forms serve the same schema.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseweave.functions.scalars import json_record
from caseweave.operators.eventlog import from_wire
from caseweave.operators.statistics import record_kind

# Topic names and the wire schema.
EVENT_TOPIC = "raw-process-events"
RESULT_TOPIC = "dashboard-result"
WIRE_SCHEMA = (
    "case_concept_name string, concept_name string, time_timestamp string, eventAttributes map<string,string>"
)
AVRO_SCHEMA = json.dumps(
    {
        "type": "record",
        "name": "Event",
        "namespace": "project",
        "fields": [
            {"name": "case_concept_name", "type": "string"},
            {"name": "concept_name", "type": "string"},
            {"name": "time_timestamp", "type": "string"},
            {"name": "eventAttributes", "type": {"type": "map", "values": "string"}, "default": {}},
        ],
    }
)
RESULT_SCHEMA = (
    "Event_counter long, Log_start_timestamp string, Log_end_timestamp string, Counter_trace_id long, "
    "Activity string, Frequency long, Trace_count long, "
    "`Constraint` string, `Data Condition` string, `# Activations No Data` long, "
    "`Fulfilment Ratio No Data` double, `# Activations Data` long, `Fulfilment Ratio Data` string"
)

#: Bytes a schema registry puts before the Avro body.
_REGISTRY_HEADER = 5


def wire_file_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Wire events arriving as files (parquet or json)."""
    reader = spark.readStream.schema(WIRE_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def wire_kafka_stream(
    spark: SparkSession, servers: str, topic: str = EVENT_TOPIC, offsets: str = "earliest", **options
) -> DataFrame:
    """Wire events from a topic of registry-framed Avro, with ``offset`` for the order of ties.

    Offsets are ordered within a partition; key the topic by case to keep a case in one.
    """
    from pyspark.sql.avro.functions import from_avro

    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
        .options(**options)
        .load()
    )
    body = F.expr(f"substring(value, {_REGISTRY_HEADER + 1}, length(value))")
    return raw.select(from_avro(body, AVRO_SCHEMA).alias("e"), "offset").select("e.*", "offset")


def log_stream(wire: DataFrame, seq: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Streaming wire events as (canonical log, rejects)."""
    if seq is None and "offset" in wire.columns:
        seq = F.col("offset")
    return from_wire(wire, seq)


def publish_events(wire: DataFrame, servers: str, schema_id: int, topic: str = EVENT_TOPIC) -> None:
    """Send wire events to a topic as registry-framed Avro under a registered schema id."""
    from pyspark.sql.avro.functions import to_avro

    header = F.unhex(F.lit("00" + format(schema_id, "08x")))
    (
        wire.select(F.concat(header, to_avro(F.struct(*wire.columns), AVRO_SCHEMA)).alias("value"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        # Delivery settings of the event topic.
        .option("kafka.compression.type", "gzip")
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("kafka.retries", "5")
        .save()
    )


def results_to_kafka(results: DataFrame, servers: str, topic: str = RESULT_TOPIC) -> None:
    """Send result rows of one (micro-)batch as JSON text. Use inside ``foreachBatch``."""
    (
        results.select(json_record(*[f"`{c}`" for c in results.columns]).alias("value"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def results_stream_to_kafka(results: DataFrame, servers: str, checkpoint: str, topic: str = RESULT_TOPIC) -> StreamingQuery:
    """Streaming result rows to a topic, at least once."""
    return (
        results.select(json_record(*[f"`{c}`" for c in results.columns]).alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def dry_run(results: DataFrame, checkpoint: str | None = None) -> StreamingQuery | None:
    """Print instead of sending: the console for a stream, ``show`` for a table."""
    if not results.isStreaming:
        results.show(truncate=False)
        return None
    writer = results.writeStream.format("console").option("truncate", "false")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def decode_results(text: DataFrame, column: str = "value") -> DataFrame:
    """JSON result texts as columns, with ``kind``: log_metrics, activity, model or unknown."""
    parsed = text.select(F.from_json(F.col(column).cast("string"), RESULT_SCHEMA).alias("r")).select("r.*")
    return parsed.withColumn("kind", record_kind())


def result_stream(spark: SparkSession, servers: str, topic: str = RESULT_TOPIC) -> DataFrame:
    """The result topic from its beginning, decoded."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return decode_results(raw)
