"""XES logs: read with Spark's XML source, written as ordered text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.scalars import as_boolean, as_number, parse_timestamp
from caseweave.operators.eventlog import ORDER
from caseweave.plans.ordered import keyed_scan

# The typed elements of XES and the standard keys.
_ELEMENTS = ("string", "date", "int", "float", "boolean", "id")
_NAME, _TIME, _END = "concept:name", "time:timestamp", "is_end_event"

_ATTRIBUTE = "array<struct<_key:string,_value:string>>"
_EVENT = ",".join(f"{e}:{_ATTRIBUTE}" for e in _ELEMENTS)
_TRACE = ", ".join(f"`{e}` {_ATTRIBUTE}" for e in _ELEMENTS) + f", event array<struct<{_EVENT}>>"


def _entries(element) -> Column:
    """All typed attributes of a trace or event, in one array of (key, value)."""
    arrays = [F.coalesce(element(e), F.array().cast(_ATTRIBUTE)) for e in _ELEMENTS]
    return F.concat(*arrays)


def _as_map(entries: Column) -> Column:
    """First value per key: a map must not see a key twice."""
    keys = F.transform(entries, lambda e: e["_key"])
    firsts = F.filter(entries, lambda e, i: F.array_position(keys, e["_key"]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["_key"], e["_value"])))


def read_xes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A file, folder or glob of XES as (log, rejects without a readable time).

    Trace attributes become event attributes named ``case:...``; ``seq`` is the position in
    the trace. A trace is one XML element and so one record: store big logs as Parquet.
    """
    traces = spark.read.option("rowTag", "trace").schema(_TRACE).xml(path)
    events = traces.select(
        _as_map(_entries(F.col)).alias("trace"), F.posexplode("event").alias("seq", "event")
    ).select("trace", F.col("seq").cast("long").alias("seq"), _as_map(_entries(lambda e: F.col("event")[e])).alias("event"))
    shared = F.transform_keys(
        F.map_filter("trace", lambda k, _: k != _NAME), lambda k, _: F.concat(F.lit("case:"), k)
    )
    own = F.map_filter("event", lambda k, _: ~k.isin(_NAME, _TIME, _END))
    parsed = events.select(
        F.coalesce(F.col("trace")[_NAME], F.lit("")).alias("case_id"),
        F.coalesce(F.col("event")[_NAME], F.lit("")).alias("activity"),
        parse_timestamp(F.col("event")[_TIME]).alias("ts"),
        "seq",
        F.map_concat(own, F.map_filter(shared, lambda k, _: ~F.map_contains_key(own, k))).alias("attrs"),
        F.coalesce(F.lower(F.col("event")[_END]) == "true", F.lit(False)).alias("is_end"),
    )
    return parsed.filter(F.col("ts").isNotNull()), parsed.filter(F.col("ts").isNull())


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _line(kind, key: Column, value: Column, indent: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(f"{indent}<"), kind, F.lit(' key="'), _escaped(key), F.lit('" value="'), _escaped(value), F.lit('"/>')
    )


def xes_lines(log: DataFrame, *, hot_rows: int | None = None) -> DataFrame:
    """(section, case_id, pos, value): the document, one row per event, in order."""
    placed = keyed_scan(log, ["case_id"], ORDER, following={"_next": F.col("seq")}, hot_rows=hot_rows)
    is_case = F.col("pos") == 1
    kind = lambda v: (
        F.when(v.rlike(r"^[+-]?\d+$"), "int").when(as_number(v).isNotNull(), "float").when(as_boolean(v).isNotNull(), "boolean")
        .when(v.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d"), "date").otherwise("string")
    )
    attributes = F.transform(
        F.map_entries(F.map_filter("attrs", lambda k, v: ~k.startswith("case:") & v.isNotNull())),
        lambda e: _line(kind(e["value"]), e["key"], e["value"], "    "),
    )
    of_case = F.transform(
        F.map_entries(F.map_filter("attrs", lambda k, v: k.startswith("case:") & v.isNotNull())),
        lambda e: _line(kind(e["value"]), F.regexp_replace(e["key"], "^case:", ""), e["value"], "  "),
    )
    end = F.when(F.coalesce("is_end", F.lit(False)), "true").otherwise("false")
    event = F.array_join(
        F.concat(
            F.when(is_case, F.concat(F.array(F.lit(" <trace>"), _line("string", F.lit(_NAME), F.col("case_id"), "  ")), of_case))
            .otherwise(F.array().cast("array<string>")),
            F.array(
                F.lit("  <event>"),
                _line("string", F.lit(_NAME), F.col("activity"), "    "),
                _line("date", F.lit(_TIME), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "    "),
                _line("boolean", F.lit(_END), end, "    "),
            ),
            attributes,
            F.array(F.lit("  </event>")),
            F.when(F.col("_next").isNull(), F.array(F.lit(" </trace>"))).otherwise(F.array().cast("array<string>")),
        ),
        "\n",
    )
    body = placed.select(F.lit(1).alias("section"), "case_id", "pos", event.alias("value"))
    frame = log.sparkSession.createDataFrame(
        [(0, "", 0, '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0">'), (2, "", 0, "</log>")],
        "section int, case_id string, pos long, value string",
    )
    return body.unionByName(frame)


def write_xes(log: DataFrame, folder: str, *, hot_rows: int | None = None) -> None:
    """Write the log as text parts which, put together in name order, are one XES document.

    The parts are ranges of (case, position): a long trace may continue in the next part, so
    no task has to hold or write a whole trace.
    """
    order = ["section", "case_id", "pos"]
    lines = xes_lines(log, hot_rows=hot_rows).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("value").write.mode("overwrite").text(folder)


def write_log(log: DataFrame, folder: str) -> None:
    """The native form: Parquet by day, so reads prune by time."""
    log.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("day")
