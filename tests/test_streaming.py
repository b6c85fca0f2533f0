import random
import time

from pyspark.sql import functions as F

from caseweave.operators import metrics
from caseweave.streaming.assembly import assembled_traces
from caseweave.streaming.pipeline import Discovery
from caseweave.streaming.statistics import StreamStatistics
from caseweave.streaming.tables import Totals


def feed(log, path, parts, key):
    """Write the log as ``parts`` files that arrive one after the other."""
    for i in range(parts):
        log.filter(key == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def stream_of(spark, log, path):
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


def planted_log(make_log, n=240):
    rnd = random.Random(5)
    traces, bags = {}, {}
    for i in range(n):
        x = rnd.randint(0, 100)
        traces[f"c{i:03d}"] = "ab" if x > 50 else "ac"
        bags[f"c{i:03d}"] = {"x": str(x)}
    # 10 minutes between events: neighbours in the stream are within the watermark delay
    return make_log(traces, attrs=lambda c, i, a: bags[c], gap=600)


def test_stream_equals_batch(spark, make_log, tmp_path):
    log = planted_log(make_log)
    src, n = str(tmp_path / "src"), log.count()
    # Three deliveries in time order, but around each border the events arrive swapped.
    late_key = F.floor(F.col("seq").bitwiseXOR(F.lit(1)) * 3 / n)
    feed(log, src, 3, late_key)
    job = Discovery(str(tmp_path / "out"), min_support=0.3)
    q = job.start(stream_of(spark, log, src), str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"}, shards=3)
    q.processAllAvailable()
    q.stop()

    released = spark.read.parquet(job.traces_path)
    done = [r.case_id for r in released.select("case_id").distinct().collect()]
    assert released.filter("late").count() == 0 and len(done) >= 238  # the last end is not passed by the watermark
    closed = log.filter(F.col("case_id").isin(done))
    assert released.count() == closed.count()
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")]
    batch = {(r.template, r.first, r.second): (r.n_activations, r.n_fulfilled) for r in metrics.constraint_ratios(closed, pairs).collect()}
    streamed = {(r.template, r.first, r.second): (r.n_activations, r.n_fulfilled) for r in job.ratios(spark).collect()}
    assert streamed == batch

    results = job.results(spark)
    rule = results.filter("constraint = 'Response[a, b]'").orderBy(F.desc("n")).head()
    assert rule is None or rule["condition"].startswith("x > ")
    assert [r.n for r in results.orderBy("n").collect()] == list(range(1, results.count() + 1))


def test_repeated_batch_changes_nothing(spark, tmp_path):
    totals = Totals(str(tmp_path / "t"), ["k"], {"n": "sum", "hi": "max"})
    one = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, n long, hi long")
    two = spark.createDataFrame([("a", 10, 3)], "k string, n long, hi long")
    for delta, batch in ((one, 0), (one, 0), (two, 4), (two, 4)):
        totals.add(delta, batch)
    assert {tuple(r) for r in totals.latest(spark).collect()} == {("a", 11, 5), ("b", 2, 6)}


def test_events_after_release_are_marked_late(spark, make_log, tmp_path):
    log = make_log({"x": "ab", "y": "abc"})
    extra = log.filter("case_id = 'y'").withColumn("case_id", F.lit("x")).withColumn("is_end", F.lit(False))
    src = str(tmp_path / "src")
    feed(log, src, 1, F.lit(0))
    extra.coalesce(1).write.mode("append").parquet(src)
    seen = []
    q = (
        assembled_traces(stream_of(spark, log, src), shards=2, wait="arrival")
        .writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda df, i: seen.extend(df.collect()))
        .trigger(processingTime="0 seconds")
        .start()
    )
    q.processAllAvailable()
    q.stop()
    assert sorted((r.case_id, r.activity) for r in seen if not r.late) == [
        ("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c")
    ]
    assert sum(r.late for r in seen) == 3


def test_restart_continues(spark, make_log, tmp_path):
    log = make_log({"x": "ab", "y": "ac", "z": "bc"})
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    stats = StreamStatistics(str(tmp_path / "stats"))
    for part in (0, 1):
        log.filter(F.floor(F.col("seq") / 3) == part).coalesce(1).write.mode("append").parquet(src)
        for q in stats.start(stream_of(spark, log, src), cp, trigger={"availableNow": True}):
            q.awaitTermination(120)
    m = stats.log_metrics(spark).head()
    assert (m.Event_counter, m.Counter_trace_id) == (6, 3)
    assert {tuple(r) for r in stats.activity_statistics(spark).collect()} == {("a", 2, 2), ("b", 2, 2), ("c", 2, 2)}


def test_statistics_of_a_stream(spark, make_log, tmp_path):
    """Many batches, an activity that is missing, repeated cases, and a stream that has not brought anything yet."""
    stats = StreamStatistics(str(tmp_path / "stats"))
    empty = stats.log_metrics(spark).head()
    assert (empty.Event_counter, empty.Log_start_timestamp, empty.Counter_trace_id) == (0, None, 0)
    assert stats.activity_statistics(spark).collect() == []

    log = make_log({f"c{i % 7}{i}": "aab"[: 1 + i % 3] for i in range(20)})
    log = log.withColumn("activity", F.when(F.col("seq") % 5 != 0, F.col("activity")))
    src = str(tmp_path / "src")
    for part in range(4):
        log.filter(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(src)
    for q in stats.start(stream_of(spark, log, src), str(tmp_path / "cp"), trigger={"availableNow": True}):
        q.awaitTermination(120)
    whole = log.agg(F.count("*"), F.min("ts"), F.max("ts"), F.count_distinct("case_id")).head()
    assert tuple(stats.log_metrics(spark).head()) == tuple(whole)
    by_activity = log.groupBy("activity").agg(F.count("*"), F.count_distinct("case_id")).collect()
    assert {tuple(r) for r in stats.activity_statistics(spark).collect()} == {tuple(r) for r in by_activity}


def test_abandoned_traces_leave_no_state(spark, make_log, tmp_path):
    """A case without an end event is released after a day of silence; a day after its release nothing is kept.

    An event behind the watermark is dropped and counted by Spark.
    """
    start = make_log({"done": "abc", "open": "ab", "quiet": "a", **{f"left{i}": "a" for i in range(40)}}, attrs=lambda c, i, a: {"k": c})
    start = start.withColumn("is_end", F.col("is_end") & (F.col("case_id") == "done"))
    signs = [make_log({f"sign{i}": "z"}).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(i * 2))) for i in (1, 2, 3)]
    late = make_log({"open": "d"})
    src = str(tmp_path / "src")
    for part in (start, *signs[:2], late, signs[2]):
        part.select(start.columns).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.1)
    query = assembled_traces(stream_of(spark, start, src), shards=2).writeStream.format("memory").queryName("released").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.case_id, r.activity, r.late) for r in spark.table("released").collect()}
    assert got >= {("done", "a", False), ("done", "b", False), ("done", "c", False), ("open", "a", False), ("open", "b", False), ("quiet", "a", False)}
    assert not any(case == "open" and activity == "d" for case, activity, _ in got)
    progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 3  # an end event, and its marker for either shard
    most, last = max(p["numRowsTotal"] for p in progress), progress[-1]["numRowsTotal"]
    assert most > 80 and last < 20  # what is left is of the last two signs of life: an event, states and timers


def test_a_table_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    from caseweave.catalog import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    of_folder = {tuple(r) for r in queries.streamed_statistics(spark, str(tmp_path)).collect()}
    of_file = {tuple(r) for r in queries.streamed_statistics(spark, "/root/testdata/sf0.001").collect()}
    assert of_folder == of_file and of_file
