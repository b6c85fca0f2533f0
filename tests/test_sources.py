import glob

from pyspark.sql import functions as F

from caseweave.operators import eventlog, metrics
from caseweave.sources import results, wire, xes


XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
 <trace><string key="concept:name" value="t1"/><int key="age" value="40"/>
  <event><string key="concept:name" value="A &amp; B"/><date key="time:timestamp" value="2024-01-01T10:00:00+01:00"/><float key="cost" value="1.5"/></event>
  <event><string key="concept:name" value="C"/><date key="time:timestamp" value="2024-01-01T09:30:00Z"/><boolean key="ok" value="true"/></event>
 </trace>
 <trace><string key="concept:name" value="t2"/>
  <event><string key="concept:name" value="C"/><date key="time:timestamp" value="not a time"/></event>
 </trace>
</log>"""


def rows(log):
    return sorted((r.case_id, r.activity, r.ts, dict(r.attrs), bool(r.is_end)) for r in log.collect())


def test_xes_scan(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES)
    log, rejects = xes.read_xes(spark, str(path))
    got = {r.activity: r for r in log.collect()}
    assert got["A & B"].attrs == {"cost": "1.5", "case:age": "40"}
    assert got["C"].attrs == {"ok": "true", "case:age": "40"} and got["C"].seq == 1
    assert got["A & B"].ts.hour == 9
    assert rejects.count() == 1


def test_xes_round_trip_over_parts(spark, tmp_path, make_log):
    log = make_log({"x<1>": ["a", 'b "q"', "c"], "y": ["a"]}, attrs=lambda c, i, a: {"n": str(i), "s": "u&v", "case:age": "3"})
    xes.write_xes(log, str(tmp_path / "parts"))
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(str(tmp_path / "parts" / "part-*"))))
    whole = tmp_path / "whole.xes"
    whole.write_text(text)
    back, rejects = xes.read_xes(spark, str(whole))
    assert rows(back) == rows(log) and rejects.count() == 0


def test_native_log_round_trip(spark, tmp_path, make_log):
    log = make_log({"x": "abc"})
    xes.write_log(log, str(tmp_path / "log"))
    assert rows(xes.read_log(spark, str(tmp_path / "log"))) == rows(log)


def test_wire_round_trip(spark, tmp_path, make_log):
    log = make_log({"x": "ab"}, attrs=lambda c, i, a: {"org:group": "g", "n": "1"})
    sent = eventlog.to_wire(log)
    first = sent.orderBy("time_timestamp").head()
    assert first.eventAttributes == {"org_group": "g", "n": "1", "is_end_event": "False"}
    sent.write.json(str(tmp_path / "wire"))
    bad = sent.withColumn("time_timestamp", F.lit("never"))
    back, rejects = eventlog.from_wire(
        spark.read.schema(wire.WIRE_SCHEMA).json(str(tmp_path / "wire")).unionByName(bad)
    )
    assert sorted((r.activity, r.is_end, r.attrs["org_group"]) for r in back.collect()) == [("a", False, "g"), ("b", True, "g")]
    assert rejects.count() == 2


def test_missing_values_become_empty(spark):
    log = spark.sql("SELECT null AS case_id, null AS activity, cast(null AS timestamp) AS ts, 1L AS seq, map('k', cast(null AS string)) AS attrs, false AS is_end")
    r = eventlog.to_wire(log).head()
    assert (r.case_concept_name, r.concept_name, r.time_timestamp, r.eventAttributes["k"]) == ("", "", "", "")


def test_result_lines(spark, tmp_path):
    df = spark.createDataFrame(
        [("Response", "a", "b", "x <= 1", 10, 0.5, 4, 0.75)],
        "template string, first string, second string, condition string, n_activations long, ratio double, n_activations_data long, ratio_data double",
    )
    records = metrics.result_records(df)
    results.append_results(records, str(tmp_path / "run1"))
    results.append_results(records, str(tmp_path / "run1"))
    results.write_result_batch(records, str(tmp_path / "run2"), 0)
    results.write_result_batch(records, str(tmp_path / "run2"), 0)
    back = results.read_results(spark, str(tmp_path / "run1"))
    assert back.count() == 2 and results.read_results(spark, str(tmp_path / "run2")).count() == 1
    r = back.head()
    assert (r.constraint, r.ratio_data, r.n_activations) == ("Response[a, b]", 0.75, 10)
    assert results.list_runs(spark, str(tmp_path / "run*/*")).count() >= 2


def test_results_are_routed(spark):
    texts = ['{"Event_counter": 3}', '{"Activity": "a", "Frequency": 1}', '{"Constraint": "c", "Fulfilment Ratio No Data": 0.5}', '{"x": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [r.kind for r in wire.decode_results(df).collect()] == ["log_metrics", "activity", "model", "unknown"]


def test_log_operators(make_log):
    log = make_log({"x": "abc", "y": "a"}, closed=False)
    tagged = eventlog.tag_trace_ends(log, hot_rows=2)
    assert {(r.case_id, r.activity) for r in tagged.filter("is_end").collect()} == {("x", "c"), ("y", "a")}
    chunks = {(r.case_id, r.chunk): (r.start_pos, r.activities) for r in eventlog.trace_history(log, 2).collect()}
    assert chunks == {("x", 0): (1, ["a", "b"]), ("x", 1): (3, ["c"]), ("y", 0): (1, ["a"])}
    near = {(r.case_id, r.pos): (r.previous_activity, r.next_activity) for r in eventlog.neighbours(log).collect()}
    assert near[("x", 2)] == ("a", "c") and near[("y", 1)] == (None, None)
    assert [r.seq for r in eventlog.time_sorted(log).collect()] == [0, 1, 2, 3]
