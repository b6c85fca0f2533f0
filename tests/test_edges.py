"""Ties, NULL keys, colliding and long names."""

from pyspark.sql import functions as F

from caseweave.operators import eventlog, learning, metrics, statistics
from caseweave.plans.ordered import keyed_scan

SCHEMA = "case_id string, activity string, t long, seq long, attrs map<string,string>, is_end boolean"


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("case_id", "activity", "timestamp_seconds(t) AS ts", "seq", "attrs", "is_end")


def test_running_metrics_count_a_case_once_whatever_the_ties(spark):
    rows = [("a", "x", 5, 0, {}, False)] * 3 + [("b", "x", 5, 0, {}, False), (None, "x", 6, 0, {}, False), (None, "y", 6, 0, {}, True)]
    got = [(r.Event_counter, r.Counter_trace_id) for r in statistics.running_log_metrics(log_of(spark, rows)).orderBy("Event_counter").collect()]
    assert [n for n, _ in got] == [1, 2, 3, 4, 5, 6] and got[-1][1] == 3 and sorted(c for _, c in got) == [1, 1, 1, 2, 3, 3]


def test_null_group_takes_the_split_path(spark):
    rows = [(None, i) for i in range(40)] + [("a", i) for i in range(5)]
    df = spark.createDataFrame(rows, "case_id string, seq long")
    args = dict(before={"n": ("sum", F.lit(1))}, following={"next": F.col("seq")})
    plain = keyed_scan(df, ["case_id"], ["seq"], **args)
    split = keyed_scan(df, ["case_id"], ["seq"], hot_rows=10, **args)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    assert split.count() == 45


def test_colliding_attribute_names_keep_the_last(spark):
    wire = eventlog.to_wire(log_of(spark, [("a", "x", 1, 0, {"org:g": "1", "org_g": "2", "k": None}, True)])).head()
    assert wire.eventAttributes == {"org_g": "2", "k": "", "is_end_event": "True"}


def test_long_names_are_not_cut(spark):
    name = "Not " + "n" * 3000
    rules = spark.createDataFrame([(name, "a", "b")], "template string, first string, second string")
    assert metrics._placed_rules(rules).head()._plain == name[4:]


def test_small_numbers_decide(spark, make_log):
    traces = {f"c{i}": ["a", "b"] if i % 2 else ["a", "c"] for i in range(800)}
    log = make_log(traces, attrs=lambda case, i, activity: {"x": f"{(int(case[1:]) % 2) * 0.0005 + int(case[1:]) * 1e-7:.7f}"} if activity == "a" else {})
    rules = learning.learn_conditions(log, [("a", "b")], complete=True).filter("template = 'Response'").collect()
    assert len(rules) == 1 and "x" in rules[0].condition
