import random
import statistics as st
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseweave.operators import metrics, model, report, statistics, templates

SCHEMA = "constraint string, run long, condition string, n_activations long, ratio double, n_activations_data long, ratio_data double"
ROWS = [
    ("A", 1, "x", 5, 0.8, 3, 0.5), ("A", 2, "x", 9, 0.7, 3, 0.9), ("A", 3, "y", 9, 0.1, 3, 0.2),
    ("B", 1, "x", 4, 0.5, 2, 0.5), ("C", 1, "x", 4, 0.9, 2, 0.4), ("D", 1, "x", 4, 0.9, 2, 0.0),
]


def test_compared(spark):
    diffs = report.compared(spark.createDataFrame(ROWS, SCHEMA))
    assert {(r.constraint, r.run, r["diff"]) for r in diffs.collect()} == {("A", 2, -0.2), ("B", 1, 0.0), ("C", 1, 0.5)}
    assert tuple(report.summary(diffs).head()) == (3, 1, 1, 1)
    d = report.describe(diffs).head()
    values = [-0.2, 0.0, 0.5]
    assert (d[0], d["mean"], d["min"], d["p50"], d["max"]) == (3, 0.1, -0.2, 0.0, 0.5)
    assert abs(d["std"] - st.stdev(values)) < 1e-6 and (d["p25"], d["p75"]) == (-0.1, 0.25)
    bins = {r.bin: r.n for r in report.histogram(diffs).collect()}
    assert bins == {1: 1, 6: 1, 20: 1}
    assert [r.constraint for r in report.ranked(diffs).collect()] == ["A"]
    assert [r.constraint for r in report.ranked(diffs, 1).collect()] == ["C"]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "diff double")
    assert [tuple(r) for r in report.histogram(df).collect()] == [(1, 2)]


def test_extremes(spark):
    rows = report.with_difference(spark.createDataFrame(ROWS, SCHEMA))
    got = sorted((r.constraint, r.run) for r in report.extremes(rows).collect())
    assert got == [("A", 1), ("A", 2), ("B", 1), ("C", 1), ("D", 1)]


def test_windows_and_model(spark):
    rows = [(i, "Response" if i % 2 else "Chain Precedence", "a", "b", "c1" if i % 3 else "c2") for i in range(25)]
    results = spark.createDataFrame(rows, "i long, template string, first string, second string, condition string")
    windows = model.count_windows(results, ["i"])
    assert {r.window_id: r["count"] for r in windows.groupBy("window_id").count().collect()} == {0: 10, 1: 10}
    kept = model.distinct_model(windows, ["i"], ["window_id"])
    assert kept.count() == 8
    assert min(r.i for r in kept.collect()) == 0
    sides = {r.template: r.label_side for r in model.model_edges(results).collect()}
    assert sides == {"Response": "right", "Chain Precedence": "left"}
    assert {r.id for r in model.model_nodes(results).collect()} == {"a", "b"}


def test_statistics(make_log, spark):
    log = make_log({"x": "aab", "y": "ab"})
    assert {tuple(r) for r in statistics.activity_statistics(log).collect()} == {("a", 3, 2), ("b", 2, 2)}
    running = statistics.running_log_metrics(log).orderBy("Event_counter").collect()
    assert [r.Counter_trace_id for r in running] == [1, 1, 1, 2, 2]
    assert [r.Event_counter for r in running] == [1, 2, 3, 4, 5]
    feed = statistics.statistics_feed(log)
    assert {r.kind: r["count"] for r in feed.withColumn("Fulfilment Ratio No Data", F.lit(None)).groupBy(
        statistics.record_kind().alias("kind")).count().collect()} == {"log_metrics": 1, "activity": 2}
    view = statistics.relation(feed, statistics.ACTIVITY_COLUMNS)
    assert view.columns == list(statistics.ACTIVITY_COLUMNS)
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 6)], "o int, k string, v int")
    assert {tuple(r) for r in statistics.latest(df, ["o"], ["k"]).collect()} == {(2, "a", 6), (3, "b", 6)}
    assert statistics.deduplicated(df.drop("o").union(df.drop("o"))).count() == 3


@pytest.mark.parametrize("bound", [None, 2])
def test_rule_replay(spark, bound):
    acts = spark.createDataFrame(
        [("R", "a", "b", v, {"x": str(x)}, "c", i, 100 + i, i) for i, (v, x) in enumerate(
            [("fulfilled", 1), ("violated", 5), ("fulfilled", 6), ("fulfilled", 7), ("violated", 9)])],
        "template string, first string, second string, verdict string, attrs map<string,string>, case_id string, pos long, t long, resolved_seq long",
    ).withColumn("resolved_ts", F.timestamp_seconds("t"))
    rules = spark.createDataFrame(
        [("R", "a", "b", [("x", ">", "4")], 101, 1), ("R", "a", "b", [("x", "<=", "6")], 103, 2)],
        "template string, first string, second string, conjuncts array<struct<attr:string,op:string,value:string>>, t long, rule_seq long",
    ).withColumn("valid_from", F.timestamp_seconds("t")).drop("t")
    got = [(r.rule_seq, r.n_activations_data, r.n_fulfilled_data, r.ratio_data) for r in
           metrics.replay_rules(acts, rules, max_rules=bound).orderBy("rule_seq").collect()]
    assert got == [(1, 1, 0, 0.0), (2, 2, 1, 0.5)]  # the activation at 104 waits for a third rule
    apart = [(r.rule_seq, r.n_activations_data, r.n_fulfilled_data) for r in
             metrics.replay_rules(acts, rules, cumulative=False, max_rules=bound).orderBy("rule_seq").collect()]
    assert apart == [(1, 1, 0), (2, 1, 1)]


def test_replay_of_a_log_counts_before_rules_meet_it(spark, make_log, monkeypatch):
    log = make_log({f"c{n}": "abab"[: 1 + n % 4] + "ba"[: n % 3] for n in range(40)}, attrs=lambda c, i, a: {"x": str(int(c[1:]) % 7 + i)} if i % 5 else {})
    first = 1_700_000_000
    rules = spark.createDataFrame(
        [(t, "a", "b", [("x", op, v)], first + s, n) for t in ("Response", "Not Response", "Precedence", "Not Chain Precedence")
         for n, (op, v, s) in enumerate([(">", "3", -5), ("<=", "4", 20), ("==", "5", 20), (">", "2", 70 + len(t)), ("<=", "6", 500)])],
        "template string, first string, second string, conjuncts array<struct<attr:string,op:string,value:string>>, t long, rule_seq long",
    ).withColumn("valid_from", F.timestamp_seconds("t")).drop("t")
    acts = templates.negate_verdicts(templates.verdicts(log, [("a", "b")], keep=["attrs"], times=True, complete=True))
    got = lambda df: sorted(map(tuple, df.collect()))
    for cumulative in (True, False):
        want = got(metrics.replay_rules(acts, rules, cumulative=cumulative, max_rules=100))
        assert got(metrics.replay_log(log, [("a", "b")], rules, cumulative=cumulative, max_rules=100, complete=True)) == want
    assert sum(r[-3] for r in want) > 100
    monkeypatch.setattr(metrics, "COUNTED_TIMES", 2)  # too many times to count between
    assert got(metrics.replay_log(log, [("a", "b")], rules, cumulative=False, max_rules=100, complete=True)) == want


def test_condition_scores_count_activations_first(make_log):
    log = make_log({f"c{n}": "abab"[: 1 + n % 4] + "ba"[: n % 3] for n in range(40)}, attrs=lambda c, i, a: {"x": str(int(c[1:]) % 7)})
    says = {"high": F.col("attrs")["x"].cast("int") > 3, "odd": F.col("attrs")["x"].cast("int") % 2 == 1}
    got = metrics.condition_f1(log, [("a", "b")], says, complete=True)
    rows = log.withColumn("held", F.array(*[F.struct(F.lit(k).alias("label"), v.alias("says")) for k, v in says.items()]))
    rows = templates.negate_verdicts(templates.verdicts(rows, [("a", "b")], keep=["held"], complete=True)).select("template", "first", "second", "verdict", F.inline("held"))
    want = metrics.f1_scores(rows, ["template", "first", "second", "label"], F.col("verdict") == "fulfilled", F.col("says"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 28


def interleaved(make_log, seed, copies=1):
    """Cases whose events are mixed in time, with ties of time; copies have their own cases."""
    draw = random.Random(seed)
    log = make_log({f"c{i}": [draw.choice("abc") for _ in range(draw.randint(1, 9))] for i in range(60)})
    log = log.withColumn("ts", F.timestamp_seconds(1_600_000_000 + F.pmod(F.xxhash64("case_id", "seq"), F.lit(400)) * 100))
    many = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return log.withColumn("k", many).withColumn("case_id", F.concat("case_id", F.lit("-"), "k")).withColumn("seq", F.col("seq") * copies + F.col("k")).drop("k")


def by_hand(log, pairs, complete):
    """The majority so far, one activation after the other."""
    rows = templates.verdicts(log, pairs, times=True, complete=complete).filter("verdict <> 'pending'").collect()
    counts, leads = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.resolved_ts is not None, r.resolved_ts, r.resolved_seq, r.ts, r.seq, r.case_id)):
        key, hit = (r.template, r.first, r.second), r.verdict == "fulfilled"
        counts.setdefault(key, Counter())[("tp" if hit else "fp") if leads[key] > 0 else ("fn" if hit else "tn")] += 1
        leads[key] += 1 if hit else -1
    return sorted((*key, c["tp"], c["fp"], c["fn"]) for key, c in counts.items())


@pytest.mark.parametrize("seed,stretches,hot_rows,complete", [(1, 512, None, True), (2, 40, None, False), (3, 7, None, True), (4, 3, 20, True), (5, 1, None, True), (6, 5, 1, False)])
def test_majority_scores_equal_a_replay(make_log, monkeypatch, seed, stretches, hot_rows, complete):
    monkeypatch.setattr(metrics, "MAJORITY_STRETCHES", stretches)
    log = interleaved(make_log, seed)
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "b")]
    got = metrics.majority_f1(log, pairs, complete=complete, hot_rows=hot_rows).collect()
    want = by_hand(log, pairs, complete)
    assert sorted((r.template, r.first, r.second, r.tp, r.fp, r.fn) for r in got) == want
    assert sum(r.tp for r in got) and sum(r.fp for r in got) and sum(r.fn for r in got)
    for r in got:
        assert r.f1 == round(2 * r.tp / (2 * r.tp + r.fp + r.fn), 3) if r.tp + r.fp + r.fn else r.f1 == 0


def test_majority_puts_only_contested_activations_in_order(make_log):
    log, pairs = interleaved(make_log, 7, copies=20), [("a", "b"), ("b", "a"), ("a", "c"), ("c", "b")]
    settled, contested = metrics._by_majority(log, pairs, tuple(templates.TEMPLATES), True, None)
    n = templates.verdicts(log, pairs, complete=True).count()
    assert 0 < contested.count() < n / 10
    got = metrics.majority_f1(log, pairs, complete=True).drop("f1").collect()
    assert sorted(map(tuple, got)) == by_hand(log, pairs, True)


def test_majority_of_odd_logs(make_log):
    log = make_log({"x": "abab", "y": "ba"})
    assert metrics.majority_f1(make_log({}), [("a", "b")], complete=True).count() == 0
    assert metrics.majority_f1(log, [("x", "y")], complete=True).count() == 0
    same = log.withColumn("ts", F.to_timestamp(F.lit("2000-01-01")))  # one moment
    assert sorted(map(tuple, metrics.majority_f1(same, [("a", "b")], complete=True).drop("f1").collect())) == by_hand(same, [("a", "b")], True)
    never = log.withColumn("ts", F.lit(None).cast("timestamp"))
    scores = metrics.majority_f1(never, [("a", "b")], complete=True)
    assert scores.count() == 7 and scores.schema == metrics.majority_f1(log, [("a", "b")], complete=True).schema
