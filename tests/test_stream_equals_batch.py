"""Batches in which a pair, an attribute and its values appear late: the stream ends where the batch operators do."""

from pyspark.sql import functions as F

from caseweave.operators import candidates, learning, metrics
from caseweave.streaming.pipeline import Discovery


def batches(make_log):
    """0: without the attribute; 1: pair (a, b) rare; 2-4: frequent, and x decides whether b follows."""
    plain = lambda n, start: {f"c{i}": ["s", "t"] for i in range(start, start + n)}
    ruled = lambda n, start: {f"c{i}": ["a", "b"] if i % 2 else ["a", "s"] for i in range(start, start + n)}
    attrs = lambda case, i, activity: {"x": str(int(case[1:]) % 2 + int(case[1:]) / 1e5)} if activity == "a" else {}
    parts = [plain(20, 0), {**plain(30, 100), **ruled(4, 200)}, ruled(300, 1000), ruled(300, 2000), {**ruled(300, 3000), "c9999": [None, "a"]}]
    return [make_log(p, attrs=attrs) for p in parts]


def test_late_pairs_and_attributes_are_counted_from_the_beginning(spark, make_log, tmp_path):
    logs = batches(make_log)
    folder = str(tmp_path)
    for i, log in enumerate(logs):
        job = Discovery(folder, min_support=0.3)  # a restart between all batches
        job.process(log.withColumn("late", F.lit(False)), i)
        if i == 2:
            job.process(log.withColumn("late", F.lit(False)), i)  # a repeated batch
    everything = logs[0]
    for log in logs[1:]:
        everything = everything.unionByName(log)
    pairs = [("a", "b"), ("b", "a"), ("a", "s")]
    counts = lambda df: {(r.template, r.first, r.second): (r.n_activations, r.n_fulfilled) for r in df.collect() if (r.first, r.second) in pairs}
    streamed = counts(job.ratios(spark))
    batch = counts(metrics.constraint_ratios(everything, pairs))
    assert streamed and streamed == {k: v for k, v in batch.items() if k in streamed}
    assert {(f, s) for _, f, s in streamed} >= {("a", "b"), ("b", "a")}

    job.settle(spark)
    known = sorted({(r.first, r.second) for r in job.ratios(spark).collect()})
    rules = learning.learn_conditions(everything, known)
    want = {(r.template, r.first, r.second, r.condition) for r in rules.collect()}
    assert want and {(r.template, r.first, r.second, r.condition) for r in job.rules(spark).collect()} == want
