"""What holds as of an event: candidates, sampling over batches, rules in force."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from caseweave import session
from caseweave.catalog import queries
from caseweave.operators import candidates, metrics, sampling
from caseweave.streaming.sampling import LossySampling


def some_log(make_log, seed, n=60, letters="abcdef"):
    """Cases whose events are interleaved in time."""
    draw = random.Random(seed)
    log = make_log({f"c{i}": [draw.choice(letters) for _ in range(draw.randint(1, 7))] for i in range(n)})
    return log.withColumn("ts", F.timestamp_seconds(1_600_000_000 + F.pmod(F.xxhash64("case_id", "seq"), F.lit(100_000))))


def replayed(events, support):
    """Event by event, with sets."""
    traces, of_case, joint, out, now = set(), {}, {}, {}, set()
    for n, (case, activity) in enumerate(events, 1):
        traces.add(case)
        seen = of_case.setdefault(case, set())
        if activity not in seen:
            for other in seen:
                for pair in ((activity, other), (other, activity)):
                    joint[pair] = joint.get(pair, 0) + 1
            seen.add(activity)
        limit = math.ceil(round(support * len(traces), 9))
        for pair, j in joint.items():
            if j >= limit and pair not in now:
                birth = out.setdefault(pair, [n, len(traces), j, limit, 0])
                birth[4] += 1
        now = {pair for pair, j in joint.items() if j >= limit}
    return {(*pair, *row, joint[pair], limit, pair in now) for pair, row in out.items()}


@pytest.mark.parametrize("seed,support", [(1, 0.2), (2, 0.1), (3, 0.35), (4, 0.0)])
def test_candidates_as_of_equal_a_replay(make_log, seed, support):
    log = some_log(make_log, seed)
    rows = log.orderBy("ts", "seq", "case_id").select("case_id", "activity").collect()
    got = {tuple(r) for r in candidates.candidates_as_of(log, support).collect()}
    if support:
        assert got == replayed([tuple(r) for r in rows], support) and got
        late = {(r.first, r.second) for r in candidates.candidate_pairs(log, support).collect()}
        assert late <= {(r[0], r[1]) for r in got}
    else:
        assert all(r[-1] for r in got)


def test_candidates_as_of_odd_logs(make_log):
    assert candidates.candidates_as_of(make_log({}), 0.5).count() == 0
    assert candidates.candidates_as_of(make_log({"x": [None, None], "y": ["a", None, "a"]}), 0.5).count() == 0


def test_lossy_counting_over_batches_equals_the_whole(spark, make_log, tmp_path):
    """Five batches in time order, a new object for each (a restart), one of them run twice."""
    log = some_log(make_log, 5, n=40)
    whole = {(r.case_id, r.seq, r.n, r.bucket) for r in sampling.lossy_sampled(log, 0.1).collect()}
    numbered = candidates.number_rows(log, ["ts", "seq", "case_id"], "_n")
    size = -(-numbered.count() // 5)
    for part in (0, 1, 2, 2, 3, 4):
        batch = numbered.filter(F.floor((F.col("_n") - 1) / size) == part).drop("_n")
        LossySampling(str(tmp_path), 0.1).process(batch, part)
    job = LossySampling(str(tmp_path), 0.1)
    assert {(r.case_id, r.seq, r.n, r.bucket) for r in job.sampled(spark).collect()} == whole and whole

    width, tracked = sampling.bucket_width(0.1), {}
    for n, (case,) in enumerate(log.orderBy("ts", "seq", "case_id").select("case_id").collect(), 1):
        bucket = -(-n // width)
        tracked[case] = tracked[case] + 1 if case in tracked else bucket
        if n % width == 0:
            tracked = {c: s for c, s in tracked.items() if s > bucket}
    assert {(r.case_id, r.s) for r in job.tracked(spark).collect()} == set(tracked.items())


def test_lossy_stream_goes_on_after_a_restart(spark, make_log, tmp_path):
    log = some_log(make_log, 6, n=20)
    src = str(tmp_path / "src")
    numbered = candidates.number_rows(log, ["ts", "seq", "case_id"], "_n")
    half = numbered.count() // 2
    for part in (F.col("_n") <= half, F.col("_n") > half):
        numbered.filter(part).drop("_n").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
        LossySampling(str(tmp_path / "out")).start(stream, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
    got = {(r.case_id, r.seq, r.n) for r in LossySampling(str(tmp_path / "out")).sampled(spark).collect()}
    assert got == {(r.case_id, r.seq, r.n) for r in sampling.lossy_sampled(log).collect()}


def test_ten_thousand_rules_per_constraint(spark):
    """Places are found by halving; both ways give the same gaps."""
    draw = random.Random(2)
    conjuncts = "array(named_struct('attr', 'x', 'op', '>', 'value', cast(id % 5 as string)))"
    rules = spark.range(10_000).selectExpr(
        "'Response' AS template", "'a' AS first", "'b' AS second", f"{conjuncts} AS conjuncts",
        "timestamp_seconds(1600000000 + 10 * id) AS valid_from", "id AS rule_seq")
    rows = [("Response", "a", "b", draw.choice(["fulfilled", "violated"]), {"x": str(draw.randrange(6))}, 1_600_000_000 + draw.randrange(-50, 100_100), i) for i in range(3000)]
    acts = spark.createDataFrame(rows, "template string, first string, second string, verdict string, attrs map<string,string>, t long, resolved_seq long")
    acts = acts.selectExpr("*", "timestamp_seconds(t) AS resolved_ts", "cast(resolved_seq AS string) AS case_id", "resolved_seq AS pos")
    found = {}
    for bound in (10_000, None):
        out = metrics.replay_rules(acts, rules, cumulative=False, max_rules=bound)
        found[bound] = {(r.rule_seq, r.n_activations_data, r.n_fulfilled_data) for r in out.filter("n_activations_data > 0").collect()}
    want = {}
    for *_, verdict, attrs, t, _ in rows:
        k = max(0, -(-(t - 1_600_000_000) // 10))
        if k < 10_000 and int(attrs["x"]) > k % 5:
            n, hits = want.get(k, (0, 0))
            want[k] = (n + 1, hits + (verdict == "fulfilled"))
    assert found[10_000] == found[None] == {(k, *v) for k, v in want.items()}


def test_parts_are_delivered_in_several_files(spark, make_log, monkeypatch):
    monkeypatch.setattr(queries, "DELIVERED_ROWS", 20)
    log = make_log({f"c{n}": "abcab" for n in range(80)})
    stream = queries._delivered(spark, log, 4)
    seen = []
    stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted(r.seq for r in df.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(k, k + 100)) for k in (0, 100, 200, 300)]
    folder = [f for f in os.listdir(session.shared_dir(spark).removeprefix("file:") + "/caseweave") if f.startswith("delivered-")]
    counts = [len([n for n in os.listdir(f"{session.shared_dir(spark).removeprefix('file:')}/caseweave/{f}") if n.endswith(".parquet")]) for f in folder]
    assert 20 in counts  # four parts of five files
