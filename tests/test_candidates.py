import math
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import candidates, sampling, templates

GOLDEN = {"t1": "acbabb", "t2": "bac", "t3": "aab"}


def pairs_of(df):
    return {(r.first, r.second) for r in df.collect()}


def test_golden_supports(make_log):
    log = make_log(GOLDEN)
    singles = {r.activity: r.support for r in candidates.activity_support(log).collect()}
    assert singles == {"a": 3, "b": 3, "c": 2}
    joint = {(r.first, r.second): r.joint_support for r in candidates.joint_support(log, ["a", "b", "c"]).collect()}
    assert joint == {("a", "b"): 3, ("b", "a"): 3, ("a", "c"): 2, ("c", "a"): 2, ("b", "c"): 2, ("c", "b"): 2}
    assert pairs_of(candidates.candidate_pairs(log, 0.8)) == {("a", "b"), ("b", "a")}
    assert len(pairs_of(candidates.candidate_pairs(log, 0.6))) == 6


def test_threshold_is_not_raised_by_binary_noise(make_log):
    log = make_log({f"c{i}": "ab" for i in range(10)})
    assert candidates.support_threshold(log, 0.7).head().threshold == 7
    assert candidates.threshold_of(0.7, 10) == 7


def random_traces(seed, n=40):
    rnd = random.Random(seed)
    return {f"c{i}": "".join(rnd.choices("abcdef", weights=[6, 5, 4, 3, 2, 1], k=rnd.randint(1, 8))) for i in range(n)}


@pytest.mark.parametrize("width", [64, 2])
def test_pairs_against_sets(make_log, monkeypatch, width):
    monkeypatch.setattr(candidates, "PASS_WIDTH", width)
    traces = random_traces(1)
    log = make_log(traces)
    last = None
    for share in (0.1, 0.3, 0.5):
        limit = math.ceil(share * len(traces))
        sets = [set(t) for t in traces.values()]
        want = {
            (a, b) for a in "abcdef" for b in "abcdef"
            if a != b and sum({a, b} <= s for s in sets) >= limit
        }
        got = pairs_of(candidates.candidate_pairs(log, share))
        assert got == want
        assert last is None or got <= last  # a higher threshold never adds pairs
        last = got


def test_expansion_to_templates(make_log):
    log = make_log(GOLDEN)
    rows = templates.expand_templates(log)
    assert rows.count() == 7 * log.count()
    assert {r.template for r in rows.select("template").distinct().collect()} == set(templates.TEMPLATES)


def lossy_reference(cases, w):
    """The bucket algorithm over the whole stream, one event after the other."""
    tracked, kept = {}, []
    for n, case in enumerate(cases, 1):
        bucket = math.ceil(n / w)
        if case in tracked:
            tracked[case][0] += 1
            kept.append(n)
        else:
            tracked[case] = [1, bucket - 1]
        if n % w == 0:
            for c in [c for c, (f, d) in tracked.items() if f + d <= bucket]:
                del tracked[c]
    return kept


def test_lossy_golden(spark):
    cases = {1: "p", 3: "p", 12: "p", 13: "p", 2: "q", 4: "q", 5: "q", 6: "q", 20: "q"}
    rows = [(cases.get(n, f"x{n}"), n) for n in range(1, 21)]
    log = spark.createDataFrame(rows, "case_id string, num long")
    kept = sampling.lossy_sampled(log, 0.2, number="num").collect()
    assert {(r.case_id, r.n) for r in kept} == {("p", 3), ("p", 13), ("q", 4), ("q", 5), ("q", 6), ("q", 20)}


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_lossy_against_the_global_algorithm(spark, hot_rows):
    logs = []
    for seed in range(12):
        rnd = random.Random(seed)
        logs.append([rnd.choice("aab" + "cdefgh"[: rnd.randint(1, 6)]) for _ in range(rnd.randint(1, 80))])
    rows = [(f"{i}:{c}", i, n) for i, cases in enumerate(logs) for n, c in enumerate(cases, 1)]
    for epsilon in (0.2, 0.34):
        df = spark.createDataFrame(rows, "case_id string, log int, num long")
        kept = sampling.lossy_sampled(df, epsilon, number="num", hot_rows=hot_rows).collect()
        got = {i: sorted(r.n for r in kept if r.log == i) for i in range(len(logs))}
        w = sampling.bucket_width(epsilon)
        assert got == {i: lossy_reference(cases, w) for i, cases in enumerate(logs)}


def test_sampling_switch(make_log):
    log = make_log(random_traces(2))
    assert sampling.sample(log).count() == log.count()
    lossy = sampling.sample(log, "lossy")
    assert lossy.columns == log.columns
    order = [r.case_id for r in log.orderBy("seq").collect()]
    assert lossy.count() == len(lossy_reference(order, 5))
    with pytest.raises(ValueError):
        sampling.sample(log, "other")


def test_supports_and_total_in_one_table(make_log):
    rows = {(r.activity, r.is_total): r.support for r in candidates.supports_with_total(make_log(GOLDEN)).collect()}
    assert rows == {("a", False): 3, ("b", False): 3, ("c", False): 2, (None, True): 3}
    empty = candidates.candidate_pairs(make_log(GOLDEN).filter("activity = 'zz'"), 0.5)
    assert empty.count() == 0
