import random

import pytest
from pyspark.sql import functions as F

from caseweave.plans import ordered
from caseweave.plans.ordered import keyed_scan, number_rows, running_sums


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(0)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 5)}", i, rnd.randint(0, 99)) for i in range(600)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "k string, o long, v long").repartition(4)


def test_number_rows(rows):
    data, df = rows
    got = {r.o: r.n for r in number_rows(df, ["v", "o"]).collect()}
    want = {o: i + 1 for i, (_, o, _) in enumerate(sorted(data, key=lambda r: (r[2], r[1])))}
    assert got == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums(rows, keys):
    data, df = rows
    got = {r.o: (r.s, r.c) for r in running_sums(df, keys, ["o"], {"s": F.col("v"), "c": F.lit(1)}).collect()}
    total, want = {}, {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        key = k if keys else None
        s, c = total.get(key, (0, 0))
        total[key] = want[o] = (s + v, c + 1)
    assert got == want


@pytest.mark.parametrize("hot_rows", [None, 40, 1])
def test_keyed_scan(rows, hot_rows):
    data, df = rows
    got = keyed_scan(
        df, ["k"], ["o"],
        before={"mx": ("max", F.col("v") - F.col("pos")), "sm": ("sum", F.col("v"))},
        after={"mn": ("min", F.col("v")), "rest": ("sum", F.lit(1))},
        previous={"pv": F.when(F.col("v") % 3 > 0, F.col("v"))},
        following={"nv": F.col("v")},
        hot_rows=hot_rows,
    ).collect()
    groups = {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(k, []).append((o, v))
    want = set()
    for k, items in groups.items():
        vs = [v for _, v in items]
        for i, (o, v) in enumerate(items):
            want.add((
                o, i + 1,
                max((x - j - 1 for j, x in enumerate(vs[:i])), default=None),
                sum(vs[:i]) if i else None,
                min(vs[i + 1 :], default=None),
                len(vs) - i - 1 or None,
                (vs[i - 1] if vs[i - 1] % 3 else None) if i else None,
                vs[i + 1] if i + 1 < len(vs) else None,
            ))
    assert {(r.o, r.pos, r.mx, r.sm, r.mn, r.rest, r.pv, r.nv) for r in got} == want


def test_running_sums_in_stretches_of_time(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(draw.choice("ab") if n % 9 else None, None if n % 50 == 0 else draw.randrange(300) ** 2, n, draw.randrange(5)) for n in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, n long, v long").withColumn("ts", F.timestamp_seconds("t"))
    args = (df, ["k"], ["ts", "n"], {"s": F.col("v"), "c": F.lit(1)})
    want = sorted(map(str, ordered.running_sums(*args).collect()))
    monkeypatch.setattr(ordered, "STRETCH_ROWS", 20)
    times = df.filter("t > 1000").select("ts")  # rows before the first stretch
    assert sorted(map(str, ordered.timed_sums(*args, times).collect())) == want
    assert sorted(map(str, ordered.timed_sums(*args, times, hot_rows=10).collect())) == want  # blocks
    for limit, written in ((None, False), (10, True)):  # rows are ranged and written for blocks only
        files = ordered.timed_sums(*args, times, hot_rows=limit).inputFiles()
        assert any("blocks-" in f for f in files) == written


def test_stretches_are_dealt_whole_while_they_fit_a_task(spark, monkeypatch):
    """Dealt by time alone, rows of one event stay together; a wide stretch is dealt by key as well."""
    draw = random.Random(6)
    rows = [(draw.choice("abc"), draw.randrange(3000), n, draw.randrange(5)) for n in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, n long, v long").withColumn("ts", F.timestamp_seconds("t"))
    args = (df, ["k"], ["ts", "n"], {"s": F.col("v"), "c": F.lit(1)})
    want = sorted(map(str, ordered.running_sums(*args).collect()))
    monkeypatch.setattr(ordered, "STRETCH_ROWS", 20)
    for task_rows, dealt in ((200, "[_slot#"), (10, "[k#")):
        monkeypatch.setattr(ordered, "TASK_ROWS", task_rows)
        got = ordered.timed_sums(*args, df.select("ts"))
        assert f"RepartitionByExpression {dealt}" in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, got.collect())) == want
