import math
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import drift, learning, trees
from caseweave.operators.incremental import IncrementalTrees
from caseweave.operators.learning import Settings

LOOSE = Settings(grace=100, delta=1e-3)


def plain_windows(buckets, delta=drift.DELTA):
    """The windows after each bucket, by the formula."""
    window, out = [], []
    for batch, n, errors in buckets:
        window = [*window, (batch, n, errors)]
        best = None
        for at in range(1, len(window)):
            n0, e0 = sum(b[1] for b in window[:at]), sum(b[2] for b in window[:at])
            n1, e1 = sum(b[1] for b in window[at:]), sum(b[2] for b in window[at:])
            m, rate = 1 / (1 / n0 + 1 / n1), (e0 + e1) / (n0 + n1)
            log = math.log(2 * max(math.log(n0 + n1), 1.0) / delta)
            by = round(abs(e0 / n0 - e1 / n1) - math.sqrt(2 / m * rate * (1 - rate) * log) - 2 / (3 * m) * log, 9)
            if by > 0 and (best is None or (by, at) > best):
                best = (by, at)
        drifted = best is not None
        window = window[best[1]:] if drifted else window
        out.append((batch, n, errors, window[0][0], sum(b[1] for b in window), sum(b[2] for b in window), drifted))
    return out


def test_windows_equal_the_formula(spark):
    draw = random.Random(4)
    rows, want = [], set()
    for key in range(40):
        rate, buckets = draw.random() * 0.5, []
        for batch in range(12):
            if draw.random() < 0.15:
                rate = draw.random()
            n = draw.randint(20, 400)
            buckets.append((batch, n, sum(draw.random() < rate for _ in range(n))))
        rows += [(key, *b) for b in buckets]
        want |= {(key, *w) for w in plain_windows(buckets)}
    got = drift.error_windows(spark.createDataFrame(rows, "k int, batch int, n long, errors long"), ["k"])
    assert {tuple(r) for r in got.collect()} == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def activations(make_log, holds, n_batches=6, per_batch=300, more=lambda d: {}, seed=3):
    """Batches of activations of Response[a, b]; ``holds(batch, bag)`` says whether a is followed by b."""
    draw, bags, traces = random.Random(seed), {}, {}
    for batch in range(n_batches):
        for i in range(per_batch):
            bag = {"x": str(draw.randrange(100)), "batch": str(batch), **more(draw)}
            bags[f"c{batch}_{i}"] = bag
            traces[f"c{batch}_{i}"] = "ab" if holds(batch, bag) else "ac"
    log = make_log(traces, attrs=lambda c, i, a: bags[c])
    log = log.withColumn("batch", F.col("attrs")["batch"].cast("int")).withColumn("attrs", F.map_filter("attrs", lambda k, _: k != "batch"))
    rows = learning.freeze(trees.activations(log, [("a", "b")], ["Response"], keep=["batch"]))
    return [(b, rows.filter(F.col("batch") == b).drop("batch")) for b in range(n_batches)]


def rule(learner):
    """Conditions of the leaves where fulfilment is the majority."""
    return {tuple((s.attr, s.op) for s in r.steps) for r in learner.leaves().collect() if r.n1 > r.n0}


def test_a_rule_that_flips_is_learnt_anew(make_log):
    batches = activations(make_log, lambda b, bag: (int(bag["x"]) > 50) == (b < 3))
    learner = IncrementalTrees(LOOSE)
    learner.learn(batches[:3])
    assert rule(learner) == {(("x", ">"),)} and learner.all_resets() is None
    learner.learn(batches[3:])
    assert rule(learner) == {(("x", "<="),)}
    assert [(r.node, r.batch) for r in learner.all_resets().collect()] == [("", 3)]


def test_a_stationary_log_resets_nothing(make_log):
    """A noisy rule that stays: no resets, and its scores add up over the batches."""
    noise = random.Random(8)
    batches = activations(make_log, lambda b, bag: (int(bag["x"]) > 50) ^ (noise.random() < 0.1))
    learner = IncrementalTrees(LOOSE).learn(batches)
    assert learner.all_resets() is None
    assert (("x", ">"),) in rule(learner)
    (score,) = learner.total_scores().collect()
    assert score.tp + score.fn == sum(rows.filter("y").count() for _, rows in batches)
    assert score.tp > 4 * score.fp


def test_only_the_part_that_drifts_is_forgotten(make_log):
    """In one half of the tree the rule flips; the split above and the other half stay."""
    def holds(b, bag):
        if bag["c"] == "r":
            return True
        return (int(bag["x"]) > 80) == (b < 4)

    batches = activations(make_log, holds, n_batches=6, more=lambda d: {"c": d.choice("rg")})
    learner = IncrementalTrees(LOOSE).learn(batches)
    resets = {(r.node, r.batch) for r in learner.all_resets().collect()}
    assert resets and all(node for node, _ in resets)  # never the root
    assert rule(learner) == {(("c", "!="),), (("c", "=="), ("x", "<="))} or rule(learner) == {(("c", "=="),), (("c", "!="), ("x", "<="))}


def test_poor_attributes_leave_the_state(make_log):
    """x and its copy are equally good, so the leaf waits; the constant and the noise are given up meanwhile."""
    def more(d):
        return {"k": "same", "noise": d.choice("pqr")}

    batches = activations(make_log, lambda b, bag: int(bag["x"]) > 50, more=more)
    batches = [(b, rows.withColumn("feats", F.concat("feats", F.transform(
        F.filter("feats", lambda f: f["attr"] == "x"), lambda f: F.struct(F.lit("y").alias("attr"), f["num"].alias("num"), f["code"].alias("code"), f["val"].alias("val"))))))
        for b, rows in batches]
    careful = Settings(grace=100, delta=1e-3, tau=0.03)
    learner, keeper = IncrementalTrees(careful), IncrementalTrees(careful, give_up=False)
    for number, rows in batches:
        learner.step(rows, number)
        keeper.step(rows, number)
        if number == 1:
            attrs = lambda m: {r.attr for r in m.cells.select("attr").distinct().collect()} - {None}
            assert attrs(learner) == {"x", "y"} and attrs(keeper) == {"x", "y", "k", "noise"}
    tree = lambda m: sorted((r.node, str(r.steps), r.n1, r.n0) for r in m.leaves().collect())
    assert tree(learner) == tree(keeper)


def test_constraints_that_appear_late_start_at_the_root(make_log):
    batches = activations(make_log, lambda b, bag: int(bag["x"]) > 50, n_batches=3)
    late = [(n, rows if n == 0 else rows.unionByName(rows.withColumn("constraint_id", F.lit(5)))) for n, rows in batches]
    leaves = IncrementalTrees(LOOSE).learn(late).leaves().collect()
    assert {r.constraint_id for r in leaves} == {0, 5}
