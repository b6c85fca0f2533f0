import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import learning, trees
from caseweave.operators.learning import Settings

RESPONSE = ["Response"]


def rules_of(log, **more):
    leaves = trees.learn(log, [("a", "b")], RESPONSE, **more)
    return {r.template: r for r in learning.best_rules(learning.freeze(leaves)).collect()}


def planted(make_log, n, holds, bag, seed=7):
    """a is followed by b exactly if ``holds`` says so of the bag of attributes."""
    draw = random.Random(seed)
    bags = {f"c{i}": bag(draw) for i in range(n)}
    log = make_log({c: "ab" if holds(b) else "ac" for c, b in bags.items()}, attrs=lambda case, i, a: bags[case] if i == 0 else {})
    return log, bags


def test_cut_between_two_bins_is_exact(make_log):
    log, bags = planted(make_log, 1500, lambda b: float(b["x"]) > 0.487, lambda d: {"x": repr(d.random()), "noise": repr(d.random())})
    cut = max(float(b["x"]) for b in bags.values() if float(b["x"]) <= 0.487)
    rules = rules_of(log)
    assert rules["Response"].condition == f"x > {cut!r}" and rules["Response"].probability == 1.0
    assert rules["Not Response"].condition == f"x <= {cut!r}"


def test_tiny_numbers_and_an_attribute_of_a_rare_activity(make_log):
    """x is carried by a alone, one event in four hundred, and lies in 0 .. 0.001."""
    draw = random.Random(1)
    xs = {f"c{i}": draw.random() / 1000 for i in range(400)}
    log = make_log({c: "a" + ("b" if x > 0.0004 else "c") + "z" * 200 for c, x in xs.items()}, attrs=lambda c, i, a: {"x": f"{xs[c]:.9f}"} if i == 0 else {"w": "1"})
    cut = max(float(f"{x:.9f}") for x in xs.values() if x <= 0.0004)
    rule = rules_of(log, settings=Settings(balance=2.0))["Response"]
    (conjunct,) = rule.conjuncts
    assert (conjunct.attr, conjunct.op, float(conjunct.value)) == ("x", ">", cut)


def test_values_of_any_share_are_counted(make_log):
    """No value is dropped: 200 clerks of half a percent each all stand in the cells."""
    log, _ = planted(make_log, 2000, lambda b: int(b["clerk"][1:]) < 100, lambda d: {"clerk": f"k{d.randrange(200)}"})
    rows = trees.activations(log, [("a", "b")], RESPONSE).withColumn("node", F.lit(""))
    cells = trees._cells(rows, ["constraint_id"]).filter("val IS NOT NULL").collect()
    assert len(cells) == 200 and sum(c.n1 + c.n0 for c in cells) == 2000
    assert all((c.n0 == 0) == (int(c.val[1:]) < 100) for c in cells)


def test_branches_may_be_as_small_as_the_settings_say(make_log):
    """One clerk of half a percent decides; the default wants a hundredth on either side."""
    log, _ = planted(make_log, 4000, lambda b: b["clerk"] == "k7", lambda d: {"clerk": f"k{d.randrange(200)}"})
    assert trees.learn(log, [("a", "b")], RESPONSE).count() == 1
    leaves = trees.learn(log, [("a", "b")], RESPONSE, Settings(min_branch=0.0, delta=0.5)).collect()
    assert sorted((r.node, r.steps[0].op, r.steps[0].value, r.n1 == 0, r.n0 == 0) for r in leaves) == [
        ("0", "==", "k7", False, True), ("1", "!=", "k7", True, False)]


def test_cells_do_not_grow_with_attributes_multiplied(make_log):
    draw = random.Random(3)
    log = make_log({f"c{i}": "ab" for i in range(300)}, attrs=lambda c, i, a: {f"x{k}": str(draw.randrange(5)) for k in range(12)})
    rows = trees.activations(log, [("a", "b")], RESPONSE).withColumn("node", F.lit(""))
    assert trees._cells(rows, ["constraint_id"]).count() <= 12 * 5 + 1


def test_blocked_sums_give_the_same_cuts(make_log, monkeypatch):
    log, _ = planted(make_log, 1200, lambda b: (float(b["x"]) > 0.3) == (b["c"] == "r"), lambda d: {"x": repr(d.random()), "c": d.choice("rg")})
    some = sorted(map(tuple, trees.learn(log, [("a", "b")]).collect()))
    monkeypatch.setattr(trees, "WINDOW_ROWS", 0)
    assert sorted(map(tuple, trees.learn(log, [("a", "b")]).collect())) == some and len(some) > 7


def plain_tree(rows, settings, node="", out=None):
    """The same tree by trying every value of every attribute on lists of (bag, label)."""
    from math import log, log2, sqrt

    out = {} if out is None else out
    ones = sum(y for _, y in rows)
    out[node] = (ones, len(rows) - ones)
    if len(rows) < settings.grace or len(node) == settings.max_depth:
        return out
    entropy = lambda a, b: sum(-x / (a + b) * log2(x / (a + b)) for x in (a, b) if x) if a + b else 0.0
    best = []
    for attr in sorted({a for bag, _ in rows for a in bag}):
        have = [(bag[attr], y) for bag, y in rows if attr in bag]
        numbers = [(float(v), y) for v, y in have if v.replace(".", "").isdigit()]
        texts = [v for v, _ in have if not v.replace(".", "").isdigit()]
        tests = [(0, c, [(v <= c, y) for v, y in numbers]) for c in sorted({v for v, _ in numbers})]
        tests += [(1, t, [(v == t, y) for v, y in have]) for t in sorted(set(texts))]
        found = []
        for kind, value, sides in tests:
            l1, l0 = sum(s and y for s, y in sides), sum(s and not y for s, y in sides)
            a1 = sum(y for _, y in sides)
            a0 = len(sides) - a1
            if min(l1 + l0, len(sides) - l1 - l0) <= settings.min_branch * len(sides):
                continue
            left, n = l1 + l0, len(sides)
            gain = round(n / len(rows) * (entropy(a1, a0) - left / n * entropy(l1, l0) - (n - left) / n * entropy(a1 - l1, a0 - l0)), 9)
            found.append((-gain, kind, value, left >= n - left))
        if found:
            best.append((min(found), attr))
    if not best:
        return out
    best.sort(key=lambda b: (b[0][0], b[1]))
    bound = sqrt(log(1 / settings.delta) / (2 * len(rows)))
    gain, second = -best[0][0][0], -best[1][0][0] if len(best) > 1 else 0.0
    if gain <= bound or not (gain - (second if second > bound else 0.0) > bound or bound < settings.tau):
        return out
    (_, kind, value, default), attr = best[0]
    del out[node]

    def left(bag):
        if attr not in bag:
            return default
        if kind:
            return bag[attr] == value
        return float(bag[attr]) <= value if bag[attr].replace(".", "").isdigit() else default

    plain_tree([r for r in rows if left(r[0])], settings, node + "0", out)
    plain_tree([r for r in rows if not left(r[0])], settings, node + "1", out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_trying_every_value(make_log, seed):
    """Mixed, missing and repeated values; a loose bound, so that deep and odd splits come about."""
    def bag(d):
        b = {"x": f"{d.random():.3f}", "n": str(d.randrange(4)), "c": d.choice(["r", "g", "b"]), "m": d.choice(["1", "2", "t", "u"])}
        return {k: v for k, v in b.items() if d.random() < 0.8}

    def holds(b):
        return (float(b.get("x", "0.5")) > 0.35) ^ (b.get("c") == "r") ^ (b.get("m") == "t")

    log, bags = planted(make_log, 700, holds, bag, seed)
    settings = Settings(grace=40, delta=0.3, tau=0.2)
    got = {r.node: (r.n1, r.n0) for r in trees.learn(log, [("a", "b")], RESPONSE, settings).collect()}
    assert got == plain_tree([(b, int(holds(b))) for b in bags.values()], settings) and len(got) > 3


def test_versions_are_trees_of_the_batches_before(make_log):
    log, _ = planted(make_log, 1600, lambda b: int(b["x"]) > 40, lambda d: {"x": str(d.randrange(100)), "batch": str(d.randrange(1, 5))})
    log = log.withColumn("batch", F.coalesce(F.col("attrs")["batch"], F.lit("1")).cast("int")).withColumn("attrs", F.map_filter("attrs", lambda k, _: k != "batch"))
    rows = trees.activations(log, [("a", "b")], keep=["batch"])
    got = {}
    for r in trees.grow(rows, versions=[1, 2, 3, 4]).leaves().collect():
        got.setdefault(r.version, set()).add((r.constraint_id, r.node, str(r.steps), r.n1, r.n0))
    for v in (2, 3, 4):
        alone = trees.grow(rows.filter(F.col("batch") < v)).leaves().collect()
        assert got[v] == {(r.constraint_id, r.node, str(r.steps), r.n1, r.n0) for r in alone}
    assert set(got) == {2, 3, 4}


def test_scores_of_learnt_trees_beat_the_majority(make_log):
    log, _ = planted(make_log, 1600, lambda b: int(b["x"]) > 60, lambda d: {"x": str(d.randrange(100))})
    batch = F.regexp_extract("case_id", r"(\d)$", 1).cast("int")
    (score,) = trees.prequential_scores(log, [("a", "b")], batch, range(10), RESPONSE).collect()
    n = log.filter("activity = 'a'").count()
    assert score.fp == 0 and score.f1 > 0.8  # the first batches know nothing
    assert score.tp + score.fn == log.filter("activity = 'b'").count() < n / 2


def test_empty_log(make_log):
    assert trees.learn(make_log({}), [("a", "b")]).count() == 0
    assert trees.learn(make_log({"c": "ab"}), [("a", "b")]).count() == 7


def _binned_log(make_log, copies=1):
    value = lambda case, i, activity: {"x": str(int(case[1:]) % 331 * 7 % 331)}
    return make_log({f"c{n}": "ab" if n % 331 * 7 % 331 <= 143 else "ac" for n in range(331 * copies)}, attrs=value)


def test_counted_activations_do_not_grow_with_copies(make_log):
    few, many = (trees.Binned(_binned_log(make_log, k), [("a", "b")], RESPONSE, complete=True).rows() for k in (1, 4))
    assert many.count() == few.count() <= 2 * trees.BINS + 2
    assert many.agg(F.sum(F.col("n1") + F.col("n0"))).head()[0] == 4 * 331


def test_a_cut_inside_a_bin_divides_it(make_log):
    source = trees.Binned(_binned_log(make_log), [("a", "b")], RESPONSE, complete=True)
    grown = trees.grow(source)
    assert [r.num for r in grown.splits.collect()] == [143.0]
    wrong = trees.predicted(source.rows(grown.splits), grown).agg(F.sum(F.when(F.col("predicted"), F.col("n0")).otherwise(F.col("n1")))).head()[0]
    assert wrong == 0


def _noise(spark, cases):
    """a, then b or c by chance; x says nothing."""
    events = spark.range(cases).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    toss = F.when(F.xxhash64("id") % 2 == 0, "b").otherwise("c")
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)).cast("string")
    return events.select(
        F.col("id").cast("string").alias("case_id"), F.when(F.col("seq") == 0, "a").otherwise(toss).alias("activity"),
        F.timestamp_seconds("seq").alias("ts"), F.col("seq").cast("long").alias("seq"), F.create_map(F.lit("x"), x).alias("attrs"))


def test_no_bin_of_noise_is_searched(spark, monkeypatch):
    """Bins at the ends of the numbers promise no more than others, so the events are not read again for nothing."""
    source = trees.Binned(_noise(spark, 250_000), [("a", "b")], RESPONSE, complete=True)
    read = []
    monkeypatch.setattr(trees.Binned, "inside", lambda self, bins, inside=trees.Binned.inside: (read.append(1), inside(self, bins))[1])
    (leaf,) = trees.grow(source).leaves().collect()
    assert leaf.node == "" and leaf.n1 + leaf.n0 == 250_000 and not read


def test_one_counted_row_per_constraint_and_values(make_log):
    """Whatever else is true of the events: verdicts of other templates make no rows of their own."""
    value = lambda case, i, activity: {"c": "rg"[int(case[1:]) % 2]}
    log = make_log({f"c{n}": ["ab", "aab", "ba", "acb", "a"][n % 5] for n in range(40)}, attrs=value)
    rows = trees.Binned(log, [("a", "b"), ("b", "a")], complete=True).rows()
    assert rows.count() == rows.select("constraint_id", "feats").distinct().count() == 28


def test_listed_attributes_and_columns_give_the_same_rows(make_log, monkeypatch):
    draw = random.Random(5)
    bags = [{k: v for k, v in {"x": repr(draw.random()), "c": draw.choice(["r", "TRUE", "7", "g"]), "e": None}.items() if draw.random() < 0.8} for _ in range(300)]
    log = make_log({f"c{n}": "ab" if n % 3 else "ac" for n in range(300)}, attrs=lambda case, i, activity: bags[int(case[1:])] if i == 0 else {})

    def rows():
        found = trees.Binned(log, [("a", "b")], RESPONSE, complete=True).rows().collect()
        return sorted((r.constraint_id, sorted((f.attr, f.num is None, f.num or 0.0, f.val or "", f.many) for f in r.feats), r.n1, r.n0) for r in found)

    some = rows()
    monkeypatch.setattr(trees, "COLUMNS", 0)
    assert rows() == some and sum(r[2] + r[3] for r in some) == 300


def test_versions_from_counted_rows_are_those_from_activations(make_log):
    log, _ = planted(make_log, 900, lambda b: int(b["x"]) > 40, lambda d: {"x": str(d.randrange(100))})
    log = log.withColumn("batch", F.regexp_extract("case_id", r"(\d)$", 1).cast("int") % 3)
    plain, settings = trees.activations(log, [("a", "b")], RESPONSE, keep=["batch"], complete=True), Settings(max_depth=2)
    counted = trees.Binned(log, [("a", "b")], RESPONSE, keep=["batch"], complete=True)
    got = [sorted(map(str, trees.grow(s, settings, versions=[1, 2]).leaves().select("version", "node", "steps", "n1", "n0").collect())) for s in (plain, counted)]
    assert got[0] == got[1] and len(got[0]) > 2
