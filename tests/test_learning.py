import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import learning, metrics, templates
from caseweave.operators.learning import AttributeTests, Settings


@pytest.fixture(scope="module")
def planted(make_log):
    """a is followed by b exactly if x > 50; noise and colour say nothing."""
    rnd = random.Random(7)
    traces, bags = {}, {}
    for i in range(1500):
        x = rnd.randint(0, 100)
        traces[f"c{i}"] = "ab" if x > 50 else "ac"
        bags[f"c{i}"] = {"x": str(x), "noise": str(rnd.random()), "colour": rnd.choice(["red", "blue"])}
    return make_log(traces, attrs=lambda case, i, a: bags[case] if i == 0 else {})


def test_planted_rule_is_found(planted):
    rules = learning.learn_conditions(planted, [("a", "b")]).collect()
    got = {r.template: r for r in rules}
    rule = got["Response"]
    assert rule.condition.startswith("x > ") and rule.probability >= 0.9
    assert got["Not Response"].condition.startswith("x <= ")
    assert "noise" not in rule.condition and "colour" not in rule.condition
    assert rule.n_activations == 1500


def test_learned_rule_raises_the_ratio(planted):
    rules = learning.learn_conditions(planted, [("a", "b")], templates=["Response"])
    out = metrics.data_aware_ratios(planted, [("a", "b")], rules.select("template", "first", "second", "conjuncts"))
    by = {r.template: r for r in out.collect()}
    assert by["Response"].ratio_data > 0.9 > by["Response"].ratio
    assert by["Not Response"].ratio_data > 0.9 > by["Not Response"].ratio


def test_noise_gives_no_rule(make_log):
    rnd = random.Random(1)
    traces = {f"c{i}": rnd.choice(["ab", "ac"]) for i in range(1500)}
    log = make_log(traces, attrs=lambda *_: {"noise": str(rnd.random()), "colour": rnd.choice(["red", "blue"])})
    assert learning.learn_conditions(log, [("a", "b")]).count() == 0


def test_nominal_rule_and_missing_values(make_log):
    rnd = random.Random(2)
    traces, bags = {}, {}
    for i in range(1200):
        colour = rnd.choice(["red", "blue", None])
        traces[f"c{i}"] = {"red": "ab", "blue": "ac"}.get(colour) or rnd.choice(["ab", "ac"])
        bags[f"c{i}"] = {"colour": colour} if colour else {}
    log = make_log(traces, attrs=lambda case, i, a: bags[case])
    rules = {r.template: r.condition for r in learning.learn_conditions(log, [("a", "b")], templates=["Response"]).collect()}
    assert rules["Response"] in ("colour == 'red'", "colour != 'blue'")


def test_balance_gate():
    assert Settings().balance == 1.5


def test_gate_and_tie_order(spark):
    schema = f"template string, first string, second string, node string, steps {learning.STEPS}, n1 long, n0 long"
    step = lambda op, v: [("x", op, v, 0, 0)]
    rows = [
        ("R", "a", "b", "0", step("<=", "1"), 90, 10), ("R", "a", "b", "1", step(">", "1"), 9, 81),
        ("S", "a", "b", "0", step("<=", "1"), 100, 0), ("S", "a", "b", "1", step(">", "1"), 20, 10),  # unbalanced
        ("T", "a", "b", "0", step("<=", "1"), 30, 10), ("T", "a", "b", "1", step(">", "1"), 30, 10),  # 60 : 20
        ("U", "a", "b", "", [], 50, 50),  # no split
        ("V", "a", "b", "0", step("<=", "1"), 40, 20), ("V", "a", "b", "10", step(">", "1"), 20, 10),
        ("V", "a", "b", "11", step(">", "2"), 0, 30),
    ]
    got = {r.template: (r.condition, r.probability) for r in learning.best_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "R": ("x <= 1", 0.9), "Not R": ("x > 1", 0.9), "V": ("x <= 1", 0.67), "Not V": ("x > 2", 1.0),
    }


def test_split_statistics_by_hand(spark):
    rows = [("t", [0, 1000], 8, 2), ("t", [1, 1001], 1, 5), ("t", [2, -1], 1, 3)]
    df = spark.createDataFrame(rows, "k string, codes array<int>, n1 long, n0 long")
    got = {(r.attr_id, r.code): r for r in learning.split_statistics(df, ["k"]).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 1000), (1, 1001)}
    assert (got[0, 1].left1, got[0, 1].left0, got[0, 1].right1, got[0, 1].right0) == (9, 7, 1, 3)
    assert (got[1, 1000].left1, got[1, 1000].right0, got[1, 1000].total) == (8, 5, 20)


def test_rule_counts_on_cells_match_the_log(planted):
    tests = learning.attribute_tests(planted)
    cells = learning.cells(planted, [("a", "b")], tests, ["Response"])
    rules = learning.best_rules(learning.grow(cells, tests), steps=True)
    on_cells = {r.template: (r.n_activations_data, r.n_fulfilled_data) for r in learning.rule_counts(cells, rules).collect()}
    plain = rules.select("template", "first", "second", "conjuncts")
    on_log = {
        r.template: (r.n_activations_data, r.n_fulfilled_data)
        for r in metrics.data_aware_ratios(planted, [("a", "b")], plain, ["Response"]).collect()
    }
    assert on_cells == on_log and on_cells
    tp = {r.template: (r.tp, r.tp + r.fp) for r in learning.confusion(cells, rules).collect()}
    assert tp == {t: (f, n) for t, (n, f) in on_cells.items()}


def test_attribute_tests_keep_common_values_only(make_log):
    log = make_log({f"c{i}": "a" for i in range(300)}, attrs=lambda c, i, a: {"id": c, "n": c[1:], "flag": "True"})
    got = {t.name: t for t in learning.attribute_tests(log)}
    assert got["flag"].values == ("true",)
    assert 2 <= len(got["n"].cuts) <= 15 and "id" not in got


def test_counted_and_single_activations_agree(planted, monkeypatch):
    rules = learning.learn_conditions(planted, [("a", "b")]).select("template", "first", "second", "conjuncts")
    rules = learning.freeze(rules)
    few = {tuple(r) for r in metrics.data_aware_ratios(planted, [("a", "b")], rules).collect()}
    monkeypatch.setattr(metrics, "COUNTED_CONDITIONS", 0)
    many = {tuple(r) for r in metrics.data_aware_ratios(planted, [("a", "b")], rules).collect()}
    assert few == many and len(few) >= 2
