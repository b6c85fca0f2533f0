"""Learning one data condition per constraint: a decision tree for all constraints at once.

The tree is grown level by level from counts. Attributes are coded once -- numbers by the bin
between cut points, other values by their place in the list of common values -- and the
activations are counted per (constraint, code vector, verdict). These *cells* are all the
learner needs, so the log is scanned once, whatever the depth, and the negated templates
share the trees of the plain ones with the classes swapped.

A node is split when the Hoeffding bound separates its best two attributes (or they tie below
``tau``), like the incremental tree this replaces, and separates the best one from not
splitting at all; that part has no tie rule, so noise is not split however long the log.
The result is deterministic: equal gains go to the earlier attribute, then to the smaller code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.conditions import condition_text
from caseweave.functions.scalars import as_boolean, as_number, number_text, payload, ratio3
from caseweave.operators.metrics import CONSTRAINT
from caseweave.operators.templates import TEMPLATES, constraint_counts, with_negations
from caseweave.session import freeze

# A conjunct and the coded test it came from.
STEPS = "array<struct<attr:string,op:string,value:string,attr_id:int,code:int>>"

MISSING, RARE = -1, -2
#: Codes from here on are places in the list of common values; below are numeric bins.
NOMINAL = 1000


@dataclass(frozen=True)
class Settings:
    max_depth: int = 4
    grace: int = 200  # activations a node needs before it may be split
    delta: float = 1e-7
    tau: float = 0.05
    bins: int = 16
    min_share: float = 0.01  # attributes and values rarer than this are not tested
    min_branch: float = 0.01  # both branches of a split hold more than this share
    balance: float = 1.5


@dataclass(frozen=True)
class AttributeTests:
    """The tests to choose from: cut points for numbers, common values for the rest."""

    name: str
    cuts: tuple[float, ...] = ()
    values: tuple[str, ...] = field(default=())


def _normal_text(text: Column) -> Column:
    return F.when(as_boolean(text).isNotNull(), F.lower(text)).otherwise(text)


def attribute_tests(log: DataFrame, settings: Settings = Settings()) -> list[AttributeTests]:
    """Choose the tests from the log. Small by construction: at most 1/min_share values and
    ``bins`` cut points per attribute."""
    total = log.count()
    floor = max(1.0, settings.min_share * total)
    entries = log.select(F.explode(payload(F.col("attrs"))).alias("attr", "text"))
    steps = [i / settings.bins for i in range(1, settings.bins)]
    number = as_number(F.col("text"))
    numeric = (
        entries.groupBy("attr")
        .agg(F.count(number).alias("n"), F.percentile_approx(number, steps, 10_000).alias("cuts"))
        .filter(F.col("n") >= floor)
        .select("attr", F.array_sort(F.array_distinct("cuts")).alias("cuts"))
    )
    nominal = (
        entries.filter(number.isNull())
        .groupBy("attr", _normal_text(F.col("text")).alias("value"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= floor)
        .groupBy("attr")
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )
    rows = numeric.join(nominal, "attr", "full").orderBy("attr").collect()
    return [AttributeTests(r.attr, tuple(r.cuts or ()), tuple(r["values"] or ())) for r in rows]


def with_codes(log: DataFrame, tests: Sequence[AttributeTests]) -> DataFrame:
    """The log with ``codes``: per attribute its bin (how many cuts lie below the value), the
    place of its value among the common ones, RARE or MISSING."""
    # Text and number get columns of their own, so each value is looked up and parsed once.
    texts = log.select("*", *[F.col("attrs")[t.name].alias(f"_text{i}") for i, t in enumerate(tests)])
    parsed = texts.select("*", *[as_number(F.col(f"_text{i}")).alias(f"_num{i}") for i, t in enumerate(tests) if t.cuts])
    codes = []
    for i, t in enumerate(tests):
        text, number = F.col(f"_text{i}"), F.col(f"_num{i}")
        code = F.when(text.isNull(), F.lit(MISSING))
        if t.cuts:
            above = F.lit(0)
            for cut in t.cuts:
                above = above + (number > F.lit(cut)).cast("int")
            code = code.when(number.isNotNull(), above)
        for j, value in enumerate(t.values):
            code = code.when(_normal_text(text) == value, F.lit(NOMINAL + j))
        codes.append(code.otherwise(F.lit(RARE)))
    return parsed.select(*log.columns, F.array(*codes).cast("array<int>").alias("codes"))


def cells(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    tests: Sequence[AttributeTests],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """(constraint, codes, n1 fulfilled, n0 violated, n_pending): activations per code vector."""
    counts = constraint_counts(with_codes(log, tests), pairs, templates, group=["codes"], complete=complete, hot_rows=hot_rows)
    return counts.select(
        *CONSTRAINT,
        "codes",
        F.col("n_fulfilled").alias("n1"),
        (F.col("n_activations") - F.col("n_fulfilled")).alias("n0"),
        "n_pending",
    )


def cell_totals(cell_rows: DataFrame) -> DataFrame:
    """The constraint counts, summed up from cells."""
    return cell_rows.groupBy(*CONSTRAINT).agg(
        F.sum(F.col("n1") + F.col("n0")).alias("n_activations"),
        F.sum("n1").alias("n_fulfilled"),
        F.sum("n_pending").alias("n_pending"),
    )


def test_table(df: DataFrame, tests: Sequence[AttributeTests]) -> DataFrame:
    """(attr_id, code) -> the test ``attr <= cut`` or ``attr == value`` in words."""
    numbers, values = [], []
    for i, t in enumerate(tests):
        numbers += [(i, j, t.name, float(cut)) for j, cut in enumerate(t.cuts)]
        values += [(i, NOMINAL + j, t.name, value) for j, value in enumerate(t.values)]
    spark = df.sparkSession
    low = spark.createDataFrame(numbers, "attr_id int, code int, attr string, cut double").select(
        "attr_id", "code", "attr", F.lit("<=").alias("op"), F.lit(">").alias("else_op"),
        # Two places where they are the number itself, else all its digits: rules are tested by this text.
        F.when(F.round("cut", 2) == F.col("cut"), number_text(F.col("cut"))).otherwise(F.col("cut").cast("string")).alias("value"),
    )
    same = spark.createDataFrame(values, "attr_id int, code int, attr string, value string").select(
        "attr_id", "code", "attr", F.lit("==").alias("op"), F.lit("!=").alias("else_op"), "value"
    )
    return low.unionByName(same)


def _entropy(a: Column, b: Column) -> Column:
    def term(x):
        return F.when(x > 0, -(x / (a + b)) * F.log2(x / (a + b))).otherwise(F.lit(0.0))

    return F.when(a + b > 0, term(a) + term(b)).otherwise(F.lit(0.0))


def split_statistics(rows: DataFrame, keys: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """Counts on both sides and information gain of every test, per ``keys``.

    ``rows``: keys, codes, n1, n0. Rows without the attribute count in ``total`` only; the gain
    is scaled by the share of rows that have it.
    """
    here = [*keys, "attr_id"]
    counted = (
        rows.select(*keys, "n1", "n0", F.posexplode("codes").alias("attr_id", "code"))
        .groupBy(*here, "code")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    )
    # One row per code of one attribute: windows of a few dozen rows.
    whole = Window.partitionBy(*here)
    upto = whole.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    numeric = (F.col("code") >= 0) & (F.col("code") < NOMINAL)
    nominal = F.col("code") >= NOMINAL
    nominal_side = nominal | (F.col("code") == RARE)

    def over(condition, column, window):
        return F.coalesce(F.sum(F.when(condition, F.col(column))).over(window), F.lit(0))

    sides = counted.select(
        *here,
        "code",
        F.sum(F.col("n1") + F.col("n0")).over(whole).alias("total"),
        F.when(numeric, over(numeric, "n1", upto)).otherwise(F.col("n1")).alias("left1"),
        F.when(numeric, over(numeric, "n0", upto)).otherwise(F.col("n0")).alias("left0"),
        F.when(numeric, over(numeric, "n1", whole)).otherwise(over(nominal_side | numeric, "n1", whole)).alias("all1"),
        F.when(numeric, over(numeric, "n0", whole)).otherwise(over(nominal_side | numeric, "n0", whole)).alias("all0"),
    ).filter(numeric | nominal)
    sides = sides.withColumn("right1", F.col("all1") - F.col("left1")).withColumn(
        "right0", F.col("all0") - F.col("left0")
    )
    left, right = F.col("left1") + F.col("left0"), F.col("right1") + F.col("right0")
    present = left + right
    gain = (present / F.col("total")) * (
        _entropy(F.col("all1"), F.col("all0"))
        - (left / present) * _entropy(F.col("left1"), F.col("left0"))
        - (right / present) * _entropy(F.col("right1"), F.col("right0"))
    )
    return sides.filter(F.least(left, right) > settings.min_branch * present).select(
        *here, "code", "total", "left1", "left0", "right1", "right0", gain.alias("gain")
    )


def choose_splits(stats: DataFrame, keys: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """The nodes to split and their test: best attribute against the second best."""
    per_attribute = stats.groupBy(*keys, "attr_id").agg(
        F.max_by(
            F.struct("gain", "attr_id", "code", "total", (F.col("left1") + F.col("left0")).alias("n_left"),
                     (F.col("right1") + F.col("right0")).alias("n_right")),
            F.struct("gain", -F.col("code")),
        ).alias("best")
    )
    per_node = per_attribute.groupBy(*keys).agg(
        F.max_by("best", F.struct(F.col("best.gain"), -F.col("attr_id"))).alias("best"),
        # one gain per attribute, so the list is as short as the list of attributes
        F.sort_array(F.collect_list(F.col("best.gain")), asc=False).alias("gains"),
    )
    bound = F.sqrt(F.lit(math.log(1.0 / settings.delta)) / (2 * F.col("best.total")))
    lead = F.col("best.gain") - F.coalesce(F.get("gains", F.lit(1)), F.lit(0.0))
    return per_node.filter(
        (F.col("best.total") >= settings.grace)
        & (F.col("best.gain") > bound)
        & ((lead > bound) | (bound < settings.tau))
    ).select(*keys, "best.*")


def grow(cell_rows: DataFrame, tests: Sequence[AttributeTests], settings: Settings = Settings()) -> DataFrame:
    """Leaves of all trees: (constraint, node, steps, n1, n0).

    ``node`` is the path from the root, ``0`` for the branch where the test holds; sorted as
    text, leaves come depth-first, left first. Each level writes its few splits, so a level
    costs one pass over the cells and one shuffle of counts.
    """
    keys = [*CONSTRAINT, "node"]
    words = test_table(cell_rows, tests)
    rows = cell_rows.withColumn("node", F.lit("")).withColumn("steps", F.array().cast(STEPS))
    for depth in range(settings.max_depth):
        open_rows = rows.filter(F.length("node") == depth)
        splits = freeze(
            choose_splits(split_statistics(open_rows, keys, settings), keys, settings)
            .drop("gain", "total")
            .join(F.broadcast(words), ["attr_id", "code"]),
            "splits",
        )
        if not splits.head(1):
            break
        have = F.get("codes", F.col("attr_id"))
        is_number = (have >= 0) & (have < NOMINAL)
        holds = F.when(F.col("op") == "<=", F.when(is_number, have <= F.col("code"))).otherwise(
            F.when(have != MISSING, have == F.col("code"))
        )
        to_left = F.coalesce(holds, F.col("n_left") >= F.col("n_right"))
        test = F.struct(
            F.col("attr"), F.when(F.col("_left"), F.col("op")).otherwise(F.col("else_op")).alias("op"), F.col("value"),
            "attr_id", "code",
        )
        was_split = F.col("attr").isNotNull()
        rows = (
            rows.join(splits, keys, "left")
            .withColumn("_left", to_left)
            .select(
                *CONSTRAINT,
                "codes",
                "n1",
                "n0",
                F.when(was_split, F.concat("node", F.when(F.col("_left"), "0").otherwise("1")))
                .otherwise(F.col("node"))
                .alias("node"),
                F.when(was_split, F.array_append("steps", test)).otherwise(F.col("steps")).alias("steps"),
            )
        )
    return rows.groupBy(*keys, "steps").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def fulfilment_rules(leaves: DataFrame) -> DataFrame:
    """Leaves where fulfilment is the majority, for templates and negations, with their
    probability to 2 places."""
    both = with_negations(leaves, {"n1": F.col("n0"), "n0": F.col("n1")})
    return both.withColumn("probability", F.round(F.col("n1") / (F.col("n1") + F.col("n0")), 2))


def best_rules(leaves: DataFrame, settings: Settings = Settings(), *, steps: bool = False) -> DataFrame:
    """One rule per constraint: from trees with a split whose classes are balanced, the leaf
    with the highest probability, the first one on ties. ``steps`` keeps the coded tests."""
    rules = fulfilment_rules(leaves)
    majority = F.col("n1") > F.col("n0")
    order = F.when(majority, F.struct(-F.col("probability"), F.col("node")))
    summed = rules.groupBy(*CONSTRAINT).agg(
        F.min_by(F.when(majority, F.struct("steps", "probability")), order).alias("best"),
        F.sum("n1").alias("n1"),
        F.sum("n0").alias("n0"),
        F.count("*").alias("n_leaves"),
    )
    larger, smaller = F.greatest("n1", "n0"), F.least("n1", "n0")
    balanced = (smaller > 0) & (larger / F.when(smaller > 0, smaller) <= settings.balance)
    conjuncts = F.transform(
        F.col("best.steps"), lambda s: F.struct(s["attr"].alias("attr"), s["op"].alias("op"), s["value"].alias("value"))
    )
    return summed.filter((F.col("n_leaves") > 1) & balanced & F.col("best").isNotNull()).select(
        *CONSTRAINT,
        conjuncts.alias("conjuncts"),
        condition_text(conjuncts).alias("condition"),
        F.col("best.probability").alias("probability"),
        (F.col("n1") + F.col("n0")).alias("n_activations"),
        ratio3(F.col("n1"), F.col("n1") + F.col("n0")).alias("ratio"),
        *([F.col("best.steps").alias("steps")] if steps else []),
    )


def _holds_for_codes(codes: Column, steps: Column) -> Column:
    """``condition_holds`` on a code vector: first failure false, first absence true."""

    def step(decided: Column, s: Column) -> Column:
        have = F.get(codes, s["attr_id"])
        is_number = (have >= 0) & (have < NOMINAL)
        holds = (
            F.when(s["op"] == "<=", is_number & (have <= s["code"]))
            .when(s["op"] == ">", is_number & (have > s["code"]))
            .when(s["op"] == "==", have == s["code"])
            .otherwise(have != s["code"])
        )
        return F.coalesce(decided, F.when(have == MISSING, F.lit(True)).when(~holds, F.lit(False)))

    return F.coalesce(F.aggregate(steps, F.lit(None).cast("boolean"), step), F.lit(True))


def _cells_under_rules(cell_rows: DataFrame, rules: DataFrame) -> DataFrame:
    both = with_negations(cell_rows, {"n1": F.col("n0"), "n0": F.col("n1")})
    joined = both.join(rules.select(*CONSTRAINT, "condition", "steps"), [*CONSTRAINT])
    return joined.withColumn("_holds", _holds_for_codes(F.col("codes"), F.col("steps")))


def rule_counts(cell_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Activations that satisfy their constraint's current rule, recounted over all cells.

    The rules test bins, so the cells answer exactly; no activation is read again.
    """
    when_held = F.when(F.col("_holds"), F.col("n1"))
    all_held = F.when(F.col("_holds"), F.col("n1") + F.col("n0"))
    return (
        _cells_under_rules(cell_rows, rules)
        .groupBy(*CONSTRAINT, "condition")
        .agg(
            F.coalesce(F.sum(all_held), F.lit(0)).alias("n_activations_data"),
            F.coalesce(F.sum(when_held), F.lit(0)).alias("n_fulfilled_data"),
        )
    )


def confusion(cell_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """tp, fp, fn per constraint with the rule as the predictor of fulfilment."""
    held = F.col("_holds")

    def total(condition, column):
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    return (
        _cells_under_rules(cell_rows, rules)
        .groupBy(*CONSTRAINT)
        .agg(total(held, "n1").alias("tp"), total(held, "n0").alias("fp"), total(~held, "n1").alias("fn"))
    )


def learn_conditions(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    tests: Sequence[AttributeTests] | None = None,
    templates: Sequence[str] = tuple(TEMPLATES),
    settings: Settings = Settings(),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """From log and candidate pairs to one readable condition per constraint."""
    tests = attribute_tests(log, settings) if tests is None else tests
    counted = freeze(cells(log, pairs, tests, templates, complete=complete, hot_rows=hot_rows), "cells")
    return best_rules(grow(counted, tests, settings), settings)
