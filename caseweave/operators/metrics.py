"""Fulfilment ratios: per constraint, over time, and under a data condition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseweave.functions.conditions import condition_text, typed_condition_holds, typed_conjuncts
from caseweave.functions.scalars import constraint_text, ratio3, typed_attributes
from caseweave.operators.templates import (
    FULFILLED,
    PENDING,
    TEMPLATES,
    VIOLATED,
    constraint_counts,
    constraint_table,
    negate_verdicts,
    verdicts,
    with_negations,
)
from caseweave.plans.ordered import (
    BROADCAST_STRETCHES,
    HOT_GROUP_ROWS,
    TASK_ROWS,
    running_sums,
    stretch_of,
    tasks_for,
    timed_sums,
)
from caseweave.session import freeze

CONSTRAINT = ("template", "first", "second")

#: The order in which verdicts become known.
RESOLUTION = ("resolved_ts", "resolved_seq", "ts", "seq", "case_id")

#: Stretches of time in which ``majority_f1`` counts activations: few enough for a task's counts to
#: be far fewer than its activations.
MAJORITY_STRETCHES = 512

#: Up to this many conditions per activity, activations are counted per combination of outcomes.
COUNTED_CONDITIONS = 8

#: Up to this many times at which rules come into force, activations are counted between them.
COUNTED_TIMES = 64

#: Rule tables up to this many rows may be broadcast.
BROADCAST_RULES = 250_000


def fulfilment_ratios(counts: DataFrame, *, include_pending: bool = False) -> DataFrame:
    """Counts with their ratio. By default over the decided activations."""
    whole = F.col("n_activations") + (F.col("n_pending") if include_pending else F.lit(0))
    return counts.withColumn("ratio", ratio3(F.col("n_fulfilled"), whole))


def constraint_ratios(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    negations: bool = False,
    include_pending: bool = False,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Ratio per constraint; a negation has the violations as fulfilments and ratio ``1 - r``."""
    counts = constraint_counts(log, pairs, templates, complete=complete, hot_rows=hot_rows)
    ratios = fulfilment_ratios(counts, include_pending=include_pending)
    if negations:
        ratios = with_negations(
            ratios,
            {
                "n_fulfilled": F.col("n_activations") - F.col("n_fulfilled"),
                "ratio": F.round(1 - F.col("ratio"), 3),
            },
        )
    return ratios


def running_ratios(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Each decided activation with count and ratio of its constraint at that moment.

    There are few constraints and many activations, so a window per constraint would be a few
    giant tasks; the windows are those of stretches of time instead.
    """
    decided = _timed_activations(log, pairs, templates, complete, hot_rows)
    running = timed_sums(
        decided,
        ["constraint_id"],
        [*RESOLUTION],
        {"n_activations": F.lit(1), "n_fulfilled": F.col("_hit").cast("long")},
        log.select("ts"),
        hot_rows,
    )
    return _named(running, pairs).select(
        *CONSTRAINT,
        F.when(F.col("_hit"), FULFILLED).otherwise(VIOLATED).alias("verdict"),
        "resolved_ts", "resolved_seq", "case_id", "pos", "ts", "seq", "n_activations", "n_fulfilled",
        ratio3(F.col("n_fulfilled"), F.col("n_activations")).alias("ratio"),
    )


def _timed_activations(log, pairs, templates, complete, hot_rows) -> DataFrame:
    """Decided activations by ``constraint_id``, with the event that decided them; ``_hit`` is
    true if fulfilled."""
    # An event becomes many activations, so tasks of a good size for events are too large for these.
    names = {name for pair in pairs for name in pair}
    expected = log.count() * len(templates) * len(pairs) // max(len(names), 1)
    dealt = log.repartition(tasks_for(log, expected), "case_id") if expected > TASK_ROWS else log
    decided = verdicts(
        dealt, pairs, templates, times=True, numbered=True, complete=complete, hot_rows=hot_rows
    ).filter(F.col("verdict") != PENDING)
    return decided.withColumn("_hit", F.col("verdict") == FULFILLED).drop("verdict")


def _named(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``constraint_id`` replaced by template, first and second."""
    names = constraint_table(rows.sparkSession, pairs)
    return rows.join(F.broadcast(names) if len(pairs) * len(TEMPLATES) <= BROADCAST_RULES else names, "constraint_id").drop("constraint_id")


def _match_rules(rows: DataFrame, rules: DataFrame, keys: Sequence[str], max_rules: int | None) -> DataFrame:
    """Equi-join activations with rules. The rules are broadcast only if ``max_rules`` (the
    caller's bound on their number) allows; otherwise Spark chooses, with AQE splitting skew."""
    small = max_rules is not None and max_rules <= BROADCAST_RULES
    return rows.join(F.broadcast(rules) if small else rules, [*keys])


def data_aware_ratios(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    rules: DataFrame,
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    group: Sequence[str] = (),
    max_rules: int | None = None,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per constraint and rule: counts and ratios over all decided activations, and over those
    that satisfy the rule's condition.

    ``rules`` has ``template, first, second, conjuncts`` (plus any labels); a constraint may
    have several, each is counted by itself. Negated templates may be used in rules.
    """
    labels = [c for c in rules.columns if c not in (*CONSTRAINT, "conjuncts")]
    small = max_rules is not None and max_rules <= BROADCAST_RULES
    ruled = _placed_rules(rules)
    conditions = ruled.groupBy("activity").agg(F.array_sort(F.collect_set("conjuncts")).alias("_conditions"))
    ruled = ruled.join(conditions, "activity").select(
        *CONSTRAINT, "_plain", "_negated", *labels,
        condition_text(F.col("conjuncts")).alias("condition"),
        (F.array_position("_conditions", F.col("conjuncts")) - 1).cast("int").alias("_slot"),
    )

    # Each event is tested once per condition any of its rules has, whatever the number of
    # constraints; only the outcomes travel on, not the attributes.
    parsed = conditions.select("activity", F.transform("_conditions", typed_conjuncts).alias("_conditions"))
    typed = log.withColumn("attrs", typed_attributes(F.col("attrs")))
    tested = typed.join(F.broadcast(parsed) if small else parsed, "activity", "left").withColumn(
        "_held", F.transform("_conditions", lambda c: typed_condition_holds(F.col("attrs"), c))
    )
    # With few conditions per activity there are few outcomes: count per outcome first and
    # meet the rules with the counts. With many, each activation meets its rules in place.
    most = conditions.agg(F.max(F.size("_conditions"))).head()[0] or 0
    if most <= COUNTED_CONDITIONS:
        rows = constraint_counts(
            tested, pairs, templates, group=["_held", *group], complete=complete, hot_rows=hot_rows
        ).select(
            F.col("template").alias("_plain"), "first", "second", "_held", *group,
            F.col("n_activations").alias("_n"), F.col("n_fulfilled").alias("_f"),
        )
    else:
        rows = (
            verdicts(tested, pairs, templates, keep=["_held", *group], complete=complete, hot_rows=hot_rows)
            .filter(F.col("verdict") != PENDING)
            .withColumnRenamed("template", "_plain")
            .withColumn("_n", F.lit(1).cast("long"))
            .withColumn("_f", (F.col("verdict") == FULFILLED).cast("long"))
        )
    matched = _match_rules(rows.filter(F.col("_n") > 0), ruled, ["_plain", "first", "second"], max_rules)
    hits = F.when(F.col("_negated"), F.col("_n") - F.col("_f")).otherwise(F.col("_f"))
    holds = F.get("_held", F.col("_slot"))
    return (
        matched.groupBy(*CONSTRAINT, "condition", *labels, *group)
        .agg(
            F.sum("_n").alias("n_activations"),
            F.sum(hits).alias("n_fulfilled"),
            F.sum(F.when(holds, F.col("_n")).otherwise(0)).alias("n_activations_data"),
            F.sum(F.when(holds, hits).otherwise(0)).alias("n_fulfilled_data"),
        )
        .withColumn("ratio", ratio3(F.col("n_fulfilled"), F.col("n_activations")))
        .withColumn("ratio_data", ratio3(F.col("n_fulfilled_data"), F.col("n_activations_data")))
    )


def _placed_rules(rules: DataFrame) -> DataFrame:
    """Rules with the template they negate (``_plain``) and the activity that activates them."""
    negated = F.col("template").startswith("Not ")
    plain = F.when(negated, F.regexp_replace("template", "^Not ", "")).otherwise(F.col("template"))
    on_first = plain.isin(*[t.name for t in TEMPLATES.values() if t.activation == "first"])
    return (
        rules.withColumn("_negated", negated)
        .withColumn("_plain", plain)
        .withColumn("activity", F.when(on_first, F.col("first")).otherwise(F.col("second")))
    )


def replay_rules(
    activations: DataFrame,
    rules: DataFrame,
    *,
    cumulative: bool = True,
    max_rules: int | None = None,
) -> DataFrame:
    """Apply each rule to the activations decided since the previous rule of its constraint.

    ``activations``: constraint, verdict, attrs, resolved_ts, resolved_seq, case_id, pos;
    ``rules``: constraint, conjuncts, valid_from, rule_seq. ``attrs`` may be typed already,
    which is cheaper on the log than on its activations. An activation waits for the first
    rule with ``valid_from`` at or after its decision. That is an as-of join; numbering the
    gaps between rules makes it an equi-join on (constraint, gap). ``cumulative`` adds up over
    the rules so far.
    """
    keys = list(CONSTRAINT)
    gaps = _gaps_by_lookup if max_rules is not None and max_rules <= BROADCAST_RULES else _gaps_by_timeline
    if not isinstance(activations.schema["attrs"].dataType.valueType, StructType):
        activations = activations.withColumn("attrs", typed_attributes(F.col("attrs")))
    waiting, coming = gaps(activations, rules, keys)
    applied = (
        _match_rules(waiting, coming.withColumn("typed", typed_conjuncts(F.col("conjuncts"))), [*keys, "gap"], max_rules)
        .filter(typed_condition_holds(F.col("attrs"), F.col("typed")))
        .groupBy(*keys, "gap")
        .agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == FULFILLED).alias("hits"))
    )
    return _replayed(coming, applied, cumulative)


def replay_log(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    rules: DataFrame,
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    cumulative: bool = True,
    max_rules: int | None = None,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """``replay_rules`` over the decided activations of a log and those of the negated templates.

    With few conditions per activity and few times at which rules come into force, activations
    are counted per constraint, outcome of the conditions and stretch between those times; the
    rules meet the counts.
    """
    keys = list(CONSTRAINT)
    ruled = _placed_rules(rules)
    conditions = ruled.groupBy("activity").agg(F.array_sort(F.collect_set("conjuncts")).alias("_conditions"))
    most = conditions.agg(F.max(F.size("_conditions"))).head()[0] or 0
    micros = F.unix_micros(F.col("valid_from").cast("timestamp"))
    few = rules.select(micros.alias("t")).filter("t IS NOT NULL").distinct().limit(COUNTED_TIMES + 1).collect()
    if most > COUNTED_CONDITIONS or not 0 < len(few) <= COUNTED_TIMES:
        typed = log.withColumn("attrs", typed_attributes(F.col("attrs")))
        rows = verdicts(typed, pairs, templates, keep=["attrs"], times=True, complete=complete, hot_rows=hot_rows)
        return replay_rules(negate_verdicts(rows.filter(F.col("verdict") != PENDING)), rules, cumulative=cumulative, max_rules=max_rules)
    small = max_rules is not None and max_rules <= BROADCAST_RULES
    times = sorted(r.t for r in few)

    # Outcomes as bits of one number, so that counting needs no more than numbers.
    parsed = conditions.select("activity", F.transform("_conditions", typed_conjuncts).alias("_conditions"))
    typed = log.withColumn("attrs", typed_attributes(F.col("attrs")))
    held = F.lit(0)
    for i in range(most):
        one = F.get("_conditions", F.lit(i))
        held = held + F.when(one.isNotNull() & typed_condition_holds(F.col("attrs"), one), 1 << i).otherwise(0)
    tested = typed.join(F.broadcast(parsed) if small else parsed, "activity", "left").withColumn("_held", held)
    decided = verdicts(
        tested, pairs, templates, keep=["_held"], times=True, numbered=True, complete=complete, hot_rows=hot_rows
    ).filter(F.col("verdict") != PENDING)
    at, stretch = F.unix_micros("resolved_ts"), F.lit(0)
    for t in times:
        stretch = stretch + F.when(at > t, 1).otherwise(0)
    counted = decided.groupBy("constraint_id", stretch.alias("_stretch"), "_held").agg(
        F.count("*").alias("_n"), F.count_if(F.col("verdict") == FULFILLED).alias("_f")
    )
    names = constraint_table(log.sparkSession, pairs).withColumnRenamed("template", "_plain")
    counted = counted.join(F.broadcast(names) if len(pairs) * len(TEMPLATES) <= BROADCAST_RULES else names, "constraint_id").drop("constraint_id")

    # A rule takes the stretches since the rule before it.
    window = Window.partitionBy(*keys).orderBy("valid_from", "rule_seq")
    place = F.array_position(F.array(*[F.lit(t).cast("long") for t in times]), micros) - 1
    coming = rules.withColumn("gap", (F.row_number().over(window) - 1).cast("long"))
    placed = ruled.withColumn("gap", (F.row_number().over(window) - 1).cast("long")).withColumn("_place", place)
    placed = placed.withColumn("_earlier", F.coalesce(F.lag("_place").over(window), F.lit(-1))).join(conditions, "activity").select(
        *keys, "gap", "_plain", "_negated",
        (F.array_position("_conditions", F.col("conjuncts")) - 1).cast("int").alias("_slot"),
        F.explode(F.when(F.col("_place") > F.col("_earlier"), F.sequence(F.col("_earlier") + 1, F.col("_place")))).alias("_stretch"),
    )
    hits = F.when(F.col("_negated"), F.col("_n") - F.col("_f")).otherwise(F.col("_f"))
    applied = (
        counted.join(F.broadcast(placed) if small else placed, ["_plain", "first", "second", "_stretch"])
        .filter(F.expr("_held & shiftleft(1, _slot)") != 0)
        .groupBy(*keys, "gap")
        .agg(F.sum("_n").alias("n"), F.sum(hits).alias("hits"))
    )
    return _replayed(coming, applied, cumulative)


def _replayed(coming: DataFrame, applied: DataFrame, cumulative: bool) -> DataFrame:
    keys = list(CONSTRAINT)
    out = coming.join(applied, [*keys, "gap"], "left").fillna(0, ["n", "hits"])
    if cumulative:
        out = running_sums(
            out, keys, ["gap"], {"n_activations_data": F.col("n"), "n_fulfilled_data": F.col("hits")}
        )
    else:
        out = out.withColumn("n_activations_data", F.col("n")).withColumn("n_fulfilled_data", F.col("hits"))
    return out.select(
        *keys,
        condition_text(F.col("conjuncts")).alias("condition"),
        "valid_from",
        "rule_seq",
        "n_activations_data",
        "n_fulfilled_data",
        ratio3(F.col("n_fulfilled_data"), F.col("n_activations_data")).alias("ratio_data"),
    )


def _places_before(times: Column, at: Column) -> Column:
    """How many of the ascending ``times`` lie before ``at``, by halving."""
    def halve(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
        earlier = F.get(times, middle) < at
        open_ = range_["low"] < range_["high"]
        return F.struct(
            F.when(open_ & earlier, middle + 1).otherwise(range_["low"]).alias("low"),
            F.when(open_ & ~earlier, middle).otherwise(range_["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(times) + 1.0)).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), F.size(times).alias("high"))
    return F.aggregate(steps, whole, halve, lambda range_: range_["low"])


def _gaps_by_lookup(activations, rules, keys):
    """``gap`` = number of earlier rules of the constraint, looked up by halving in a broadcast
    list of their times. Needs rule tables that are known to be small; activations are not
    shuffled."""
    window = Window.partitionBy(*keys).orderBy("valid_from", "rule_seq")
    coming = rules.withColumn("gap", (F.row_number().over(window) - 1).cast("long"))
    times = rules.groupBy(*keys).agg(F.array_sort(F.collect_list("valid_from")).alias("_times"))
    earlier = _places_before(F.col("_times"), F.col("resolved_ts")).cast("long")
    waiting = activations.join(F.broadcast(times), keys).select(*keys, earlier.alias("gap"), "verdict", "attrs")
    return waiting, coming


def _gaps_by_timeline(activations, rules, keys):
    """The same from one ordered timeline of activations and rules, for any number of either."""
    waiting = activations.select(
        *keys, "verdict", "attrs", "case_id", "pos",
        F.col("resolved_ts").alias("at"), F.col("resolved_seq").alias("at_seq"), F.lit(0).alias("is_rule"),
    )
    coming = rules.select(
        *keys, "conjuncts", F.col("valid_from").alias("at"), F.col("rule_seq").alias("at_seq"), F.lit(1).alias("is_rule"),
    )
    timeline = waiting.unionByName(coming, allowMissingColumns=True)
    numbered = running_sums(
        timeline, keys, ["at", "is_rule", "at_seq", "case_id", "pos"], {"gap": F.col("is_rule")}
    )
    return (
        numbered.filter(F.col("is_rule") == 0).select(*keys, "gap", "verdict", "attrs"),
        numbered.filter(F.col("is_rule") == 1).select(
            *keys, (F.col("gap") - 1).alias("gap"), "conjuncts",
            F.col("at").alias("valid_from"), F.col("at_seq").alias("rule_seq"),
        ),
    )


def result_records(df: DataFrame) -> DataFrame:
    """The external record of a data-aware result; the last ratio is a text with 3 places."""
    return df.select(
        constraint_text().alias("Constraint"),
        F.col("condition").alias("Data Condition"),
        F.col("n_activations").alias("# Activations No Data"),
        F.col("ratio").alias("Fulfilment Ratio No Data"),
        F.col("n_activations_data").alias("# Activations Data"),
        F.format_string("%.3f", "ratio_data").alias("Fulfilment Ratio Data"),
    )


def f1_scores(scored: DataFrame, keys: Sequence[str], label: Column, predicted: Column) -> DataFrame:
    """Confusion counts and F1 per key, from a true label and a prediction (both boolean)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        scored.groupBy(*keys)
        .agg(
            F.count_if(label & predicted).alias("tp"),
            F.count_if(~label & predicted).alias("fp"),
            F.count_if(label & ~predicted).alias("fn"),
        )
        .withColumn("f1", ratio3(2 * tp, 2 * tp + fp + fn))
    )


def condition_f1(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    predicted: Mapping[str, Column],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """``f1_scores`` of predictions (label -> boolean column of the log), for all constraints and negations.

    An event is judged once per prediction; activations are counted per outcome of all of them."""
    labels = list(predicted)
    tested = log.withColumn("_held", F.array(*[predicted[label] for label in labels]))
    counted = constraint_counts(tested, pairs, templates, group=["_held"], complete=complete, hot_rows=hot_rows).filter("n_activations > 0")
    both = with_negations(counted, {"n_fulfilled": F.col("n_activations") - F.col("n_fulfilled")})
    parts = F.array(*[F.struct(F.lit(label).alias("label"), F.get("_held", F.lit(i)).alias("_says")) for i, label in enumerate(labels)])
    rows = both.select(*CONSTRAINT, "n_activations", "n_fulfilled", F.inline(parts))
    hits, says = F.col("n_fulfilled"), F.col("_says")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        rows.groupBy(*CONSTRAINT, "label")
        .agg(
            F.sum(F.when(says, hits).otherwise(0)).alias("tp"),
            F.sum(F.when(says, F.col("n_activations") - hits).otherwise(0)).alias("fp"),
            F.sum(F.when(~says, hits).otherwise(0)).alias("fn"),
        )
        .withColumn("f1", ratio3(2 * tp, 2 * tp + fp + fn))
    )


def majority_f1(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Test-then-train F1 of the rule-less model: predict the majority of the activations
    decided before (violated while there is none or a tie), then count the new one in.

    Activations are counted per constraint and stretch of time. Most stretches begin with a
    majority that their own activations cannot overturn, so their counts are all that is needed.
    Only the activations of the others are put in order.
    """
    settled, contested = _by_majority(log, pairs, templates, complete, hot_rows)
    hit, says = F.col("_hit"), F.col("_says")
    judged = contested.groupBy("constraint_id").agg(
        F.count_if(hit & says).alias("tp"), F.count_if(~hit & says).alias("fp"), F.count_if(hit & ~says).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = settled.unionByName(judged).groupBy("constraint_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return _named(scores, pairs).select(*CONSTRAINT, tp, fp, fn, ratio3(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_majority(log, pairs, templates, complete, hot_rows) -> tuple[DataFrame, DataFrame]:
    """Confusion counts of the stretches with one prediction throughout, and the activations of
    all others with the prediction made for each (``_says``)."""
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    place = stretch_of(log.select("ts"), "resolved_ts", MAJORITY_STRETCHES)
    rows = _timed_activations(log, pairs, templates, complete, hot_rows).withColumn("_stretch", F.lit(-1) if place is None else place)
    here = ["constraint_id", "_stretch"]
    n, f = F.col("_n"), F.col("_f")
    totals = freeze(rows.groupBy(*here).agg(F.count("*").alias("_n"), F.count_if("_hit").alias("_f")), "stretches")
    # By how many the fulfilled ones lead when a stretch begins.
    earlier = Window.partitionBy("constraint_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = totals.withColumn("_lead", F.coalesce(F.sum(2 * f - n).over(earlier), F.lit(0)))
    yes, no = F.col("_lead") > n - f, F.col("_lead") + f <= 0
    settled = stretches.filter(yes | no).select(
        "constraint_id",
        F.when(yes, f).otherwise(0).alias("tp"),
        F.when(yes, n - f).otherwise(0).alias("fp"),
        F.when(yes, 0).otherwise(f).alias("fn"),
    )
    contested = stretches.filter(~(yes | no))
    most, found, size = contested.agg(F.max("_n"), F.count("*"), F.sum("_n")).head()
    leads = contested.select(*here, "_lead")
    rows = rows.join(F.broadcast(leads) if found <= BROADCAST_STRETCHES else leads, here)
    step = F.when(F.col("_hit"), 1).otherwise(-1)
    if (most or 0) > limit:
        rows = running_sums(rows, here, RESOLUTION, {"_change": step})
    else:
        if size and size > TASK_ROWS:
            rows = rows.repartition(tasks_for(rows, size), *here)
        inside = Window.partitionBy(*here).orderBy(*RESOLUTION).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_change", F.sum(step).over(inside))
    return settled, rows.select("constraint_id", "_hit", (F.col("_lead") + F.col("_change") - step > 0).alias("_says"))
