"""Which activities and pairs occur in enough traces to be worth checking.

Supports are exact over the log at hand. A replay that counts event by event can keep other
pairs on the way, because its threshold moves with the traces seen so far: ``candidates_as_of``
says which pairs those are, and when.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.plans.ordered import number_rows, running_sums
from caseweave.session import freeze

#: Activities handled per pass where each needs a column of its own.
PASS_WIDTH = 64


def trace_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("case_id").alias("n_traces"))


def activity_support(log: DataFrame) -> DataFrame:
    """Traces per activity. Two-level counting, so a frequent activity is no hot key."""
    return log.groupBy("activity").agg(F.count_distinct("case_id").alias("support"))


def supports_with_total(log: DataFrame) -> DataFrame:
    """Traces per activity and, in the ``is_total`` row, of the log: both from one scan."""
    return log.rollup("activity").agg(
        F.count_distinct("case_id").alias("support"), (F.grouping("activity") == 1).alias("is_total")
    )


def support_threshold(log: DataFrame, min_support: float) -> DataFrame:
    """One row: trace count and ``ceil(min_support * n_traces)``."""
    # Rounded first: 0.7 * 10 is a hair above 7 in binary, and ceil would make it 8.
    return trace_count(log).withColumn(
        "threshold", F.ceil(F.round(F.lit(float(min_support)) * F.col("n_traces"), 9)).cast("long")
    )


def threshold_of(min_support: float, n_traces: int) -> int:
    """The same threshold for a trace count already at hand."""
    return math.ceil(round(min_support * n_traces, 9))


def frequent_activities(log: DataFrame, min_support: float) -> DataFrame:
    """Activities at or above the threshold, with the threshold they met."""
    limit = support_threshold(log, min_support).select("threshold").scalar()
    return activity_support(log).withColumn("threshold", limit).filter(F.col("support") >= F.col("threshold"))


def joint_support(log: DataFrame, activities: Sequence[str]) -> DataFrame:
    """(first, second, joint_support): traces holding both, for ordered pairs of ``activities``.

    Each trace becomes one row of presence flags; each activity present in it adds these flags
    to its own row of a matrix. No self-join, and no pair of a trace is ever materialised.
    """
    relevant = log.select("case_id", "activity").filter(F.col("activity").isin(*activities))
    parts = []
    for at in range(0, len(activities), PASS_WIDTH):
        others = list(activities[at : at + PASS_WIDTH])
        flags = [F.max((F.col("activity") == y).cast("long")).alias(f"_has{i}") for i, y in enumerate(others)]
        if len(others) == len(activities):
            here = [F.when(F.col(f"_has{i}") == 1, F.lit(y)) for i, y in enumerate(others)]
            presence = relevant.groupBy("case_id").agg(*flags).withColumn("present", F.array_compact(F.array(*here)))
        else:
            names = F.collect_set("activity").alias("present")  # at most len(activities) of them
            presence = relevant.groupBy("case_id").agg(names, *flags)
        counts = [F.struct(F.lit(y).alias("second"), F.sum(f"_has{i}").alias("joint_support")) for i, y in enumerate(others)]
        matrix = (
            presence.withColumn("first", F.explode("present")).groupBy("first").agg(F.array(*counts).alias("_row"))
        )
        parts.append(matrix.select("first", F.inline("_row")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter((F.col("first") != F.col("second")) & (F.col("joint_support") > 0))


def candidate_pairs(log: DataFrame, min_support: float) -> DataFrame:
    """(first, second, joint_support, threshold) for pairs of frequent activities that are
    themselves frequent together; both orders of each pair."""
    supports = freeze(supports_with_total(log), "supports")
    total = supports.filter("is_total").head()
    threshold = threshold_of(min_support, total.support if total else 0)
    frequent = (
        supports.filter(~F.col("is_total") & F.col("activity").isNotNull() & (F.col("support") >= threshold))
        .select("activity")
        .collect()
    )
    names = sorted(row.activity for row in frequent)  # at most avg. activities per trace / min_support
    if len(names) < 2:
        empty = log.sparkSession.createDataFrame(
            [], "first string, second string, joint_support long, threshold long"
        )
        return empty
    return (
        joint_support(log, names)
        .filter(F.col("joint_support") >= threshold)
        .withColumn("threshold", F.lit(threshold).cast("long"))
    )


def pair_list(pairs: DataFrame) -> list[tuple[str, str]]:
    """Candidate pairs as Python tuples: they shape the plans of the checks that follow."""
    return sorted((row.first, row.second) for row in pairs.select("first", "second").collect())


def candidates_as_of(log: DataFrame, min_support: float) -> DataFrame:
    """Pairs that are candidates at some event of the log, read in time order.

    After each event a pair is a candidate if the traces that hold both of its activities so far are
    at least ``ceil(min_support x traces seen so far)``; both activities then are as frequent.
    Per ordered pair: ``born_n`` (number of the event that first makes it a candidate), and the
    traces, joint support and threshold at that event; ``n_spells`` (how often it becomes one anew),
    ``joint_support`` and ``threshold`` after the last event and ``candidate`` (is it one then).

    The joint support grows with the second activity of a pair in a trace only, and the threshold
    never falls; so a spell begins at such an event, where the joint support meets the threshold
    exactly. These events and the first events of traces are one timeline with running sums.
    """
    numbered = number_rows(log.filter("activity IS NOT NULL").select("case_id", "activity", "ts", "seq"), ["ts", "seq", "case_id"])
    firsts = numbered.groupBy("case_id", "activity").agg(F.min("n").alias("n"))
    # As many entries as a trace has different activities.
    seen = firsts.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("n", "activity"))).alias("seen"))
    none = F.lit(None).cast("string")
    birth = F.array(F.struct(F.element_at("seen", 1)["n"].alias("n"), none.alias("a"), none.alias("b"), F.lit(1).alias("trace")))
    pairs = F.flatten(F.transform("seen", lambda y, i: F.transform(F.slice("seen", 1, i), lambda x: F.struct(
        y["n"].alias("n"), F.least(x["activity"], y["activity"]).alias("a"), F.greatest(x["activity"], y["activity"]).alias("b"), F.lit(0).alias("trace")))))
    timeline = freeze(running_sums(seen.select(F.inline(F.concat(birth, pairs))), [], ["n", "a", "b"], {"traces": F.col("trace")}), "timeline")
    limit = lambda traces: F.ceil(F.round(F.lit(float(min_support)) * traces, 9)).cast("long")
    met = running_sums(timeline.filter("a IS NOT NULL"), ["a", "b"], ["n"], {"joint": F.lit(1)}).withColumn("limit", limit(F.col("traces")))
    begins = F.col("joint") == F.col("limit")
    first = F.min_by(F.when(begins, F.struct("n", "traces", "joint", "limit")), F.when(begins, F.col("n"))).alias("birth")
    total = limit(F.lit(timeline.agg(F.coalesce(F.sum("trace"), F.lit(0))).head()[0]))
    found = met.groupBy("a", "b").agg(first, F.count_if(begins).alias("n_spells"), F.max("joint").alias("joint_support")).filter("n_spells > 0")
    both = F.array(F.struct(F.col("a").alias("first"), F.col("b").alias("second")), F.struct(F.col("b").alias("first"), F.col("a").alias("second")))
    return found.withColumn("threshold", total).select(
        F.inline(both), F.col("birth.n").alias("born_n"), F.col("birth.traces").alias("born_traces"), F.col("birth.joint").alias("born_joint"),
        F.col("birth.limit").alias("born_threshold"), "n_spells", "joint_support", "threshold",
    ).withColumn("candidate", F.col("joint_support") >= F.col("threshold"))
