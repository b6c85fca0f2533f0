"""The queries of the driver contract: each reads whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.conditions import (
    CONJUNCTS,
    condition_text,
    typed_condition_holds,
    typed_conjuncts,
)
from caseweave.functions.scalars import clock_text, constraint_text, epoch_millis, json_record, text_of, typed_attributes
from caseweave.operators import candidates, drift, eventlog, learning, metrics, model, report, sampling, statistics, templates, trees
from caseweave.plans.ordered import keyed_scan, number_rows
from caseweave.session import freeze, scratch_path
from caseweave.sources import results
from caseweave.sources.tables import conversations_log, events_as_log, events_log, orders_log, table_stream
from caseweave.streaming.pipeline import Discovery
from caseweave.streaming.sampling import LossySampling
from caseweave.streaming.statistics import StreamStatistics

EVENTS_SUPPORT = 0.4
ORDERS_SUPPORT = 0.745

# The conditions tried on orders: (label, conjuncts).
ORDER_CONDITIONS = (
    ("high_price", [("o_totalprice", ">", "250000")]),
    ("open_low", [("o_orderstatus", "==", "O"), ("o_totalprice", "<=", "150000")]),
    ("absent_last", [("o_totalprice", ">", "400000"), ("channel", "==", "web")]),
)
#: Years with orders, and those in which rules come into force.
ORDER_YEARS = tuple(range(1995, 2003))
REPLAY_YEARS = tuple(range(1998, 2003))
#: Loose enough that some constraints drift over eight years.
DRIFT_DELTA = 0.2
ORDER_CUTS = (100000.0, 200000.0, 300000.0, 400000.0)


def _conjuncts(tests) -> F.Column:
    return F.array(
        *[F.struct(F.lit(a).alias("attr"), F.lit(o).alias("op"), F.lit(v).alias("value")) for a, o, v in tests]
    ).cast(CONJUNCTS)


def _plain_time(name: str = "ts"):
    return F.col(name).cast("timestamp_ntz").alias(name)


def _event_pairs(spark, sf):
    return candidates.pair_list(candidates.candidate_pairs(events_log(spark, sf), EVENTS_SUPPORT))


def _order_pairs(spark, sf, support=ORDERS_SUPPORT):
    return candidates.pair_list(candidates.candidate_pairs(orders_log(spark, sf), support))


def _order_rules(spark, sf, pairs) -> DataFrame:
    """Every condition for every candidate pair, template and negation."""
    bodies = F.array(
        *[F.struct(F.lit(label).alias("label"), _conjuncts(tests).alias("conjuncts")) for label, tests in ORDER_CONDITIONS]
    )
    names = [n for t in templates.TEMPLATES for n in (t, f"Not {t}")]
    base = spark.createDataFrame(pairs, "first string, second string")
    return (
        base.withColumn("template", F.explode(F.array(*[F.lit(n) for n in names])))
        .select("template", "first", "second", F.inline(bodies))
    )


# --- the log and its statistics ---------------------------------------------------------


def log_metrics(spark, sf):
    m = statistics.log_metrics(events_log(spark, sf))
    return m.select("Event_counter", _plain_time("Log_start_timestamp"), _plain_time("Log_end_timestamp"), "Counter_trace_id")


def running_log_metrics(spark, sf):
    m = statistics.running_log_metrics(events_log(spark, sf))
    return m.select("Event_counter", _plain_time("Log_start_timestamp"), _plain_time("Log_end_timestamp"), "Counter_trace_id")


def activity_frequency(spark, sf):
    return statistics.activity_frequency(events_log(spark, sf))


def traces_per_activity(spark, sf):
    return statistics.traces_per_activity(orders_log(spark, sf))


def activity_stats_union(spark, sf):
    feed = statistics.statistics_feed(orders_log(spark, sf))
    return feed.withColumn("kind", statistics_kind()).select(
        "kind", "Event_counter", "Counter_trace_id",
        _plain_time("Log_start_timestamp"), _plain_time("Log_end_timestamp"),
        "Activity", "Frequency", "Trace_count",
    )


def statistics_kind():
    return F.when(F.col("Event_counter").isNotNull(), "log_metrics").otherwise("activity")


def ranked_activities(spark, sf):
    return statistics.by_frequency(statistics.activity_statistics(orders_log(spark, sf)))


def end_tagging(spark, sf):
    return eventlog.tag_trace_ends(orders_log(spark, sf)).select("case_id", "seq", "activity", "is_end")


def time_sorted_log(spark, sf):
    return eventlog.time_sorted(orders_log(spark, sf)).select("case_id", "activity", _plain_time(), "seq")


def trace_history(spark, sf):
    history = eventlog.trace_history(events_log(spark, sf), chunk=50)
    return history.select("case_id", "chunk", "start_pos", F.array_join("activities", ">").alias("activities"))


def neighbours(spark, sf):
    return eventlog.neighbours(events_log(spark, sf)).select(
        "case_id", "pos", "activity", "previous_activity", "next_activity"
    )


def typed_attribute_values(spark, sf):
    log = orders_log(spark, sf).withColumn("typed", typed_attributes(F.col("attrs")))
    return log.select("seq", F.explode("typed").alias("attr", "v")).select(
        "seq", "attr", "v.num", "v.bool", text_of(F.col("v")).alias("str")
    )


def wire_events(spark, sf):
    wire = eventlog.to_wire(events_log(spark, sf))
    return wire.select(
        "case_concept_name", "concept_name", F.substring("time_timestamp", 1, 19).alias("time_text"),
        F.col("eventAttributes")["k"].alias("k"), F.col("eventAttributes")["is_end_event"].alias("is_end_event"),
    )


def wire_round_trip(spark, sf):
    log, _ = eventlog.from_wire(eventlog.to_wire(events_log(spark, sf)))
    return log.select(
        "case_id", "activity", epoch_millis(F.col("ts")).alias("millis"), F.unix_micros("ts").alias("micros"), "is_end",
        F.col("attrs")["k"].alias("k"),
    )


def clock_times(spark, sf):
    return events_log(spark, sf).select("seq", clock_text(F.col("ts")).alias("clock"))


def json_records(spark, sf):
    return events_log(spark, sf).select("seq", json_record("case_id", "activity", "seq").alias("record"))


# --- sampling and candidates ------------------------------------------------------------


def lossy_sampled_events(spark, sf):
    kept = sampling.lossy_sampled(orders_log(spark, sf))
    return kept.select("case_id", "activity", "seq", "n", "bucket")


def lossy_sampled_frequency(spark, sf):
    return statistics.activity_statistics(sampling.sample(events_log(spark, sf), "lossy"))


def frequent_activities(spark, sf):
    return candidates.frequent_activities(conversations_log(spark, sf), 0.4)


def joint_support(spark, sf):
    log = orders_log(spark, sf)
    names = [r.activity for r in candidates.activity_support(log).collect()]
    return candidates.joint_support(log, sorted(names))


def candidate_pairs(spark, sf):
    return candidates.candidate_pairs(orders_log(spark, sf), ORDERS_SUPPORT)


def candidates_as_of(spark, sf):
    """Which pairs have been candidates on the way, and since which event."""
    return candidates.candidates_as_of(orders_log(spark, sf), ORDERS_SUPPORT)


def candidate_events(spark, sf):
    log = orders_log(spark, sf)
    context = templates.pair_context(log, _order_pairs(spark, sf), complete=True)
    return context.select(
        "case_id", "pos", "activity", "other",
        F.col("pair_as_first").isNotNull().alias("as_first"), F.col("pair_as_second").isNotNull().alias("as_second"),
    )


def template_expansion(spark, sf):
    expanded = templates.expand_templates(orders_log(spark, sf))
    return expanded.groupBy("template", "activity").agg(F.count("*").alias("n"))


# --- verdicts and ratios ----------------------------------------------------------------


def _template_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf):
        log = events_log(spark, sf)
        return templates.verdicts(log, _event_pairs(spark, sf), [name], complete=True).drop("template")

    return query


def negated_constraints(spark, sf):
    rows = templates.verdicts(orders_log(spark, sf), _order_pairs(spark, sf), complete=True)
    return templates.negate_verdicts(rows).groupBy("template", "first", "second", "verdict").agg(F.count("*").alias("n"))


def constraint_ratios(spark, sf):
    ratios = metrics.constraint_ratios(events_log(spark, sf), _event_pairs(spark, sf), negations=True, complete=True)
    return ratios.select(
        constraint_text().alias("constraint"), "n_activations", "n_fulfilled", "n_pending", "ratio"
    )


def sampled_constraint_ratios(spark, sf):
    log = sampling.sample(events_log(spark, sf), "lossy")
    ratios = metrics.constraint_ratios(log, _event_pairs(spark, sf), complete=True)
    return ratios.select("template", "first", "second", "n_activations", "n_fulfilled", "ratio")


def running_ratios(spark, sf):
    rows = metrics.running_ratios(orders_log(spark, sf), _order_pairs(spark, sf), complete=True)
    return rows.select(
        "template", "first", "second", "case_id", "pos", "verdict", "n_activations", "n_fulfilled", "ratio"
    )


def _open_orders(spark, sf):
    """A customer's trace is closed if the last order lies before June 2000."""
    tagged = eventlog.tag_trace_ends(orders_log(spark, sf))
    return tagged.withColumn("is_end", F.col("is_end") & (F.col("ts") < F.to_timestamp(F.lit("2000-06-01"))))


def open_traces_pending(spark, sf):
    ratios = metrics.constraint_ratios(_open_orders(spark, sf), _order_pairs(spark, sf), include_pending=True)
    return ratios.select("template", "first", "second", "n_activations", "n_fulfilled", "n_pending", "ratio")


# --- conditions -------------------------------------------------------------------------


def condition_filter(spark, sf):
    """Every condition on every order; attributes are parsed once per order."""
    log = orders_log(spark, sf).select("seq", typed_attributes(F.col("attrs")).alias("attrs"))
    parts = []
    for label, tests in ORDER_CONDITIONS:
        conjuncts = _conjuncts(tests)
        parts.append(
            F.struct(
                F.lit(label).alias("label"),
                condition_text(conjuncts).alias("condition"),
                typed_condition_holds(F.col("attrs"), typed_conjuncts(conjuncts)).alias("holds"),
            )
        )
    return log.select("seq", F.inline(F.array(*parts)))


def data_aware_ratios(spark, sf):
    pairs = _order_pairs(spark, sf)
    rules = _order_rules(spark, sf, pairs)
    return metrics.data_aware_ratios(
        orders_log(spark, sf), pairs, rules, max_rules=len(pairs) * 14 * len(ORDER_CONDITIONS), complete=True
    )


def _replay_inputs(spark, sf):
    """The candidate pairs, and for each constraint and negation a sequence of rules with
    changing conditions: one of them comes into force every four months."""
    pairs = _order_pairs(spark, sf)
    years = F.array(*[F.lit(y) for y in REPLAY_YEARS])
    month = F.create_map(*[F.lit(x) for k, (label, _) in enumerate(ORDER_CONDITIONS) for x in (label, 1 + 4 * k)])
    rules = (
        _order_rules(spark, sf, pairs)
        .select("template", "first", "second", "conjuncts", month[F.col("label")].alias("m"), F.explode(years).alias("y"))
        .withColumn("valid_from", F.make_timestamp("y", "m", F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
        .withColumn("rule_seq", (F.col("y") * 12 + F.col("m")).cast("long"))
        .drop("y", "m")
    )
    return pairs, rules, len(pairs) * 14 * len(ORDER_CONDITIONS) * len(REPLAY_YEARS)


def rule_replay(spark, sf):
    pairs, rules, bound = _replay_inputs(spark, sf)
    out = metrics.replay_log(orders_log(spark, sf), pairs, rules, max_rules=bound, complete=True)
    return out.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))


def rule_replay_separate(spark, sf):
    pairs, rules, bound = _replay_inputs(spark, sf)
    out = metrics.replay_log(orders_log(spark, sf), pairs, rules, cumulative=False, max_rules=bound, complete=True)
    return out.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))


def majority_f1(spark, sf):
    """Test-then-train F1 of the plainest model, the majority so far: what rules have to beat."""
    return metrics.majority_f1(orders_log(spark, sf), _order_pairs(spark, sf), complete=True)


def prequential_f1(spark, sf):
    """Test-then-train F1 of the learnt trees: each year predicted by the trees of the years before."""
    return trees.prequential_scores(_placed_orders(spark, sf), _order_pairs(spark, sf), F.year("ts"), ORDER_YEARS, complete=True)


def condition_f1(spark, sf):
    """Fulfilment predicted by a condition alone, for every condition, template and negation."""
    holds = {label: typed_condition_holds(F.col("attrs"), typed_conjuncts(_conjuncts(tests))) for label, tests in ORDER_CONDITIONS}
    log = orders_log(spark, sf).withColumn("attrs", typed_attributes(F.col("attrs")))
    return metrics.condition_f1(log, _order_pairs(spark, sf), holds, complete=True)


def _order_tests():
    return [
        learning.AttributeTests("o_orderstatus", values=("F", "O", "P")),
        learning.AttributeTests("o_totalprice", cuts=ORDER_CUTS),
    ]


def _placed_orders(spark, sf):
    """Orders with their place among the orders of the customer, which decides much of what follows."""
    placed = keyed_scan(orders_log(spark, sf), ["case_id"], eventlog.ORDER, position="_nth").withColumn(
        "attrs", F.map_concat("attrs", F.create_map(F.lit("nth_order"), F.col("_nth").cast("string")))
    )
    return freeze(placed.drop("_nth"), "placed")  # read for the cut points and for the scan


def leaf_class_totals(spark, sf):
    """Fulfilled and violated activations of every leaf of every constraint's tree."""
    leaves = trees.learn(_placed_orders(spark, sf), _order_pairs(spark, sf), complete=True)
    return leaves.select("template", "first", "second", "node", condition_text(F.col("steps")).alias("rule"), "n1", "n0")


def split_statistics(spark, sf):
    tests = _order_tests()
    counted = learning.cells(orders_log(spark, sf), _order_pairs(spark, sf), tests, complete=True)
    stats = learning.split_statistics(counted, ["template", "first", "second"])
    words = learning.test_table(counted, tests)
    return stats.join(F.broadcast(words), ["attr_id", "code"]).select(
        "template", "first", "second", F.concat_ws(" ", "attr", "op", "value").alias("test"),
        "left1", "left0", "right1", "right0", F.round("gain", 6).alias("gain"),
    )


def learned_conditions(spark, sf):
    """Conditions on price, status and place of an order, learnt end to end."""
    leaves = freeze(trees.learn(_placed_orders(spark, sf), _order_pairs(spark, sf), complete=True), "leaves")
    return learning.best_rules(leaves).select(
        constraint_text().alias("constraint"), "condition", "probability", "n_activations", "ratio"
    )


# --- results, model, reports ------------------------------------------------------------


def _records(spark, sf) -> DataFrame:
    """Result records of quarterly runs: one per constraint, condition and quarter."""
    pairs = _order_pairs(spark, sf)
    rules = _order_rules(spark, sf, pairs)
    log = orders_log(spark, sf).withColumn("quarter", (F.year("ts") * 4 + F.quarter("ts")).cast("long"))
    results = metrics.data_aware_ratios(
        log, pairs, rules, group=["quarter"], max_rules=len(pairs) * 14 * len(ORDER_CONDITIONS), complete=True
    )
    label = F.col("label")
    place = F.when(label == "high_price", 0).when(label == "open_low", 1).otherwise(2)
    return results.withColumn("constraint", constraint_text()).withColumn("run", F.col("quarter") * 10 + place)


RECORD = ("constraint", "run", "condition", "n_activations", "ratio", "n_activations_data", "ratio_data")


def _differences(spark, sf) -> DataFrame:
    return report.compared(_records(spark, sf).select(*RECORD))


def result_records(spark, sf):
    return metrics.result_records(_records(spark, sf))


def jsonl_round_trip(spark, sf):
    """Result records appended to JSON lines in two runs, and read back as the reports do."""
    records, folder = result_records(spark, sf), scratch_path(spark, "jsonl")
    results.append_results(records.filter("`# Activations Data` > 0"), folder)
    results.append_results(records.filter("NOT `# Activations Data` > 0"), folder)
    return results.read_results(spark, folder).drop("file", "run")


def count_windows(spark, sf):
    windows = model.count_windows(_records(spark, sf), ["run", "template", "first", "second"])
    return windows.groupBy("window_id").agg(
        F.count("*").alias("n"), F.sum("n_activations").alias("n_activations"), F.min("run").alias("first_run")
    )


def distinct_model(spark, sf):
    kept = model.distinct_model(_records(spark, sf), ["run"])
    return kept.select("template", "first", "second", "condition", "run", "n_activations")


def model_edges(spark, sf):
    return model.model_edges(_records(spark, sf).filter(F.col("ratio_data") > 0.5))


def model_nodes(spark, sf):
    return model.model_nodes(_records(spark, sf).filter(F.col("ratio_data") > 0.5))


def latest_stats(spark, sf):
    running = statistics.running_log_metrics(orders_log(spark, sf))
    newest = statistics.latest(running, ["Event_counter"])
    return newest.select(
        "Event_counter", _plain_time("Log_start_timestamp"), _plain_time("Log_end_timestamp"), "Counter_trace_id"
    )


def upsert_activity(spark, sf):
    """Hourly activity counts; the last hour with events wins per activity."""
    log = events_log(spark, sf)
    feed = log.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.col("activity").alias("Activity")).agg(
        F.count("*").alias("Frequency")
    )
    return statistics.latest(feed, ["hour"], ["Activity"])


def dedupe_results(spark, sf):
    rows = _records(spark, sf).select("constraint", "condition", "n_activations", "ratio", "ratio_data", "run")
    return statistics.deduplicated(rows, ["run"])


def best_run_per_constraint(spark, sf):
    return report.best_run(report.above_ratio(_records(spark, sf).select(*RECORD)))


def diff_summary(spark, sf):
    return report.summary(_differences(spark, sf))


def diff_describe(spark, sf):
    return report.describe(_differences(spark, sf))


def diff_histogram(spark, sf):
    return report.histogram(_differences(spark, sf))


def ranked_diffs(spark, sf):
    return report.ranked(_differences(spark, sf), -1).select("constraint", "run", "diff")


def positive_diffs(spark, sf):
    return report.ranked(_differences(spark, sf), 1).select("constraint", "run", "diff")


def diff_extremes(spark, sf):
    rows = report.with_difference(report.above_ratio(_records(spark, sf).select(*RECORD)))
    return report.extremes(rows.filter(F.col("diff") > 0)).select("constraint", "run", "diff")


# --- streams ----------------------------------------------------------------------------


def streamed_statistics(spark, sf):
    """Activity statistics of the events table read as a stream."""
    raw = table_stream(spark, sf, "events")
    job = StreamStatistics(scratch_path(spark, "statistics"))
    for query in job.start(events_as_log(raw), scratch_path(spark, "checkpoint"), trigger={"availableNow": True}):
        query.awaitTermination()
    return job.activity_statistics(spark)


#: Rows of a file that is delivered, where a part needs more than one.
DELIVERED_ROWS = 250_000


def _delivered(spark, log: DataFrame, parts: int) -> DataFrame:
    """The log as a stream: ``parts`` parts in time order that arrive one by one, each of the same number of files.

    Rows are dealt in turn, so no file of a part stays empty."""
    folder = scratch_path(spark, "delivered")
    numbered = freeze(number_rows(log, ["ts", "seq", "case_id"], "_n"), "numbered")
    size = -(-numbered.count() // parts)
    files = max(1, size // DELIVERED_ROWS)
    for part in range(parts):
        rows = numbered.filter(F.floor((F.col("_n") - 1) / size) == part).drop("_n")
        dealt = rows.coalesce(1) if files == 1 else rows.repartition(files)
        dealt.write.mode("append").parquet(folder)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(folder)


def streamed_lossy_events(spark, sf):
    """Lossy counting over four micro-batches of orders."""
    job = LossySampling(scratch_path(spark, "lossy"))
    stream = _delivered(spark, orders_log(spark, sf), 4)
    job.start(stream, scratch_path(spark, "checkpoint"), trigger={"availableNow": True}).awaitTermination()
    return job.sampled(spark).select("case_id", "activity", "seq", "n", "bucket")


def drift_windows(spark, sf):
    """Adaptive windows over the yearly errors of the learnt trees, per constraint."""
    pairs = _order_pairs(spark, sf)
    rows = trees.Binned(_placed_orders(spark, sf).withColumn("batch", F.year("ts")), pairs, keep=["batch"], complete=True)
    grown = trees.grow(rows, versions=ORDER_YEARS, bound=len(pairs) * 7 * len(ORDER_YEARS))
    wrong = F.when(F.col("predicted"), F.col("n0")).otherwise(F.col("n1"))
    scored = trees.predicted(grown.rows, grown, small=True)
    errors = scored.groupBy("constraint_id", "batch").agg(F.sum(F.col("n1") + F.col("n0")).alias("n"), F.sum(wrong).alias("errors"))
    return trees.named(drift.error_windows(errors, ["constraint_id"], DRIFT_DELTA), pairs)


def streamed_constraint_ratios(spark, sf):
    """Ratios from the stream of tagged conversations: traces assembled in state until the watermark
    has passed their end, then totals.

    Every conversation begins an hour after the one before, so the watermark moves through the
    four files; a sign of life from a day later, a case of its own that no constraint looks
    at, takes it past the last one.
    """
    log = conversations_log(spark, sf)
    log = log.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 3600 * F.col("case_id").cast("long")))
    last = log.agg(F.max("ts").alias("ts")).select(
        F.lit("clock").alias("case_id"), F.lit(None).cast("string").alias("activity"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
        F.lit(0).cast("long").alias("seq"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit(False).alias("is_end"))
    tagged = eventlog.tag_trace_ends(log).select("case_id", "activity", "ts", "seq", "attrs", "is_end").unionByName(last)
    job = Discovery(scratch_path(spark, "discovery"), min_support=0.4, conditions=False)
    job.start(_delivered(spark, tagged, 4), scratch_path(spark, "checkpoint"), trigger={"availableNow": True}, shards=2).awaitTermination()
    return job.ratios(spark).select("template", "first", "second", "n_activations", "n_fulfilled", "ratio")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        log_metrics, running_log_metrics, activity_frequency, traces_per_activity, activity_stats_union,
        ranked_activities, end_tagging, time_sorted_log, trace_history, neighbours,
        wire_events, wire_round_trip, lossy_sampled_events, lossy_sampled_frequency, frequent_activities,
        joint_support, candidate_pairs, candidates_as_of, candidate_events, template_expansion, negated_constraints,
        constraint_ratios, sampled_constraint_ratios, running_ratios, open_traces_pending, condition_filter,
        data_aware_ratios, rule_replay, rule_replay_separate, majority_f1, prequential_f1, condition_f1, leaf_class_totals,
        split_statistics, learned_conditions, result_records, jsonl_round_trip, clock_times, json_records, count_windows, distinct_model, model_edges,
        model_nodes, latest_stats, upsert_activity, dedupe_results, best_run_per_constraint, diff_summary,
        diff_describe, diff_histogram, ranked_diffs, positive_diffs, diff_extremes,
        drift_windows, streamed_statistics, streamed_lossy_events, streamed_constraint_ratios,
    ]
    found = {f.__name__: f for f in named}
    found["typed_attributes"] = typed_attribute_values
    for t in templates.TEMPLATES.values():
        found[t.key] = _template_query(t.name)
    return found
