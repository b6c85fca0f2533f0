"""Continuous discovery: each micro-batch of finished traces updates all result tables.

A trace is released once and whole, so supports, constraint counts and learning cells are sums
over batches. Each batch counts its own traces with the batch operators and adds to the
totals; candidates and conditions are derived from the totals.

What appears late is counted from the beginning all the same: the released traces are kept,
so a pair that becomes a candidate is counted once over all earlier batches, and a pair that
was one is counted in every batch from then on, whether it is above the threshold or not.
The attribute tests are derived anew from all traces when an unknown attribute appears and
each time the number of traces has doubled (twice the work of counting once, in all); then
the cells are counted anew. With ``adaptive`` the conditions come from ``streaming.learning``
instead: trees without a share below which attributes or values are left out, which are
scored on each batch before they learn it and forget what has drifted; they deliver rules,
scores and resets, and no numbered results. ``settle`` does the same at any time: after it the tables equal
those of the batch operators over the same traces.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseweave.functions.scalars import constraint_text, payload, ratio3
from caseweave.operators import candidates, learning, metrics, model, templates
from caseweave.operators.metrics import CONSTRAINT
from caseweave.plans.ordered import number_rows
from caseweave.session import temporary_tables
from caseweave.streaming.assembly import assembled_traces
from caseweave.streaming.learning import StreamedTrees
from caseweave.streaming.tables import Totals, batch_ids, write_batch

@dataclass
class Discovery:
    """``folder`` holds the result tables; it must be visible to all executors."""

    folder: str
    min_support: float = 0.4
    settings: learning.Settings = field(default_factory=learning.Settings)
    window_size: int = 10
    on_results: object = None  # callable(results DataFrame, batch id), e.g. a Kafka sink
    conditions: bool = True  # without: supports, candidates and constraint counts only
    adaptive: bool = False  # instead of conditions from totals: ``trees`` that learn each batch, score it and forget

    def __post_init__(self):
        self.traces_path = f"{self.folder}/traces"
        self.late_path = f"{self.folder}/late"
        self.results_path = f"{self.folder}/results"
        self.tests_path = f"{self.folder}/tests"
        self.known_path = f"{self.folder}/known_pairs"
        self.singles = Totals(f"{self.folder}/singles", ["activity"], {"support": "sum"})
        self.pairs = Totals(f"{self.folder}/pairs", ["first", "second"], {"joint_support": "sum"})
        self.traces = Totals(f"{self.folder}/trace_totals", [], {"n_traces": "sum"})
        # One evaluation of the traces feeds everything: constraint counts are sums of cells.
        self.cells = Totals(
            f"{self.folder}/cells", [*CONSTRAINT, "codes"], {"n1": "sum", "n0": "sum", "n_pending": "sum"}
        )
        self.scores = Totals(f"{self.folder}/scores", CONSTRAINT, {"tp": "sum", "fp": "sum", "fn": "sum"})
        self.trees = StreamedTrees(f"{self.folder}/trees", settings=self.settings)

    def start(self, log: DataFrame, checkpoint: str, *, trigger: dict | None = None, **assembly) -> StreamingQuery:
        """Run on a streaming canonical log. ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = (
            assembled_traces(log, **assembly)
            .writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(self.process)
        )
        return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        released = write_batch(batch, self.traces_path, batch_id)
        late = released.filter("late")
        if late.head(1):
            write_batch(late.groupBy("case_id").agg(F.count("*").alias("n_late")), self.late_path, batch_id)
        log = released.filter(~F.col("late")).drop("late")
        if not log.head(1):
            return

        pairs = self._candidates(log, batch_id)
        earlier = self._traces_before(spark, batch_id)
        known = self._known_pairs(spark, batch_id)
        fresh = sorted(set(pairs) - set(known))
        counted = known + fresh
        self._remember(spark, counted, batch_id)
        if not counted:
            return
        if self.adaptive:
            self.trees.process(log, counted, batch_id)
        if self.adaptive or not self.conditions:  # counts alone are cells without attributes
            delta = learning.cells(log, counted, [])
            if fresh and earlier is not None:
                delta = delta.unionByName(learning.cells(earlier, fresh, []))
            self.cells.add(delta, batch_id)
            return
        before, tests = self._tests(log, earlier, batch_id)
        if before is not None and known:
            self._score(learning.cells(log, known, before), batch_id)
        if tests != before and earlier is not None:
            cells = self.cells.replace(learning.cells(earlier.unionByName(log), counted, tests), batch_id)
        else:
            delta = learning.cells(log, counted, tests)
            if fresh and earlier is not None:
                delta = delta.unionByName(learning.cells(earlier, fresh, tests))
            cells = self.cells.add(delta, batch_id)
        rules = self._learn(cells, tests, batch_id)
        # Pairs that have dropped below the threshold keep their totals but give no results.
        current = spark.createDataFrame(pairs, "first string, second string")
        self._emit(rules.join(current, ["first", "second"], "left_semi"), cells, batch_id)

    def _learn(self, cells: DataFrame, tests: list[learning.AttributeTests], batch_id: int) -> DataFrame:
        leaves = learning.grow(cells, tests, self.settings)
        return write_batch(learning.best_rules(leaves, self.settings, steps=True), f"{self.folder}/rules", batch_id)

    def settle(self, spark: SparkSession) -> None:
        """Derive the tests from all released traces and count and learn anew, as of the last batch."""
        ids = batch_ids(spark, self.traces_path)
        if not ids or self.adaptive or not self.conditions:
            return
        with temporary_tables(spark):
            everything = self._traces_before(spark, ids[-1] + 1)
            pairs = self._known_pairs(spark, ids[-1] + 1)
            if everything is None or not pairs:
                return
            tests = learning.attribute_tests(everything, self.settings)
            self._store_tests(spark, tests, self.traces.latest(spark).head().n_traces, ids[-1])
            cells = self.cells.replace(learning.cells(everything, pairs, tests), ids[-1])
            self._learn(cells, tests, ids[-1])

    def _traces_before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """All traces released in earlier batches."""
        paths = [f"{self.traces_path}/batch_id={b}" for b in batch_ids(spark, self.traces_path) if b < batch_id]
        return spark.read.parquet(*paths).filter(~F.col("late")).drop("late") if paths else None

    def _known_pairs(self, spark: SparkSession, batch_id: int) -> list[tuple[str, str]]:
        ids = [b for b in batch_ids(spark, self.known_path) if b < batch_id]
        if not ids:
            return []
        return sorted((r.first, r.second) for r in spark.read.parquet(f"{self.known_path}/batch_id={ids[-1]}").collect())

    def _remember(self, spark: SparkSession, pairs: list[tuple[str, str]], batch_id: int) -> None:
        write_batch(spark.createDataFrame(pairs, "first string, second string"), self.known_path, batch_id)

    def _candidates(self, log: DataFrame, batch_id: int) -> list[tuple[str, str]]:
        total = self.traces.add(candidates.trace_count(log), batch_id).head().n_traces
        limit = candidates.threshold_of(self.min_support, total)
        singles = self.singles.add(candidates.activity_support(log), batch_id)
        names = sorted(r.activity for r in singles.filter((F.col("support") >= limit) & F.col("activity").isNotNull()).collect())
        # Joint supports are kept for all activities of the batch: a pair may become frequent.
        here = sorted(r.activity for r in log.select("activity").distinct().collect() if r.activity is not None)
        joint = self.pairs.add(candidates.joint_support(log, here), batch_id)
        kept = joint.filter((F.col("joint_support") >= limit) & F.col("first").isin(*names) & F.col("second").isin(*names))
        return candidates.pair_list(kept) if names else []

    def _tests(
        self, log: DataFrame, earlier: DataFrame | None, batch_id: int
    ) -> tuple[list[learning.AttributeTests] | None, list[learning.AttributeTests]]:
        """The attribute tests before this batch, and those to use from it on."""
        spark = log.sparkSession
        now = self.traces.before(spark, batch_id + 1).head().n_traces
        ids = [b for b in batch_ids(spark, self.tests_path) if b < batch_id]
        before = None
        if ids:
            stored = spark.read.parquet(f"{self.tests_path}/batch_id={ids[-1]}").head()
            before = [learning.AttributeTests(n, tuple(c), tuple(v)) for n, c, v in json.loads(stored.tests)]
            seen = set(json.loads(stored.seen))
            # The attribute names of a batch, not its values.
            names = {r.attr for r in log.select(F.explode(F.map_keys(payload(F.col("attrs")))).alias("attr")).distinct().collect()}
            if now < 2 * stored.n_traces and names <= seen:
                return before, before
        tests = learning.attribute_tests(log if earlier is None else earlier.unionByName(log), self.settings)
        self._store_tests(spark, tests, now, batch_id, (seen | names) if ids else None, log)
        return before, tests

    def _store_tests(self, spark, tests, n_traces: int, batch_id: int, seen: set[str] | None = None, log: DataFrame | None = None) -> None:
        if seen is None:
            rows = log if log is not None else self._traces_before(spark, batch_id + 1)
            seen = {r.attr for r in rows.select(F.explode(F.map_keys(payload(F.col("attrs")))).alias("attr")).distinct().collect()}
        text = json.dumps([(t.name, t.cuts, t.values) for t in tests])
        row = [(text, json.dumps(sorted(seen)), n_traces)]
        write_batch(spark.createDataFrame(row, "tests string, seen string, n_traces long"), self.tests_path, batch_id)

    def _score(self, delta: DataFrame, batch_id: int) -> None:
        """Test before training: the rules so far predict the verdicts of this batch."""
        earlier = [b for b in batch_ids(delta.sparkSession, f"{self.folder}/rules") if b < batch_id]
        if not earlier:
            return
        rules = delta.sparkSession.read.parquet(f"{self.folder}/rules/batch_id={earlier[-1]}")
        self.scores.add(learning.confusion(delta, rules), batch_id)

    def _emit(self, rules: DataFrame, cells: DataFrame, batch_id: int) -> None:
        spark = rules.sparkSession
        with_data = learning.rule_counts(cells, rules)
        both = templates.with_negations(learning.cell_totals(cells), {"n_fulfilled": F.col("n_activations") - F.col("n_fulfilled")})
        results = (
            with_data.join(both.select(*CONSTRAINT, "n_activations", "n_fulfilled"), [*CONSTRAINT])
            .withColumn("ratio", ratio3(F.col("n_fulfilled"), F.col("n_activations")))
            .withColumn("ratio_data", ratio3(F.col("n_fulfilled_data"), F.col("n_activations_data")))
            .withColumn("constraint", constraint_text())
        )
        seen = 0
        earlier = [b for b in batch_ids(spark, self.results_path) if b < batch_id]
        for b in reversed(earlier):
            seen = spark.read.parquet(f"{self.results_path}/batch_id={b}").agg(F.max("n")).head()[0] or 0
            if seen:
                break
        numbered = number_rows(results, [*CONSTRAINT]).withColumn("n", F.col("n") + seen)
        numbered = numbered.withColumn("window_id", F.floor((F.col("n") - 1) / self.window_size).cast("long"))
        written = write_batch(numbered, self.results_path, batch_id)
        if self.on_results is not None:
            self.on_results(metrics.result_records(written), batch_id)

    # --- views on the tables ---

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.results_path)

    def rules(self, spark: SparkSession) -> DataFrame:
        """The latest condition of every constraint that has one."""
        if self.adaptive:
            return self.trees.rules(spark)
        ids = batch_ids(spark, f"{self.folder}/rules")
        return spark.read.parquet(f"{self.folder}/rules/batch_id={ids[-1]}")

    def ratios(self, spark: SparkSession) -> DataFrame:
        return metrics.fulfilment_ratios(learning.cell_totals(self.cells.latest(spark)))

    def full_windows(self, spark: SparkSession) -> DataFrame:
        """Distinct model per full window of results."""
        results = self.results(spark)
        full = (
            results.groupBy("window_id").agg(F.count("*").alias("_size")).filter(F.col("_size") == self.window_size)
        )
        return model.distinct_model(results.join(full.select("window_id"), "window_id"), ["n"], ["window_id"])

    def prequential_f1(self, spark: SparkSession) -> DataFrame | None:
        if self.adaptive:
            return self.trees.prequential_f1(spark)
        scores = self.scores.latest(spark)
        if scores is None:
            return None
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return scores.withColumn("f1", ratio3(2 * tp, 2 * tp + fp + fn))
