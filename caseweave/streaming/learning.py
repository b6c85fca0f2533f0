"""Trees that learn from a stream of finished traces, batch by batch, and forget what no longer holds.

Each micro-batch is read once by ``operators.incremental``: tested on the trees so far, then learnt.
What it leaves behind is written as a few small tables to ``<folder>/batch_id=<n>``; the next batch,
or a query that starts again, goes on from there. A batch that is run again reads the state of the
batch before it and replaces its own tables. Only the states of the last two batches are kept.

Numbers are counted in bins. An attribute's bins are the quantiles of the batch it first appears in,
and stay; no attribute or value is too rare to be counted. A pair that becomes a candidate late is
learnt from that batch on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.scalars import ratio3
from caseweave.operators import learning, trees
from caseweave.operators.drift import DELTA
from caseweave.operators.incremental import IncrementalTrees
from caseweave.operators.metrics import BROADCAST_RULES, CONSTRAINT
from caseweave.operators.templates import TEMPLATES
from caseweave.session import freeze, temporary_tables
from caseweave.streaming.tables import batch_ids, drop_batches

#: Tables of the learner's state, and the results that are added up beside it.
STATE = ("splits", "nodes", "cells", "windows", "poor")
PAIRS = "pair_id int, first string, second string"


@dataclass
class StreamedTrees:
    """``folder`` holds the state; it must be visible to all executors."""

    folder: str
    templates: Sequence[str] = tuple(TEMPLATES)
    settings: learning.Settings = field(default_factory=learning.Settings)
    delta: float = DELTA

    def process(self, log: DataFrame, pairs: Sequence[tuple[str, str]], batch_id: int) -> None:
        """Test and learn one batch of finished traces for all pairs so far and those in ``pairs``."""
        spark = log.sparkSession
        with temporary_tables(spark):
            known = self._pairs(spark, batch_id)
            ordered = known + sorted(set(pairs) - set(known))
            if not ordered:
                return
            log = freeze(log, "batch")
            cuts = self._cuts(log, batch_id)
            rows = trees.activations(log, ordered, self.templates, cuts=cuts)
            rows = rows.withColumn("constraint_id", _stable(F.col("constraint_id"), len(ordered)))
            learner = IncrementalTrees(self.settings, self.delta, **{name: self._before(spark, name, batch_id) for name in STATE})
            learner.step(freeze(rows, "activations"), batch_id)
            tables = {name: getattr(learner, name) for name in STATE}
            tables["cuts"] = cuts
            tables["pairs"] = spark.createDataFrame([(i, *pair) for i, pair in enumerate(ordered)], PAIRS)
            tables["scores"] = self._scores(learner.scores[-1], batch_id)
            tables["resets"] = self._resets(learner, batch_id)
            for name, table in tables.items():
                if table is not None:
                    table.write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}/{name}")
        drop_batches(spark, self.folder, keep=2)

    def _before(self, spark: SparkSession, name: str, batch_id: int | None = None) -> DataFrame | None:
        """A table of the last batch, or of the last one before ``batch_id``."""
        ids = [b for b in batch_ids(spark, self.folder) if batch_id is None or b < batch_id]
        return spark.read.parquet(f"{self.folder}/batch_id={ids[-1]}/{name}") if ids else None

    def _pairs(self, spark: SparkSession, batch_id: int | None = None) -> list[tuple[str, str]]:
        table = self._before(spark, "pairs", batch_id)
        return [] if table is None else [(r.first, r.second) for r in table.orderBy("pair_id").collect()]

    def _cuts(self, log: DataFrame, batch_id: int) -> DataFrame:
        """The bins so far, and those of attributes that have had no number before."""
        here = trees.cut_points(log).filter("activity IS NOT NULL")
        known = self._before(log.sparkSession, "cuts", batch_id)
        if known is not None:
            here = known.unionByName(here.join(known, ["activity", "attr"], "left_anti"))
        return freeze(here, "cuts")

    def _scores(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """tp, fp and fn per constraint of all batches, each predicted before it was learnt."""
        earlier = self._before(batch.sparkSession, "scores", batch_id)
        both = batch if earlier is None else earlier.unionByName(batch)
        return both.groupBy("constraint_id").agg(*[F.sum(name).alias(name) for name in ("tp", "fp", "fn")])

    def _resets(self, learner: IncrementalTrees, batch_id: int) -> DataFrame:
        spark = learner.nodes.sparkSession
        none = spark.createDataFrame([], "constraint_id int, node string, batch int")
        earlier, now = self._before(spark, "resets", batch_id), learner.all_resets()
        both = none if earlier is None else earlier
        return both if now is None else both.unionByName(now)

    def _named(self, df: DataFrame) -> DataFrame:
        """Constraints by name instead of number."""
        table = self._before(df.sparkSession, "pairs")
        names = F.array(*[F.lit(t) for t in TEMPLATES])
        names = table.select("*", F.posexplode(names).alias("_t", "template")).select(
            (F.col("pair_id") * len(TEMPLATES) + F.col("_t")).alias("constraint_id"), "template", "first", "second")
        small = len(self._pairs(df.sparkSession)) * len(TEMPLATES) <= BROADCAST_RULES
        rest = [c for c in df.columns if c != "constraint_id"]
        return df.join(F.broadcast(names) if small else names, "constraint_id").select(*CONSTRAINT, *rest)

    # --- views, None before the first batch ---

    def leaves(self, spark: SparkSession) -> DataFrame | None:
        """template, first, second, node, steps, n1, n0 of all trees as of the last batch."""
        if self._before(spark, "nodes") is None:
            return None
        learner = IncrementalTrees(self.settings, nodes=self._before(spark, "nodes"), cells=self._before(spark, "cells"))
        return self._named(learner.leaves())

    def rules(self, spark: SparkSession) -> DataFrame | None:
        """The condition of every constraint that has one."""
        leaves = self.leaves(spark)
        return None if leaves is None else learning.best_rules(leaves, self.settings)

    def prequential_f1(self, spark: SparkSession) -> DataFrame | None:
        """tp, fp, fn and f1 per constraint over all batches, test before training."""
        scores = self._before(spark, "scores")
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return None if scores is None else self._named(scores).withColumn("f1", ratio3(2 * tp, 2 * tp + fp + fn))

    def resets(self, spark: SparkSession) -> DataFrame | None:
        """template, first, second, node, batch: what was forgotten, and when."""
        resets = self._before(spark, "resets")
        return None if resets is None else self._named(resets)


def _stable(constraint_id: Column, n_pairs: int) -> Column:
    """Numbers that stay when pairs are added: pair by pair instead of template by template."""
    return (constraint_id % n_pairs * len(TEMPLATES) + F.floor(constraint_id / n_pairs)).cast("int")
