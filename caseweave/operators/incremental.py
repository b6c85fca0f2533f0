"""Trees that learn batch by batch, notice when their rules no longer hold, and forget.

The state is a handful of small tables: the splits and nodes of all trees, the counts of their
leaves per (constraint, node, attribute, value or bin), an adaptive window of prediction errors per
node, and the attributes a leaf has given up. Each batch is read once:

* *test*: a row is routed to its leaf; the majority there so far is the prediction, and its errors
  are added to the windows of all nodes on the path;
* *forget*: where the windows of a node and of all nodes below it drift, that part of the tree is
  removed, and the node starts again as a leaf with the counts of this batch alone (of several
  such nodes of a path the topmost);
* *train*: the batch's counts are added to the leaves;
* *split*: as in ``trees``, with the cuts of the bins; children know the classes their parent has
  counted on their side, are dealt what it knew at its own birth in the same proportion, and count
  from the next batch on, so leaves add up to all rows since the last reset above them;
* *give up*: an attribute whose best gain lies more than the Hoeffding bound below that of the
  best one is not counted in that leaf any longer, and its counts leave the state.

All tables are written once per batch; a batch that is run again gives the same tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators import trees
from caseweave.operators.drift import DELTA, after_drift
from caseweave.operators.learning import Settings
from caseweave.session import freeze

KEY = ["constraint_id"]
NODE = ["constraint_id", "node"]


def _under(df: DataFrame, tops: DataFrame, *, strictly: bool = False) -> DataFrame:
    """Rows with ``top``: the node of ``tops`` they lie below (or at), or NULL."""
    named = tops.select(F.col("constraint_id").alias("_cid"), F.col("node").alias("top"))
    below = (F.col("constraint_id") == F.col("_cid")) & F.startswith("node", F.col("top"))
    if strictly:
        below = below & (F.col("node") != F.col("top"))
    return df.join(F.broadcast(named), below, "left").drop("_cid")


@dataclass
class IncrementalTrees:
    """``step`` takes one batch of activations (constraint_id, y, feats); the tables are as of the last one."""

    settings: Settings = field(default_factory=Settings)
    delta: float = DELTA
    give_up: bool = True
    splits: DataFrame | None = None  # constraint_id, node, attr, num, val, default_left
    nodes: DataFrame | None = None  # constraint_id, node, steps, n1, n0 (known at its birth), is_leaf
    cells: DataFrame | None = None  # constraint_id, node, attr, code, val, n1, n0, num; attr NULL has the totals
    windows: DataFrame | None = None  # constraint_id, node, window (array of buckets)
    poor: DataFrame | None = None  # constraint_id, node, attr
    resets: list[DataFrame] = field(default_factory=list)  # constraint_id, node, batch
    scores: list[DataFrame] = field(default_factory=list)  # constraint_id, tp, fp, fn of a batch

    def learn(self, batches: Iterable[tuple[int, DataFrame]]) -> IncrementalTrees:
        for number, rows in batches:
            self.step(rows, number)
        return self

    def step(self, rows: DataFrame, batch: int) -> None:
        counted = self._counted(rows)
        nodes = self._with_roots(counted)
        errors = self._test(counted, nodes)
        windows = self._windows(errors, batch)
        tops = freeze(self._drifting(windows), "drift")
        windows = windows.select(*NODE, F.col("kept").alias("window"))
        cells, splits, poor = self.cells, self.splits, self.poor
        if tops.head(1):
            self.resets.append(tops.select(*NODE, F.lit(batch).alias("batch")))
            gone = lambda df, **how: _under(df, tops, **how).filter("top IS NULL").drop("top")
            placed = _under(counted, tops).withColumn("node", F.coalesce("top", "node")).drop("top")
            counted = _summed(placed)
            cells = cells if cells is None else gone(cells)
            splits = splits if splits is None else gone(splits)
            poor = poor if poor is None else gone(poor)
            at_top = _under(gone(nodes, strictly=True), tops)
            fresh = F.col("top").isNotNull()
            nodes = at_top.select(
                *NODE, "steps", F.when(fresh, 0).otherwise(F.col("n1")).alias("n1"), F.when(fresh, 0).otherwise(F.col("n0")).alias("n0"),
                (F.col("is_leaf") | fresh).alias("is_leaf"))
            windows = gone(windows, strictly=True)
        cells = freeze(_summed(counted if cells is None else cells.unionByName(counted)), "cells")
        self._split(cells, nodes, splits, poor, windows)

    def _counted(self, rows: DataFrame) -> DataFrame:
        """The batch's counts per leaf, without the attributes a leaf has given up."""
        if self.splits is None:
            placed = rows.withColumn("node", F.lit(""))
        else:
            table = trees.tree_table(self.splits, KEY).withColumnRenamed("constraint_id", "_cid")
            joined = rows.join(F.broadcast(table), F.col("constraint_id") == F.col("_cid"), "left").drop("_cid")
            placed = trees.routed(joined, table, self.settings.max_depth).drop("tree")
        cells = trees._cells(placed, KEY)
        if self.poor is not None:
            cells = cells.join(F.broadcast(self.poor), [*NODE, "attr"], "left_anti")
        return freeze(cells, "batch")

    def _with_roots(self, counted: DataFrame) -> DataFrame:
        roots = counted.filter("attr IS NULL AND node = ''").select(
            *NODE, F.array().cast(trees.STEPS).alias("steps"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n0"), F.lit(True).alias("is_leaf"))
        if self.nodes is None:
            return roots
        return self.nodes.unionByName(roots.join(self.nodes.select("constraint_id").distinct(), KEY, "left_anti"))

    def _test(self, counted: DataFrame, nodes: DataFrame) -> DataFrame:
        """n and errors of the batch per node, and the batch's confusion counts per constraint."""
        fresh = counted.filter("attr IS NULL").select(*NODE, "n1", "n0")
        known = nodes.select(*NODE, F.col("n1").alias("k1"), F.col("n0").alias("k0"))
        if self.cells is not None:
            seen = self.cells.filter("attr IS NULL").select(*NODE, F.col("n1").alias("s1"), F.col("n0").alias("s0"))
            known = known.join(seen, NODE, "left").select(
                *NODE, (F.col("k1") + F.coalesce("s1", F.lit(0))).alias("k1"), (F.col("k0") + F.coalesce("s0", F.lit(0))).alias("k0"))
        met = freeze(fresh.join(known, NODE).withColumn("says", F.col("k1") > F.col("k0")), "tested")
        says = F.col("says")
        self.scores.append(met.groupBy(*KEY).agg(
            F.sum(F.when(says, F.col("n1")).otherwise(0)).alias("tp"), F.sum(F.when(says, F.col("n0")).otherwise(0)).alias("fp"),
            F.sum(F.when(~says, F.col("n1")).otherwise(0)).alias("fn")))
        # A leaf that knows nothing yet makes no errors that could mean anything.
        path = F.transform(F.sequence(F.lit(0), F.length("node")), lambda i: F.substring("node", F.lit(1), i))
        return (
            met.filter("k1 + k0 > 0")
            .select(*KEY, F.explode(path).alias("node"), (F.col("n1") + F.col("n0")).alias("n"), F.when(says, F.col("n0")).otherwise(F.col("n1")).alias("errors"))
            .groupBy(*NODE).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
        )

    def _windows(self, errors: DataFrame, batch: int) -> DataFrame:
        """constraint_id, node, window with the new bucket, and what is kept of it."""
        bucket = errors.select(*NODE, F.array(F.struct(F.lit(batch).cast("int").alias("batch"), "n", "errors")).alias("new"))
        if self.windows is None:
            grown = bucket.withColumnRenamed("new", "window")
        else:
            none = F.array().cast("array<struct<batch:int,n:long,errors:long>>")
            grown = self.windows.join(bucket, NODE, "full").select(
                *NODE, F.concat(F.coalesce("window", none), F.coalesce("new", none)).alias("window"))
        return freeze(grown.withColumn("kept", after_drift(F.col("window"), self.delta)), "windows")

    def _drifting(self, windows: DataFrame) -> DataFrame:
        """The topmost nodes below which everything drifts: windows that have lost a part, with more errors since."""
        kept, window = F.col("kept"), F.col("window")
        total = lambda w, name: F.aggregate(w, F.lit(0).cast("long"), lambda a, b: a + b[name])
        dropped = F.slice(window, 1, F.size(window) - F.size(kept))
        worse = total(kept, "errors") * total(dropped, "n") > total(dropped, "errors") * total(kept, "n")
        judged = windows.select(*NODE, ((F.size(kept) < F.size(window)) & worse).alias("drifts"))
        same = F.col("constraint_id") == F.col("_cid")
        holding = judged.filter(~F.col("drifts")).select(F.col("constraint_id").alias("_cid"), F.col("node").alias("_node"))
        whole = judged.filter("drifts").select(*NODE).join(F.broadcast(holding), same & F.startswith("_node", F.col("node")), "left_anti")
        above = whole.select(F.col("constraint_id").alias("_cid"), F.col("node").alias("_node"))
        return whole.join(F.broadcast(above), same & F.startswith("node", F.col("_node")) & (F.col("node") != F.col("_node")), "left_anti")

    def _split(self, cells: DataFrame, nodes: DataFrame, splits: DataFrame | None, poor: DataFrame | None, windows: DataFrame) -> None:
        rule = self.settings
        open_nodes = nodes.filter(F.col("is_leaf") & (F.length("node") < rule.max_depth)).select(*NODE)
        open_cells = cells.join(open_nodes, NODE, "left_semi")
        tests = freeze(trees._candidates(open_cells, KEY, rule), "tests")
        found = freeze(trees._chosen(tests, KEY, rule), "splits")
        kept = ["attr", "num", "val", "default_left"]
        self.splits = freeze(found.select(*NODE, *kept) if splits is None else splits.select(*NODE, *kept).unionByName(found.select(*NODE, *kept)), "structure")
        known = nodes.select(*NODE, "steps", "n1", "n0", "is_leaf")
        self.nodes = freeze(_inherited(trees._divided(known, found, KEY), nodes, found), "nodes")
        left = cells.join(found.select(*NODE), NODE, "left_anti")
        gone = self._given_up(left, tests) if self.give_up else None
        if gone is not None:
            left = left.join(F.broadcast(gone), [*NODE, "attr"], "left_anti")
            poor = gone if poor is None else poor.unionByName(gone)
            self.poor = freeze(poor.join(found.select(*NODE), NODE, "left_anti").distinct(), "poor")
        self.cells = freeze(left, "cells")
        self.windows = windows

    def _given_up(self, cells: DataFrame, tests: DataFrame) -> DataFrame:
        """(constraint_id, node, attr) more than the bound behind the best attribute of an open leaf."""
        rule = self.settings
        best = tests.filter(trees._valid(rule)).groupBy(*NODE, "attr").agg(F.max("gain").alias("gain"))
        top = tests.groupBy(*NODE).agg(F.first("total").alias("total")).join(best.groupBy(*NODE).agg(F.max("gain").alias("top")), NODE)
        have = cells.filter("attr IS NOT NULL").select(*NODE, "attr").distinct()
        behind = have.join(best, [*NODE, "attr"], "left").join(top, NODE)
        bound = trees._bound(F.col("total"), rule)
        return freeze(behind.filter(F.col("top") - F.coalesce("gain", F.lit(0.0)) > bound).select(*NODE, "attr"), "given_up")

    def leaves(self) -> DataFrame:
        """constraint_id, node, steps, n1, n0: leaves with all they know."""
        seen = self.cells.filter("attr IS NULL").select(*NODE, F.col("n1").alias("s1"), F.col("n0").alias("s0"))
        return self.nodes.filter("is_leaf").join(seen, NODE, "left").select(
            *NODE, "steps", (F.col("n1") + F.coalesce("s1", F.lit(0))).alias("n1"), (F.col("n0") + F.coalesce("s0", F.lit(0))).alias("n0"))

    def all_resets(self) -> DataFrame | None:
        out = None
        for one in self.resets:
            out = one if out is None else out.unionByName(one)
        return out

    def total_scores(self) -> DataFrame:
        out = self.scores[0]
        for one in self.scores[1:]:
            out = out.unionByName(one)
        return out.groupBy(*KEY).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _inherited(divided: DataFrame, before: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes after a split, with the parents' birth knowledge dealt to the new children."""
    births = before.select(*NODE, F.col("n1").alias("b1"), F.col("n0").alias("b0"))
    parents = found.select(*NODE, "t1", "t0").join(births, NODE).withColumnsRenamed({"constraint_id": "_cid", "node": "_parent"})
    is_child = (F.col("constraint_id") == F.col("_cid")) & (F.length("node") > 0) & (F.expr("left(node, length(node) - 1)") == F.col("_parent"))
    left, total = F.endswith("node", F.lit("0")), F.col("t1") + F.col("t0")
    rows_left = F.when(left, F.col("n1") + F.col("n0")).otherwise(total - F.col("n1") - F.col("n0"))

    def dealt(n: str, seen: str, birth: str) -> Column:
        on_left = F.when(left, F.col(n)).otherwise(F.col(seen) - F.col(n))
        share = F.when(F.col(seen) > 0, on_left / F.when(F.col(seen) > 0, F.col(seen))).otherwise(rows_left / total)
        to_left = F.round(F.col(birth) * share).cast("long")
        return F.col(n) + F.coalesce(F.when(left, to_left).otherwise(F.col(birth) - to_left), F.lit(0))

    return divided.join(parents, is_child, "left").select(
        *NODE, "steps", dealt("n1", "t1", "b1").alias("n1"), dealt("n0", "t0", "b0").alias("n0"), "is_leaf")


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*NODE, "attr", "code", "val").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("num").alias("num"))
