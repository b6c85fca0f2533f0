"""Decision trees for all constraints at once, grown level by level from counts.

The log is read once: events are counted by what they have in common -- partner, verdicts of
all templates, value or bin of each attribute (``Binned``). Each level routes these counts, not
the activations, to the nodes by the splits found so far (a small table) and adds them up per
(constraint, node, attribute, value or bin). No attribute and no value is too rare to be counted.

**Numbers.** A sketch of quantiles per (activity, attribute), merged over the partitions of
the log, cuts the numbers into bins; activations are counted per bin and class. Between two
bins the gain is known exactly. Inside a bin a better cut can lie only if one of the two
corners of its counts -- all of one class first, or all of the other -- promises more, as
information gain is convex. In those few bins every value is counted. So the cut is the best
one over all values, and the first of equal ones, whatever the sketch says. A cut inside a bin
divides it, and the events are counted again. A bin of share w beside a share s promises about
w * w / s, so bins are narrower towards both ends: then none promises much more than another.

**Splits.** A node is split by the attribute with the highest gain if the Hoeffding bound says
that this beats not splitting and the second best attribute that does so as well (or the
bound is below ``tau``). Rows without the attribute go to the larger side. Equal gains go to
the earlier attribute, then to the smaller cut or value.

**Versions.** With a ``batch`` in the rows, one tree per constraint and version is grown, all
in the same pass: version v knows the batches before v, added up before its rows are routed.
``prequential_scores`` holds each of them against its own batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.scalars import RESERVED_KEYS, as_boolean, as_number, number_text, payload, ratio3
from caseweave.operators.candidates import PASS_WIDTH
from caseweave.operators.learning import Settings
from caseweave.operators.metrics import BROADCAST_RULES, CONSTRAINT
from caseweave.operators.templates import (
    FULFILLED,
    PENDING,
    TEMPLATES,
    constraint_table,
    scanned_events,
    verdict_bits,
    verdicts,
    with_partners,
)
from caseweave.plans.ordered import running_sums
from caseweave.session import freeze

STEPS = "array<struct<attr:string,op:string,value:string>>"
FEATURES = "array<struct<attr:string,num:double,code:int,val:string>>"

#: Bins of the quantile sketch, and how exact it is (relative rank error 1 / ACCURACY).
BINS, ACCURACY = 64, 4000
#: Up to this many attributes are columns of their own while events are counted; more stay a list.
COLUMNS = 32
#: Cut points of so many (activity, attribute) are broadcast; more are joined.
BROADCAST_CUTS = 10_000
#: Bins with more activations than this are searched by blocked sums, others by windows.
WINDOW_ROWS = 1_000_000


@dataclass(frozen=True)
class Trees:
    """``nodes``: keys, node, steps, n1, n0, is_leaf. ``splits``: keys, node, attr, num, val, default_left.
    ``rows``: the rows the trees have grown from, in bins that no split divides."""

    nodes: DataFrame
    splits: DataFrame
    keys: tuple[str, ...]
    rows: DataFrame | None = None

    def leaves(self) -> DataFrame:
        return self.nodes.filter("is_leaf").drop("is_leaf")


def _quantiles(log: DataFrame) -> DataFrame:
    """(activity, attr, cuts) of all attributes; ``cuts`` is NULL where none of the values is a number."""
    entries = log.select("activity", F.explode("attrs").alias("attr", "text")).filter(~F.col("attr").isin(*RESERVED_KEYS) & F.col("text").isNotNull())
    steps = [math.sin(math.pi * i / (2 * BINS)) ** 2 for i in range(1, BINS)]
    return (
        entries.select("activity", "attr", as_number(F.col("text")).alias("num"))
        .groupBy("activity", "attr")
        .agg(F.array_sort(F.array_distinct(F.percentile_approx("num", steps, ACCURACY))).alias("cuts"))
    )


def cut_points(log: DataFrame) -> DataFrame:
    """(activity, attr, cuts): quantiles of the numbers an attribute has at an activity."""
    return _quantiles(log).filter("cuts IS NOT NULL")


def with_features(log: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """The log with ``feats``: per attribute its number and bin, or its text. ``cuts``: bins kept from before."""
    cuts = freeze(cut_points(log), "cuts") if cuts is None else cuts
    by_activity = cuts.groupBy("activity").agg(F.map_from_entries(F.collect_list(F.struct("attr", "cuts"))).alias("_cuts"))
    if cuts.count() <= BROADCAST_CUTS:
        by_activity = F.broadcast(by_activity)
    joined = log.join(by_activity.withColumnRenamed("activity", "_of"), F.col("activity") == F.col("_of"), "left")
    entries = F.map_entries(F.map_filter(payload(F.col("attrs")), lambda _, text: text.isNotNull()))
    typed = F.transform(entries, lambda e: F.struct(e["key"].alias("attr"), as_number(e["value"]).alias("num"), e["value"].alias("text")))

    def feature(e: Column) -> Column:
        cuts = F.coalesce(F.col("_cuts")[e["attr"]], F.array().cast("array<double>"))
        code = F.when(e["num"].isNotNull(), F.size(F.filter(cuts, lambda c: c < e["num"])))
        text = F.when(e["num"].isNull(), F.when(as_boolean(e["text"]).isNotNull(), F.lower(e["text"])).otherwise(e["text"]))
        return F.struct(e["attr"].alias("attr"), e["num"].alias("num"), code.alias("code"), text.alias("val"))

    return joined.withColumn("_typed", typed).withColumn("feats", F.transform("_typed", feature).cast(FEATURES)).drop("_typed", "_cuts", "_of")


def activations(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    keep: Sequence[str] = (),
    complete: bool = False,
    hot_rows: int | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """constraint_id, y, feats (and the log columns in ``keep``) of every decided activation.

    The scanned events are written once; the rows are expanded from them in place whenever
    they are read.
    """
    rows = verdicts(
        with_features(log, cuts), pairs, templates, keep=["feats", *keep], numbered=True, complete=complete, frozen=True, hot_rows=hot_rows
    )
    decided = rows.filter(F.col("verdict") != PENDING)
    return decided.select("constraint_id", (F.col("verdict") == FULFILLED).alias("y"), "feats", *keep)


class Binned:
    """The activations of ``activations``, counted: rows constraint_id, feats, n1, n0 (and ``keep``).

    A number stands for all numbers of its bin, as the largest of them. The scanned events are
    written once, and counted per (partner, verdicts, ``keep``, values and bins) before constraints
    are told apart; so the rows grow with what occurs, and there are never more than events times
    partners. Until then each attribute is three plain columns (number, bin, text), unless there
    are more than ``COLUMNS`` attributes: then they are one list, ``feats``.
    """

    def __init__(self, log: DataFrame, pairs: Sequence[tuple[str, str]], templates: Sequence[str] = tuple(TEMPLATES), *,
                 keep: Sequence[str] = (), complete: bool = False, hot_rows: int | None = None):
        self.pairs, self.templates, self.keep = pairs, templates, list(keep)
        held = freeze(_quantiles(log), "cuts")
        attrs = held.groupBy("attr").agg(F.count("cuts").alias("n")).orderBy("attr").limit(COLUMNS + 1).collect()
        self.listed = len(attrs) > COLUMNS
        self.attrs = [] if self.listed else [r.attr for r in attrs]
        self.codes, self.values, self.numbers = ([f"_{kind}{i}" for i in range(len(self.attrs))] for kind in ("code", "value", "number"))
        fields = ["feats"] if self.listed else [*self.codes, *self.values, *self.numbers]
        featured = with_features(log, held.filter("cuts IS NOT NULL")) if self.listed else self._columns(log, held, [r.n > 0 for r in attrs])
        featured = featured.select("case_id", "activity", "ts", "seq", *fields, *keep, *([] if complete else ["is_end"]))
        if self.listed or len({name for pair in pairs for name in pair}) > PASS_WIDTH:  # read more than once
            featured = freeze(featured, "featured")
        self.scans = scanned_events(featured, pairs, keep=[*fields, *keep], complete=complete, frozen=True, hot_rows=hot_rows)
        numbers = self.scans[0][1].select("activity", F.inline(self._feats())).filter("code IS NOT NULL")
        ranges = numbers.groupBy("activity", "attr", "code").agg(F.min("num").alias("low"), F.max("num").alias("high"))
        self.ranges = freeze(ranges, "ranges")
        self.small = self.ranges.count() <= BROADCAST_CUTS * BINS

    def _columns(self, log: DataFrame, held: DataFrame, numeric: Sequence[bool]) -> DataFrame:
        """The log with number, bin and text of every attribute. The bin -- how many cuts lie below the
        number -- is found by halving, in steps that compile to plain code."""
        steps = [1 << k for k in reversed(range((BINS - 1).bit_length()))]
        padded = F.concat("cuts", F.array_repeat(F.lit(math.inf), F.lit(sum(steps)) - F.size("cuts")))
        found = held.filter("cuts IS NOT NULL").groupBy(F.col("activity").alias("_of")).agg(
            F.lit(True).alias("_any"), *[F.max(F.when(F.col("attr") == a, padded)).alias(f"_cuts{i}") for i, a in enumerate(self.attrs)])
        small = held.count() <= BROADCAST_CUTS
        met = log.join(F.broadcast(found) if small else found, F.col("activity") == F.col("_of"), "left")
        text = [F.col(f"_text{i}") for i in range(len(self.attrs))]
        met = met.select("*", *[F.col("attrs")[a].alias(f"_text{i}") for i, a in enumerate(self.attrs)]).drop("attrs", "_of", "_any")
        met = met.select("*", *[(as_number(text[i]) if numeric[i] else F.lit(None).cast("double")).alias(name) for i, name in enumerate(self.numbers)])
        met = met.select("*", *[F.when(F.col(n).isNotNull(), F.lit(0)).alias(code) for n, code in zip(self.numbers, self.codes)])
        rest = [c for c in met.columns if c not in self.codes]
        for step in steps:
            further = [
                F.col(code) + F.when(F.get(f"_cuts{i}", F.col(code) + (step - 1)) < F.col(self.numbers[i]), step).otherwise(0) if numeric[i] else F.col(code)
                for i, code in enumerate(self.codes)]
            met = met.select(*rest, *[c.alias(code) for c, code in zip(further, self.codes)])
        plain = [F.when(F.col(n).isNull(), F.when(as_boolean(t).isNotNull(), F.lower(t)).otherwise(t)) for n, t in zip(self.numbers, text)]
        return met.select("*", *[c.alias(name) for c, name in zip(plain, self.values)])

    def _feats(self, number=None, *more) -> Column:
        """The attributes of an event as a list. ``number`` and ``more`` say what stands there for attribute i."""
        if self.listed:
            return F.col("feats")
        each = []
        for i, (attr, n, code, value) in enumerate(zip(self.attrs, self.numbers, self.codes, self.values)):
            fields = [F.lit(attr).alias("attr"), (F.col(n) if number is None else number(i)).alias("num"), F.col(code).alias("code"), F.col(value).alias("val")]
            each.append(F.when(F.col(code).isNotNull() | F.col(value).isNotNull(), F.struct(*fields, *[m(i) for m in more])))
        kind = FEATURES if not more else FEATURES.replace(">>", ",many:boolean>>")
        return F.array_compact(F.array(*each)).cast(kind) if each else F.array().cast(kind)

    def _activities(self) -> DataFrame:
        """constraint_id and the activity that activates it."""
        on_first = F.col("template").isin(*[t.name for t in TEMPLATES.values() if t.activation == "first"])
        names = constraint_table(self.ranges.sparkSession, self.pairs)
        return names.select("constraint_id", F.when(on_first, F.col("first")).otherwise(F.col("second")).alias("activity"))

    def of_activity(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` with the activity of their constraint."""
        names, few = self._activities(), len(self.pairs) * len(TEMPLATES) <= BROADCAST_RULES
        return df.join(F.broadcast(names) if few else names, "constraint_id")

    def _beside(self, context: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("activity", "_of")
        return context.join(F.broadcast(table) if self.small else table, F.col("activity") == F.col("_of"), "left").drop("_of")

    def _verdicts(self, each) -> DataFrame:
        found = with_partners([(names, each(context)) for names, context in self.scans], self.pairs)
        return found.withColumn("_bits", verdict_bits(self.templates))

    def _named(self, rows: DataFrame, n: Column, *columns: str) -> DataFrame:
        """Rows per constraint from rows per partner and verdicts."""
        seen = []
        for i, name in enumerate(self.templates):
            number = F.lit(list(TEMPLATES).index(name) * len(self.pairs)) + F.col(f"pair_as_{TEMPLATES[name].activation}")
            decided, hit = (F.col("_bits").bitwiseAND(F.lit(1 << (2 * i + k))) != 0 for k in (0, 1))
            one = F.struct(number.alias("constraint_id"), F.when(hit, n).otherwise(0).alias("n1"), F.when(hit, 0).otherwise(n).alias("n0"))
            seen.append(F.when(decided, one))
        found = rows.withColumn("_s", F.explode(F.array(*seen))).filter(F.col("_s").isNotNull())
        return found.select("_s.*", *columns, *self.keep)

    def _by_attribute(self, found: DataFrame, values: Column, prefix: str) -> DataFrame:
        """One row per activity: ``values`` of each attribute, as columns or as one map ``prefix``."""
        if self.listed:
            by_attr = found.groupBy("activity", "attr").agg(values.alias("v"))
            return by_attr.groupBy("activity").agg(F.map_from_entries(F.collect_list(F.struct("attr", "v"))).alias(prefix))
        by_attr = found.groupBy("activity", "attr").agg(values.alias("v"))
        return by_attr.groupBy("activity").agg(F.lit(True).alias("_any"), *[F.max(F.when(F.col("attr") == a, F.col("v"))).alias(f"{prefix}{i}") for i, a in enumerate(self.attrs)]).drop("_any")

    def _bins(self) -> DataFrame:
        """activity, _bins: per attribute the bins with their largest number, and whether they hold several."""
        held = F.struct("high", (F.col("low") < F.col("high")).alias("many"))
        by_attr = self.ranges.groupBy("activity", "attr").agg(F.map_from_entries(F.collect_list(F.struct("code", held))).alias("m"), F.max("code").alias("top"))
        bins = F.transform(F.sequence(F.lit(0), F.col("top")), lambda c: F.col("m")[c])
        return by_attr.groupBy("activity").agg(F.map_from_entries(F.collect_list(F.struct("attr", bins.alias("bins")))).alias("_bins"))

    def rows(self, splits: DataFrame | None = None) -> DataFrame:
        """The counted activations, with bins divided where a split cuts them."""
        cuts = None
        if splits is not None:
            cuts = self._by_attribute(self.of_activity(splits.filter("val IS NULL")), F.array_sort(F.collect_set("num")), "_cuts")

        def first_cut(cuts: Column, number: Column) -> Column:
            return F.get(F.filter(cuts, lambda c: c >= number), F.lit(0))

        def coarse(f: Column) -> Column:
            held = F.get(F.col("_bins")[f["attr"]], f["code"])
            top = held["high"] if cuts is None else F.least(held["high"], first_cut(F.col("_cuts")[f["attr"]], f["num"]))
            return F.struct(f["attr"].alias("attr"), F.when(f["code"].isNotNull(), top).alias("num"), f["code"].alias("code"),
                            f["val"].alias("val"), F.coalesce(held["many"], F.lit(False)).alias("many"))

        tops = [] if cuts is None or self.listed else [f"_top{i}" for i in range(len(self.attrs))]

        def each(context: DataFrame) -> DataFrame:
            if self.listed:
                met = self._beside(context, self._bins())
                met = met if cuts is None else self._beside(met, cuts)
                return met.withColumn("feats", F.transform("feats", coarse)).drop("_bins", "_cuts")
            met = context if cuts is None else self._beside(context, cuts)
            return met.select(*context.columns, *[first_cut(F.col(f"_cuts{i}"), F.col(n)).alias(t) for i, (t, n) in enumerate(zip(tops, self.numbers))])

        here = ["feats"] if self.listed else ["activity", *self.codes, *self.values, *tops]
        # No filter on the verdicts here: worked out twice they are too much code to be compiled. ``_named`` drops the undecided.
        counted = self._verdicts(each).groupBy("pair_as_first", "pair_as_second", "_bits", *here, *self.keep).agg(F.count("*").alias("_n"))
        parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        named = self._named(freeze(counted.repartition(parts), "counted"), F.col("_n"), *here)
        # Events of other verdicts, of which a constraint sees no more than its own, are alike here.
        rows = named.groupBy("constraint_id", *here, *self.keep).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        if not self.listed:
            held = lambda i: F.get(F.col("_bins")[self.attrs[i]], F.col(self.codes[i]))
            top = lambda i: F.when(F.col(self.codes[i]).isNotNull(), F.least(held(i)["high"], F.col(tops[i])) if tops else held(i)["high"])
            feats = self._feats(top, lambda i: F.coalesce(held(i)["many"], F.lit(False)).alias("many"))
            rows = self._beside(rows, self._bins()).withColumn("feats", feats)
        return freeze(rows.select("constraint_id", "feats", "n1", "n0", *self.keep).repartition(parts), "rows")

    def inside(self, bins: DataFrame) -> DataFrame:
        """The activations in the given bins (constraint_id, attr, code) of their constraints, with their own numbers."""
        wanted = self._by_attribute(self.of_activity(bins.select("constraint_id", "attr", "code")), F.array_sort(F.collect_set("code")), "_wanted")

        def each(context: DataFrame) -> DataFrame:
            met = self._beside(context, wanted)
            if self.listed:
                return met.filter(F.exists("feats", lambda f: F.array_contains(F.col("_wanted")[f["attr"]], f["code"]))).drop("_wanted")
            any_of = F.lit(False)
            for i, code in enumerate(self.codes):
                any_of = any_of | F.coalesce(F.array_contains(F.col(f"_wanted{i}"), F.col(code)), F.lit(False))
            return met.filter(any_of).select(*context.columns, self._feats().alias("feats"))

        found = self._named(self._verdicts(each), F.lit(1).cast("long"), "feats")
        return found.join(F.broadcast(bins.select("constraint_id").distinct()), "constraint_id", "left_semi")

    def divides(self, splits: DataFrame) -> bool:
        """Whether a split lies inside a bin."""
        whole = self.ranges.select("activity", "attr", F.col("high").alias("num"))
        return bool(self.of_activity(splits.filter("val IS NULL")).join(whole, ["activity", "attr", "num"], "left_anti").head(1))


def _entropy(a: Column, b: Column) -> Column:
    def term(x: Column) -> Column:
        return F.when(x > 0, -(x / (a + b)) * F.log2(x / (a + b))).otherwise(F.lit(0.0))

    return F.when(a + b > 0, term(a) + term(b)).otherwise(F.lit(0.0))


def _gain(left1: Column, left0: Column, all1: Column, all0: Column, total: Column) -> Column:
    """Information gain over the rows that have the attribute, scaled by their share."""
    left, present = left1 + left0, all1 + all0
    right1, right0 = all1 - left1, all0 - left0
    whole = _entropy(all1, all0) - left / present * _entropy(left1, left0) - (right1 + right0) / present * _entropy(right1, right0)
    return F.round(present / total * whole, 9)


def _bound(total: Column, settings: Settings) -> Column:
    return F.sqrt(F.lit(math.log(1.0 / settings.delta)) / (2 * total))


def _goes_left(feats: Column, split: Column) -> Column:
    """Side of a row at a split; rows without the attribute, or without a number for a cut, take the default."""
    have = F.get(F.filter(feats, lambda f: f["attr"] == split["attr"]), F.lit(0))
    holds = F.when(split["val"].isNull(), have["num"] <= split["num"]).when(
        have["attr"].isNotNull(), F.coalesce(have["val"] == split["val"], F.lit(False))
    )
    return F.coalesce(holds, split["default_left"])


def routed(rows: DataFrame, trees: DataFrame, depth: int) -> DataFrame:
    """Rows with their ``node``, up to ``depth`` steps below the root. ``trees`` is ``tree_table``, joined already."""
    def step(node: Column, _: Column) -> Column:
        split = F.try_element_at("tree", node)
        side = F.when(_goes_left(F.col("feats"), split), "0").otherwise("1")
        return F.when(split["default_left"].isNull(), node).otherwise(F.concat(node, side))

    return rows.withColumn("node", F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(""), step))


def tree_table(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per tree: its splits by node. At most 2 ** max_depth entries."""
    entry = F.struct("node", F.struct("attr", "num", "val", "default_left"))
    return splits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("tree"))


def _met(rows: DataFrame, trees: DataFrame, versions: Sequence[int] | None, small: bool) -> DataFrame:
    """Rows beside the trees of their constraint (of all later versions, where there are versions)."""
    trees = trees.withColumnRenamed("constraint_id", "_cid")
    met = F.col("constraint_id") == F.col("_cid")
    if versions is not None:
        met = met & (F.col("batch") < F.col("version"))
    return rows.join(F.broadcast(trees) if small else trees, met).drop("_cid")


def _known(rows: DataFrame, versions: Sequence[int]) -> DataFrame:
    """Counted rows of batches, added up per version over the batches it knows."""
    later = F.filter(F.array(*[F.lit(int(v)) for v in versions]), lambda v: v > F.col("batch"))
    spread = rows.withColumn("version", F.explode(later)).groupBy("version", "constraint_id", "feats")
    return freeze(spread.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "known")


def _counts(rows: DataFrame) -> list[Column]:
    """Rows by class: one each, or as many as they stand for."""
    if "n1" in rows.columns:
        return [F.sum("n1").alias("n1"), F.sum("n0").alias("n0")]
    return [F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0")]


def _cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per keys, node, attribute and value or bin; the row without attribute has the totals."""
    fields = rows.schema["feats"].dataType.elementType
    whole = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]))
    here = rows.select(*keys, "node", *_classes(rows), F.inline(F.concat("feats", whole)))
    many = [F.max("many").alias("many")] if "many" in fields.names else []
    return here.groupBy(*keys, "node", "attr", "code", "val").agg(*_counts(rows), F.max("num").alias("num"), *many)


def _classes(rows: DataFrame) -> list[str]:
    return ["n1", "n0"] if "n1" in rows.columns else ["y"]


def _candidates(cells: DataFrame, keys: Sequence[str], settings: Settings) -> DataFrame:
    """Every test at hand with its counts and gain, and for bins what lies inside at best (``promise``)."""
    here = [*keys, "node"]
    totals = (
        cells.filter("attr IS NULL").select(*here, F.col("n1").alias("t1"), F.col("n0").alias("t0"), (F.col("n1") + F.col("n0")).alias("total"))
        .filter(F.col("total") >= settings.grace)
    )
    present = cells.filter("attr IS NOT NULL").groupBy(*here, "attr").agg(F.sum("n1").alias("p1"), F.sum("n0").alias("p0"))
    nominal = (
        cells.filter("val IS NOT NULL").join(present, [*here, "attr"])
        .select(*here, "attr", F.lit(None).cast("int").alias("code"), F.lit(None).cast("double").alias("num"), "val",
                F.lit(0).cast("long").alias("before1"), F.lit(0).cast("long").alias("before0"),
                F.col("n1").alias("left1"), F.col("n0").alias("left0"), F.col("p1").alias("all1"), F.col("p0").alias("all0"))
    )
    whole = Window.partitionBy(*here, "attr")  # at most BINS rows
    upto = whole.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    binned = "many" in cells.columns  # numbers stand for their bins: what lies in a bin of several is not known here
    if binned:
        nominal = nominal.withColumn("many", F.lit(False))
    numeric = cells.filter("code IS NOT NULL").select(
        *here, *(["many"] if binned else []), "attr", "code", "num", F.lit(None).cast("string").alias("val"),
        (F.sum("n1").over(upto) - F.col("n1")).alias("before1"), (F.sum("n0").over(upto) - F.col("n0")).alias("before0"),
        F.sum("n1").over(upto).alias("left1"), F.sum("n0").over(upto).alias("left0"),
        F.sum("n1").over(whole).alias("all1"), F.sum("n0").over(whole).alias("all0"),
    )
    tests = nominal.unionByName(numeric).join(totals, here)
    corner = lambda a, b: _gain(F.col(a), F.col(b), F.col("all1"), F.col("all0"), F.col("total"))
    inside = F.col("code").isNotNull() & (F.col("left1") + F.col("left0") - F.col("before1") - F.col("before0") > (0 if binned else 1))
    inside = inside & F.col("many") if binned else inside
    return tests.select("*", corner("left1", "left0").alias("gain"), F.when(inside, F.greatest(corner("left1", "before0"), corner("before1", "left0"))).alias("promise"))


def _valid(settings: Settings) -> Column:
    left, present = F.col("left1") + F.col("left0"), F.col("all1") + F.col("all0")
    return F.least(left, present - left) > settings.min_branch * present


def _inside(rows: DataFrame, bins: DataFrame, keys: Sequence[str], largest: int, small: bool, settings: Settings) -> DataFrame:
    """Every value of the given bins as a test, with counts and gain."""
    here = [*keys, "node", "attr", "code"]
    values = rows.select(*keys, "node", *_classes(rows), F.inline("feats")).filter("code IS NOT NULL")
    wanted = bins.select(*here)
    counted = (
        values.join(F.broadcast(wanted) if small else wanted, here, "left_semi").groupBy(*here, "num")
        .agg(*_counts(rows))
    )
    if largest <= WINDOW_ROWS:
        upto = Window.partitionBy(*here).orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
        summed = counted.select(*here, "num", F.sum("n1").over(upto).alias("s1"), F.sum("n0").over(upto).alias("s0"))
    else:
        summed = running_sums(counted, here, ["num"], {"s1": F.col("n1"), "s0": F.col("n0")}).drop("n1", "n0")
    around = bins.select(*here, "before1", "before0", "all1", "all0", "t1", "t0", "total")
    tests = summed.join(around, here).withColumn("left1", F.col("before1") + F.col("s1")).withColumn("left0", F.col("before0") + F.col("s0"))
    gain = _gain(F.col("left1"), F.col("left0"), F.col("all1"), F.col("all0"), F.col("total"))
    return tests.select("*", F.lit(None).cast("string").alias("val"), gain.alias("gain"))


def _chosen(tests: DataFrame, keys: Sequence[str], settings: Settings) -> DataFrame:
    """The nodes to split and their tests, with the counts of both sides."""
    here = [*keys, "node"]
    test = F.struct("gain", "attr", "num", "val", "left1", "left0", "all1", "all0", "t1", "t0", "total")
    # min_by: the least of (-gain, cuts before values, cut, value)
    order = F.struct((-F.col("gain")).alias("g"), F.col("num").isNull().alias("k"), F.col("num").alias("c"), F.col("val").alias("v"))
    per_attribute = tests.filter(_valid(settings)).groupBy(*here, "attr").agg(F.min_by(test, order).alias("best"))
    counts = per_attribute.select(*here, "attr", "best", F.struct((-F.col("best.gain")).alias("g"), F.col("attr").alias("a")).alias("rank"))
    per_node = counts.groupBy(*here).agg(
        F.min_by("best", "rank").alias("best"),
        F.sort_array(F.collect_list("best.gain"), asc=False).alias("gains"),  # one per attribute
    )
    bound = _bound(F.col("best.total"), settings)
    second = F.coalesce(F.get("gains", F.lit(1)), F.lit(0.0))
    lead = F.col("best.gain") - F.when(second > bound, second).otherwise(0.0)
    split = per_node.filter((F.col("best.gain") > bound) & ((lead > bound) | (bound < settings.tau)))
    return split.select(*here, "best.*").withColumn("default_left", F.col("left1") + F.col("left0") >= F.col("all1") - F.col("left1") + F.col("all0") - F.col("left0"))


def grow(source: DataFrame | Binned, settings: Settings = Settings(), *, versions: Sequence[int] | None = None, bound: int | None = None) -> Trees:
    """Trees of all constraints in ``source``: rows (constraint_id, y, feats, and batch with
    ``versions``), or the same ``Binned``.

    A level costs one pass that counts, one that looks into the bins where a better cut may
    lie, if there are any, and small tables. ``bound`` is the caller's bound on the number of
    trees: up to ``BROADCAST_RULES`` of them are broadcast.
    """
    keys = ("constraint_id",) if versions is None else ("version", "constraint_id")
    small = bound is not None and bound <= BROADCAST_RULES
    binned = isinstance(source, Binned)
    rows = source.rows() if binned else source
    known = _known(rows, versions) if binned and versions is not None else rows
    spark = rows.sparkSession
    nodes, splits = None, None

    def placed(rows: DataFrame, depth: int, only: DataFrame | None = None) -> DataFrame:
        """Rows in the nodes of a level, of the trees in ``only``."""
        if depth:
            open_trees = tree_table(splits if only is None else splits.join(only.select(*keys).distinct(), list(keys), "left_semi"), keys)
            if "version" in rows.columns:
                met = rows.join(F.broadcast(open_trees) if small else open_trees, list(keys))
            else:
                met = _met(rows, open_trees, versions, small)
            return routed(met, open_trees, depth).filter(F.length("node") == depth).drop("tree")
        here = rows.withColumn("node", F.lit(""))
        if versions is not None and "version" not in rows.columns:
            numbers = spark.createDataFrame([(int(v),) for v in versions], "version int")
            here = here.join(F.broadcast(numbers), F.col("batch") < F.col("version"))
        return here

    for depth in range(settings.max_depth):
        if depth == 0 and versions is not None and not binned:  # counted by batch first, then added up for the versions that know the batch
            cells = _cells(rows.withColumn("node", F.lit("")), ["batch", "constraint_id"])
            later = F.filter(F.array(*[F.lit(int(v)) for v in versions]), lambda v: v > F.col("batch"))
            spread = cells.withColumn("version", F.explode(later))
            cells = spread.groupBy(*keys, "node", "attr", "code", "val").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("num").alias("num"))
        else:
            cells = _cells(placed(known, depth), keys)
        cells = freeze(cells, "cells")
        if nodes is None:
            nodes = cells.filter("attr IS NULL").select(*keys, "node", F.array().cast(STEPS).alias("steps"), "n1", "n0", F.lit(True).alias("is_leaf"))
        tests = freeze(_candidates(cells, keys, settings), "tests")
        best = tests.filter(_valid(settings)).groupBy(*keys, "node", "attr").agg(F.max("gain").alias("found"))
        # Below tau the second best attribute does not count: what matters must beat the best of all.
        top = best.groupBy(*keys, "node").agg(F.max("found").alias("top"))
        bound_here = _bound(F.col("total"), settings)
        beaten = F.when(bound_here < settings.tau, F.col("top")).otherwise(F.col("found"))
        alive = F.col("promise") >= F.greatest(F.coalesce(beaten, F.lit(0.0)), bound_here)
        bins = freeze(tests.join(best, [*keys, "node", "attr"], "left").join(top, [*keys, "node"], "left").filter(alive), "bins")
        size = bins.agg(F.count("*").alias("n"), F.max(F.col("left1") + F.col("left0") - F.col("before1") - F.col("before0")).alias("largest")).head()
        kept = [*keys, "node", "attr", "num", "val", "left1", "left0", "all1", "all0", "t1", "t0", "total", "gain"]
        few = size.n <= BROADCAST_RULES
        if size.n:
            # All values of these bins are tested, the last one too.
            others = tests.join(F.broadcast(bins.select(*keys, "node", "attr", "code")) if few else bins.select(*keys, "node", "attr", "code"),
                                [*keys, "node", "attr", "code"], "left_anti")
            here = placed(source.inside(bins) if binned else rows, depth, bins)
            tests = others.select(*kept).unionByName(_inside(here, bins, keys, size.largest, few, settings).select(*kept))
        else:
            tests = tests.select(*kept)
        found = freeze(_chosen(tests, keys, settings), "splits")
        if not found.head(1):
            break
        splits = found if splits is None else splits.unionByName(found)
        nodes = freeze(_divided(nodes, found, keys), "nodes")
        if binned and (versions is not None or depth + 1 < settings.max_depth) and source.divides(found):
            rows = source.rows(splits)
            known = _known(rows, versions) if versions is not None else rows
    if splits is None:
        splits = found
    return Trees(nodes, splits, keys, rows)


def _divided(nodes: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nodes after the splits: the split ones are no leaves any more, and have two children."""
    here = [*keys, "node"]
    marked = nodes.join(found.select(*here, F.lit(True).alias("_split")), here, "left")
    kept = marked.withColumn("is_leaf", F.col("is_leaf") & F.col("_split").isNull()).drop("_split")
    missing1, missing0 = F.col("t1") - F.col("all1"), F.col("t0") - F.col("all0")
    left, none = F.col("default_left"), F.lit(0)
    # Two places where they are the number itself, else all its digits: rules are tested by this text.
    number = F.when(F.round("num", 2) == F.col("num"), number_text(F.col("num"))).otherwise(F.col("num").cast("string"))
    is_cut, value = F.col("val").isNull(), F.coalesce("val", number)

    def child(side: str, op: Column, n1: Column, n0: Column) -> Column:
        step = F.struct(F.col("attr").alias("attr"), op.alias("op"), value.alias("value"))
        return F.struct(F.concat("node", F.lit(side)).alias("node"), F.array_append("steps", step).cast(STEPS).alias("steps"),
                        n1.cast("long").alias("n1"), n0.cast("long").alias("n0"))

    parents = found.join(nodes.select(*here, "steps"), here)
    children = parents.select(*keys, F.inline(F.array(
        child("0", F.when(is_cut, "<=").otherwise("=="), F.col("left1") + F.when(left, missing1).otherwise(none),
              F.col("left0") + F.when(left, missing0).otherwise(none)),
        child("1", F.when(is_cut, ">").otherwise("!="), F.col("all1") - F.col("left1") + F.when(~left, missing1).otherwise(none),
              F.col("all0") - F.col("left0") + F.when(~left, missing0).otherwise(none)),
    ))).withColumn("is_leaf", F.lit(True))
    return kept.unionByName(children)


def named(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``constraint_id`` replaced by template, first and second."""
    names = constraint_table(df.sparkSession, pairs)
    small = len(pairs) * len(TEMPLATES) <= BROADCAST_RULES
    rest = [c for c in df.columns if c != "constraint_id"]
    return df.join(F.broadcast(names) if small else names, "constraint_id").select(*CONSTRAINT, *rest)


def predicted(rows: DataFrame, trees: Trees, *, small: bool = False) -> DataFrame:
    """Rows with the label their tree predicts: the majority of their leaf, violated if there is none.

    Versioned trees predict the rows of the batch they are named after.
    """
    keys = list(trees.keys)
    of = [F.col("constraint_id") == F.col("_cid")]
    table = tree_table(trees.splits, keys).withColumnRenamed("constraint_id", "_cid")
    leaf_names = {"constraint_id": "_lid", "node": "_leaf"}
    if "version" in keys:
        of.append(F.col("batch") == F.col("version"))
        leaf_names["version"] = "_lversion"
    joined = rows.join(F.broadcast(table) if small else table, of, "left").drop("_cid", *[k for k in keys if k == "version"])
    depth = trees.nodes.agg(F.max(F.length("node"))).head()[0] or 0
    placed = routed(joined, table, depth).drop("tree") if depth else joined.withColumn("node", F.lit("")).drop("tree")
    leaves = trees.leaves().select(*[F.col(k).alias(leaf_names.get(k, k)) for k in (*keys, "node")], (F.col("n1") > F.col("n0")).alias("predicted"))
    met = [F.col("constraint_id") == F.col("_lid"), F.col("node") == F.col("_leaf")]
    if "version" in keys:
        met.append(F.col("batch") == F.col("_lversion"))
    out = placed.join(F.broadcast(leaves) if small else leaves, met, "left")
    return out.withColumn("predicted", F.coalesce("predicted", F.lit(False))).drop(*leaf_names.values())


def prequential_scores(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    batch: Column,
    batches: Sequence[int],
    templates: Sequence[str] = tuple(TEMPLATES),
    settings: Settings = Settings(),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Test, then train: tp, fp, fn and F1 per constraint of trees that predict each batch from the ones before.

    ``batch`` numbers the batches of the log; ``batches`` lists the numbers.
    """
    rows = Binned(log.withColumn("batch", batch.cast("int")), pairs, templates, keep=["batch"], complete=complete, hot_rows=hot_rows)
    bound = len(pairs) * len(templates) * len(batches) << settings.max_depth
    trees = grow(rows, settings, versions=sorted(batches), bound=bound)
    scored = predicted(trees.rows, trees, small=bound <= BROADCAST_RULES)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counted = scored.groupBy("constraint_id").agg(
        F.sum(F.when(F.col("predicted"), F.col("n1")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("predicted"), F.col("n0")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("predicted"), 0).otherwise(F.col("n1"))).alias("fn"),
    )
    return named(counted, pairs).withColumn("f1", ratio3(2 * tp, 2 * tp + fp + fn))


def learn(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    settings: Settings = Settings(),
    *,
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """template, first, second, node, steps, n1, n0 of all leaves of all constraints."""
    rows = Binned(log, pairs, templates, complete=complete, hot_rows=hot_rows)
    trees = grow(rows, settings, bound=len(pairs) * len(templates))
    return named(trees.leaves(), pairs)
