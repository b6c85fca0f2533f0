"""The seven DECLARE templates and their negations, judged per activation.

Everything a template needs to know about a pair (first, second) at one event is the position
of the nearest earlier and later occurrence of either activity. So each event gets these
positions for all activities in play -- one shuffle by case, two sorts -- and only then is it
expanded to the pairs it takes part in. The expansion is narrow: no shuffle carries
events x pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.candidates import PASS_WIDTH
from caseweave.operators.eventlog import ORDER
from caseweave.plans.ordered import keyed_scan
from caseweave.session import freeze

FULFILLED, VIOLATED, PENDING = "fulfilled", "violated", "pending"

#: Partner tables above this many pairs are not forced into a broadcast.
BROADCAST_PAIRS = 250_000


class Marks:
    """Where things are, seen from one activation. ``own`` is its activity, ``other`` the target.

    ``here``, ``trace_end``, ``own_before``, ``own_after``, ``other_before`` and ``other_after``
    are positions. The same names with ``_at``, and ``next_at``, are structs of position, time
    and sequence number; they exist only where times are asked for.
    """

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


def _adjacent(later: Column, earlier: Column) -> Column:
    return F.coalesce(later == earlier + 1, F.lit(False))


@dataclass(frozen=True)
class Template:
    """``activation`` says which activity of the pair triggers the check. ``undecided`` means
    that later events could still change the verdict; ``resolved`` is the event that
    settles it (trace end if none does)."""

    name: str
    activation: str
    fulfilled: Callable[[Marks], Column]
    undecided: Callable[[Marks], Column]
    resolved: Callable[[Marks], Column]

    @property
    def key(self) -> str:
        return self.name.lower().replace(" ", "_")


def _never(_: Marks) -> Column:
    return F.lit(False)


TEMPLATES: dict[str, Template] = {
    t.name: t
    for t in (
        Template(
            "Response",
            "first",
            lambda m: m.other_after.isNotNull(),
            lambda m: m.other_after.isNull(),
            lambda m: F.coalesce(m.other_after_at, m.trace_end_at),
        ),
        Template(
            "Alternate Response",
            "first",
            lambda m: m.other_after.isNotNull() & (m.own_after.isNull() | (m.other_after < m.own_after)),
            lambda m: m.other_after.isNull() & m.own_after.isNull(),
            lambda m: F.coalesce(F.least(m.other_after_at, m.own_after_at), m.trace_end_at),
        ),
        Template(
            "Chain Response",
            "first",
            lambda m: _adjacent(m.other_after, m.here),
            lambda m: m.here == m.trace_end,
            lambda m: F.coalesce(m.next_at, m.trace_end_at),
        ),
        Template("Precedence", "second", lambda m: m.other_before.isNotNull(), _never, lambda m: m.here_at),
        Template(
            "Alternate Precedence",
            "second",
            lambda m: m.other_before.isNotNull() & (m.own_before.isNull() | (m.other_before > m.own_before)),
            _never,
            lambda m: m.here_at,
        ),
        Template("Chain Precedence", "second", lambda m: _adjacent(m.here, m.other_before), _never, lambda m: m.here_at),
        Template(
            "Responded Existence",
            "first",
            lambda m: m.other_before.isNotNull() | m.other_after.isNotNull(),
            lambda m: m.other_before.isNull() & m.other_after.isNull(),
            lambda m: F.when(m.other_before.isNotNull(), m.here_at).otherwise(F.coalesce(m.other_after_at, m.trace_end_at)),
        ),
    )
}


def negated_name(template: Column) -> Column:
    return F.concat(F.lit("Not "), template)


def expand_templates(df: DataFrame, templates: Sequence[str] = tuple(TEMPLATES)) -> DataFrame:
    """One row per (row, template name)."""
    return df.withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates])))


def _partners(log: DataFrame, pairs: Sequence[tuple[str, str]], slots: dict[str, int]) -> DataFrame:
    """activity -> its partners whose slot is in ``slots``, with the number of the pair in which
    it comes first and of the pair in which it comes second (NULL if that is no candidate)."""
    roles: dict[tuple[str, str], list[int | None]] = {}
    for number, (first, second) in enumerate(pairs):
        roles.setdefault((first, second), [None, None])[0] = number
        roles.setdefault((second, first), [None, None])[1] = number
    table: dict[str, list] = {}
    for (own, other), (pair_as_first, pair_as_second) in sorted(roles.items()):
        if other in slots:
            table.setdefault(own, []).append((other, slots[other], slots.get(own), pair_as_first, pair_as_second))
    schema = (
        "activity string, partners array<struct<other:string,slot:int,own_slot:int,"
        "pair_as_first:int,pair_as_second:int>>"
    )
    return log.sparkSession.createDataFrame(list(table.items()), schema)


def pair_context(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    *,
    keep: Sequence[str] = (),
    times: bool = False,
    complete: bool = False,
    frozen: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per event and candidate partner, with everything the templates look at.

    ``keep`` names log columns to carry along (``attrs`` for learning). ``times`` puts
    ``ts, seq`` into the marks, for operators that order verdicts by when they became known.
    ``complete`` says that every trace of the log is closed, tagged or not. ``frozen`` writes
    the scanned events, before they meet their partners, for operators that read them often.
    """
    scans = scanned_events(log, pairs, keep=keep, times=times, complete=complete, frozen=frozen, hot_rows=hot_rows)
    return with_partners(scans, pairs)


def scanned_events(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    *,
    keep: Sequence[str] = (),
    times: bool = False,
    complete: bool = False,
    frozen: bool = False,
    hot_rows: int | None = None,
) -> list[tuple[list[str], DataFrame]]:
    """The first half of ``pair_context``: activities looked for, and one row per event."""
    names = sorted({name for pair in pairs for name in pair})
    columns = list(dict.fromkeys(["case_id", "activity", *ORDER, *keep]))
    source = log.select(*columns)
    ends_before, ends_after = {}, {}
    if not complete:
        source = log.select(*columns, F.coalesce("is_end", F.lit(False)).cast("int").alias("_end"))
        ends_before = {"_end_before": ("max", F.col("_end"))}
        ends_after = {"_end_after": ("max", F.col("_end"))}
    closed = F.lit(True) if complete else F.greatest("_end", "_end_before", "_end_after") == 1
    single_pass = len(names) <= PASS_WIDTH
    pos, at = F.col("pos"), F.struct("pos", *ORDER)

    scans = []
    for start in range(0, max(len(names), 1), PASS_WIDTH):
        chunk = names[start : start + PASS_WIDTH]
        is_y = [F.col("activity") == y for y in chunk]
        timed_after = {}
        if times:
            timed_after = {"_last_at": ("max", at), **{f"_t{i}": ("min", F.when(c, at)) for i, c in enumerate(is_y)}}
        scanned = keyed_scan(
            source,
            ["case_id"],
            ORDER,
            following={"next_at": at} if times else {},
            before={**ends_before, **{f"_p{i}": ("max", F.when(c, pos)) for i, c in enumerate(is_y)}},
            after={
                **ends_after,
                "_last": ("max", pos),
                **{f"_n{i}": ("min", F.when(c, pos)) for i, c in enumerate(is_y)},
                **timed_after,
            },
            hot_rows=hot_rows,
        )
        places = range(len(chunk))
        context = scanned.select(
            *columns,
            "pos",
            closed.alias("closed"),
            pos.alias("here"),
            F.coalesce("_last", pos).alias("trace_end"),
            F.array(*[F.col(f"_p{i}") for i in places]).alias("_before"),
            F.array(*[F.col(f"_n{i}") for i in places]).alias("_after"),
            *(
                [
                    "next_at",
                    at.alias("here_at"),
                    F.coalesce("_last_at", at).alias("trace_end_at"),
                    F.array(*[F.col(f"_t{i}") for i in places]).alias("_after_at"),
                ]
                if times
                else []
            ),
        )
        if not single_pass:
            # The activation's own activity may lie in another chunk.
            context = keyed_scan(
                context,
                ["case_id", "activity"],
                ["pos"],
                previous={"own_before": pos},
                following={"own_after": pos, **({"own_after_at": at} if times else {})},
                position="_nth",
                hot_rows=hot_rows,
            ).drop("_nth")
        if frozen:
            context = freeze(context, "context")
        scans.append((chunk, context))
    return scans


def with_partners(scans: Sequence[tuple[list[str], DataFrame]], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The second half: one row per event and candidate partner."""
    single_pass = len(scans) == 1
    parts = []
    for chunk, context in scans:
        times = "_after_at" in context.columns
        partners = _partners(context, pairs, {y: i for i, y in enumerate(chunk)})
        if len(pairs) <= BROADCAST_PAIRS:
            partners = F.broadcast(partners)
        expanded = context.join(partners, "activity").withColumn("_q", F.explode("partners"))
        own, slot = F.col("_q.own_slot"), F.col("_q.slot")
        if single_pass:
            expanded = expanded.withColumn("own_before", F.get("_before", own)).withColumn(
                "own_after", F.get("_after", own)
            )
            if times:
                expanded = expanded.withColumn("own_after_at", F.get("_after_at", own))
        expanded = (
            expanded.withColumn("other", F.col("_q.other"))
            .withColumn("pair_as_first", F.col("_q.pair_as_first"))
            .withColumn("pair_as_second", F.col("_q.pair_as_second"))
            .withColumn("other_before", F.get("_before", slot))
            .withColumn("other_after", F.get("_after", slot))
        )
        if times:
            expanded = expanded.withColumn("other_after_at", F.get("_after_at", slot))
        parts.append(expanded.drop("partners", "_q", "_before", "_after", "_after_at"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _applies(template: Template) -> Column:
    return _pair_number(template).isNotNull()


def _pair_number(template: Template) -> Column:
    return F.col(f"pair_as_{template.activation}")


def _verdict(template: Template) -> Column:
    return (
        F.when(template.fulfilled(Marks()), F.lit(FULFILLED))
        .when(template.undecided(Marks()) & ~F.col("closed"), F.lit(PENDING))
        .otherwise(F.lit(VIOLATED))
    )


def verdict_bits(templates: Sequence[str]) -> Column:
    """All verdicts of a row of ``pair_context`` in one number: two bits per template, decided and fulfilled."""
    bits = F.lit(0)
    for i, name in enumerate(templates):
        template = TEMPLATES[name]
        undecided = template.undecided(Marks()) & ~F.col("closed")
        one = F.when(template.fulfilled(Marks()), 3 << (2 * i)).when(undecided, 0).otherwise(1 << (2 * i))
        bits = bits + F.when(_applies(template), one).otherwise(0)
    return bits


def _pair_columns(template: Template) -> list[Column]:
    own, other = F.col("activity"), F.col("other")
    first, second = (own, other) if template.activation == "first" else (other, own)
    return [F.lit(template.name).alias("template"), first.alias("first"), second.alias("second")]


def verdicts(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    keep: Sequence[str] = (),
    times: bool = False,
    numbered: bool = False,
    complete: bool = False,
    frozen: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per activation: constraint, case, position, verdict (and ``resolved_ts``,
    ``resolved_seq`` with ``times``: when the verdict was known). ``numbered`` replaces the
    three constraint columns by ``constraint_id`` of ``constraint_table``."""
    context = pair_context(log, pairs, keep=keep, times=times, complete=complete, frozen=frozen, hot_rows=hot_rows)
    rows = []
    for name in templates:
        template = TEMPLATES[name]
        number = F.lit(list(TEMPLATES).index(name) * len(pairs)) + _pair_number(template)
        constraint = [number.alias("constraint_id")] if numbered else _pair_columns(template)
        fields = [*constraint, _verdict(template).alias("verdict")]
        if times:
            mark = template.resolved(Marks())
            fields += [mark["ts"].alias("resolved_ts"), mark["seq"].alias("resolved_seq")]
        rows.append(F.when(_applies(template), F.struct(*fields)))
    found = context.withColumn("_v", F.explode(F.array(*rows))).filter(F.col("_v").isNotNull())
    extra = ["ts", "seq", *keep] if times else list(keep)
    return found.select("_v.*", "case_id", "pos", *dict.fromkeys(extra))


def constraint_table(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``constraint_id`` -> template, first, second, for ``verdicts(numbered=True)``."""
    numbered = spark.createDataFrame(
        [(i, first, second) for i, (first, second) in enumerate(pairs)], "_pair int, first string, second string"
    )
    names = F.array(*[F.lit(t) for t in TEMPLATES])
    return numbered.select("*", F.posexplode(names).alias("_t", "template")).select(
        (F.col("_t") * len(pairs) + F.col("_pair")).alias("constraint_id"), "template", "first", "second"
    )


def constraint_counts(
    log: DataFrame,
    pairs: Sequence[tuple[str, str]],
    templates: Sequence[str] = tuple(TEMPLATES),
    *,
    group: Sequence[str] = (),
    complete: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Activations, fulfilments and pending activations per constraint.

    The seven verdicts of a pair are counted side by side and turned into rows afterwards, so
    the expanded events are aggregated in place before the only shuffle of counts. ``group``
    adds log columns to the key.
    """
    context = pair_context(log, pairs, keep=group, complete=complete, hot_rows=hot_rows)
    sums = []
    for name in templates:
        template, verdict = TEMPLATES[name], _verdict(TEMPLATES[name])
        sums += [
            F.count_if(_applies(template)).alias(f"_a_{template.key}"),
            F.count_if(_applies(template) & (verdict == FULFILLED)).alias(f"_f_{template.key}"),
            F.count_if(_applies(template) & (verdict == PENDING)).alias(f"_u_{template.key}"),
        ]
    counted = context.groupBy(*group, "activity", "other").agg(*sums)
    rows = F.array(
        *[
            F.struct(
                *_pair_columns(TEMPLATES[name]),
                F.col(f"_a_{TEMPLATES[name].key}").alias("n_all"),
                F.col(f"_f_{TEMPLATES[name].key}").alias("n_fulfilled"),
                F.col(f"_u_{TEMPLATES[name].key}").alias("n_pending"),
            )
            for name in templates
        ]
    )
    return (
        counted.select(*group, F.inline(rows))
        .filter(F.col("n_all") > 0)
        .withColumn("n_activations", F.col("n_all") - F.col("n_pending"))
        .drop("n_all")
    )


def with_negations(df: DataFrame, flips: dict[str, Column]) -> DataFrame:
    """Each row and its negation: ``Not X`` with the columns in ``flips`` replaced."""
    kept = [c for c in df.columns if c != "template" and c not in flips]
    plain = F.struct(F.col("template").alias("template"), *[F.col(c) for c in flips])
    negated = F.struct(negated_name(F.col("template")).alias("template"), *[v.alias(c) for c, v in flips.items()])
    out = df.select(*kept, F.inline(F.array(plain, negated)))
    return out.select(*df.columns)


def negate_verdicts(df: DataFrame) -> DataFrame:
    """Verdict rows with those of the negated templates; pending stays pending."""
    verdict = F.col("verdict")
    flipped = F.when(verdict == FULFILLED, VIOLATED).when(verdict == VIOLATED, FULFILLED).otherwise(verdict)
    return with_negations(df, {"verdict": flipped})
