"""Ordered computations that never put one unbounded group into one task.

A window over ``partitionBy(case)`` sends every event of a case to one task. That is the
plan of choice while cases are small, and a dead job when one case holds a third of the
log. Here such groups are cut into *blocks*: the rows are range-partitioned by
(group, order), so a block is a contiguous stretch of the order, windows run inside the
blocks, and one small row per (group, block) carries the state from block to block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.session import freeze

BLOCK = "_block"
SLOT = "_slot"

#: A group with more rows than this is processed in blocks.
HOT_GROUP_ROWS = 1_000_000

#: Times a stretch of ``timed_sums`` has on average, how many stretches there may be, and how many
#: sums of keys and stretches are broadcast.
STRETCH_ROWS, MOST_STRETCHES, BROADCAST_STRETCHES = 20_000, 4096, 500_000

#: Rows a task can sort or write out without spilling.
TASK_ROWS = 1_500_000

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row number below

_AGGREGATE = {"max": F.max, "min": F.min, "sum": F.sum}
_COMBINE = {
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}

Aggregates = Mapping[str, tuple[str, Column]]


def blocked_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``_block`` (contiguous stretch of the order) and ``_slot`` (place in it).

    Both depend on the sampled range bounds, so they are written down before use.
    """
    row_id = "_row_id"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn(row_id, F.monotonically_increasing_id())
    return freeze(
        numbered.withColumn(BLOCK, F.shiftright(row_id, _SLOT_BITS))
        .withColumn(SLOT, F.col(row_id).bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)))
        .drop(row_id),
        "blocks",
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by name where NULL equals NULL; the keys come from ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def number_rows(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Global 1-based row number in ``order`` without an unpartitioned window over the rows."""
    rows = blocked_rows(df, order)
    # One row per block, i.e. per shuffle partition: the only unpartitioned window, on that.
    starts = (
        rows.groupBy(BLOCK)
        .agg(F.count("*").alias("_size"))
        .select(
            BLOCK,
            F.coalesce(
                F.sum("_size").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_start"),
        )
    )
    return (
        rows.join(F.broadcast(starts), BLOCK)
        .withColumn(name, F.col("_start") + F.col(SLOT) + 1)
        .drop("_start", BLOCK, SLOT)
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums per key, for keys of any size (few keys, many rows)."""
    rows = blocked_rows(df, [*keys, *order])
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    here = [*keys, BLOCK]
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    if not keys:  # one row per block
        earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*here)
        .agg(*[F.sum(f"_v_{name}").alias(f"_b_{name}") for name in sums])
        .select(*here, *[F.sum(f"_b_{name}").over(earlier).alias(f"_c_{name}") for name in sums])
    )
    inside = Window.partitionBy(*here).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        *df.columns, *here[-1:], *[F.sum(f"_v_{name}").over(inside).alias(f"_l_{name}") for name in sums]
    )
    return _join_null_safe(local, carried, here).select(
        *df.columns,
        *[
            (F.col(f"_l_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0))).alias(name)
            for name in sums
        ],
    )


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks of at most about ``TASK_ROWS`` rows, and no fewer than the session's partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def stretch_of(times: DataFrame, at: str, parts: int | None = None) -> Column | None:
    """The number of the stretch that the timestamp ``at`` lies in, or None without any times.

    The time between the first and the last of ``times`` (one timestamp column) is cut into
    ``parts`` stretches of equal length, by default about one per ``STRETCH_ROWS`` times.
    """
    (time,) = times.columns
    span = times.agg(F.min(F.unix_micros(time)).alias("low"), F.max(F.unix_micros(time)).alias("high"), F.count("*").alias("n")).head()
    if span.low is None:
        return None
    parts = parts or max(1, min(MOST_STRETCHES, span.n // STRETCH_ROWS))
    width = -(-(span.high - span.low + 1) // parts)
    # NULL comes first, as in the order; times outside the span belong to the stretches at its ends.
    place = F.floor((F.unix_micros(at) - F.lit(span.low)) / F.lit(width)).cast("int")
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(parts - 1)), F.lit(-1))


def timed_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], times: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """``running_sums`` where ``order`` begins with a timestamp: one shuffle of the rows.

    Time is cut into stretches (``stretch_of``). Sums per key and stretch are counted in place and
    carried on; windows run inside the stretches. As the stretch of a row depends on nothing but
    the row, no row needs to be written. If a stretch of a key has more than ``hot_rows`` rows,
    blocks are taken instead.
    """
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    place = stretch_of(times, order[0])
    if place is None:
        return running_sums(df, keys, order, sums)
    rows = df.withColumn(SLOT, place)
    here = [*keys, SLOT]
    totals = freeze(rows.groupBy(*here).agg(F.count("*").alias("_rows"), *[F.sum(v).alias(f"_b_{name}") for name, v in sums.items()]), "stretches")
    most, found, size = totals.agg(F.max("_rows"), F.count("*"), F.sum("_rows")).head()
    if (most or 0) > limit:
        return running_sums(df, keys, order, sums)
    if size and size > TASK_ROWS:  # tasks that sort in memory, whatever the session's number of partitions
        # Rows made from one event mostly share its stretch. Dealt by that alone they stay side by
        # side and compress well; but then a stretch of all keys has to fit a task.
        widest = totals.groupBy(SLOT).agg(F.sum("_rows").alias("n")).agg(F.max("n")).head()[0]
        rows = rows.repartition(tasks_for(rows, size), *([SLOT] if widest <= TASK_ROWS else here))
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*here, *[F.coalesce(F.sum(f"_b_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}") for name in sums])
    inside = Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*df.columns, SLOT, *[F.sum(v).over(inside).alias(f"_l_{name}") for name, v in sums.items()])
    joined = _join_null_safe(local, F.broadcast(carried) if found <= BROADCAST_STRETCHES else carried, here)
    return joined.select(*df.columns, *[(F.col(f"_l_{name}") + F.col(f"_c_{name}")).alias(name) for name in sums])


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """The keys with more than ``limit`` rows, or None. At most rows/limit of them exist."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit).select(*keys)
    hot = freeze(hot, "hot") if hot.head(1) else None
    return hot


def keyed_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    before: Aggregates | None = None,
    after: Aggregates | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    position: str = "pos",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add per-row knowledge of the other rows of its group.

    * ``position`` -- 1-based place of the row in its group
    * ``before`` / ``after`` -- name -> (``max``/``min``/``sum``, column): the aggregate over
      all earlier / later rows of the group, the row itself excluded
    * ``previous`` / ``following`` -- name -> column: its value in the adjacent row

    The columns may refer to ``position``. Groups above ``hot_rows`` take the blocked path.
    """
    specs = (before or {}, after or {}, previous or {}, following or {})
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    hot = hot_groups(df, keys, limit)
    if hot is None:
        return _scan_whole_groups(df, keys, order, specs, position)
    # NULL is a group like any other, and often the largest one of a raw log.
    hot = hot.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)])
    same = [df[k].eqNullSafe(hot[f"_hot_{i}"]) for i, k in enumerate(keys)]
    cold = _scan_whole_groups(df.join(hot, same, "left_anti"), keys, order, specs, position)
    split = _scan_blocks(df.join(hot, same, "left_semi"), keys, order, specs, position)
    return cold.unionByName(split)


def _scan_whole_groups(df, keys, order, specs, position):
    before, after, previous, following = specs
    forward = Window.partitionBy(*keys).orderBy(*order)
    backward = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    earlier = forward.rowsBetween(Window.unboundedPreceding, -1)
    later = backward.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(position, F.row_number().over(forward).cast("long"))
    out = out.select(
        "*",
        *[F.lag(value).over(forward).alias(name) for name, value in previous.items()],
        *[F.lead(value).over(forward).alias(name) for name, value in following.items()],
        *[_AGGREGATE[kind](value).over(earlier).alias(name) for name, (kind, value) in before.items()],
    )
    return out.select(
        "*", *[_AGGREGATE[kind](value).over(later).alias(name) for name, (kind, value) in after.items()]
    )


def _scan_blocks(df, keys, order, specs, position):
    before, after, previous, following = specs
    rows = blocked_rows(df, [*keys, *order])
    here = [*keys, BLOCK]
    blocks_before = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks_after = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc())
    earlier = blocks_before.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks_after.rowsBetween(Window.unboundedPreceding, -1)

    # Rows are sorted by (keys, order), so the slots of a group inside a block are consecutive.
    starts = (
        rows.groupBy(*here)
        .agg(F.count("*").alias("_size"), F.min(SLOT).alias("_first"))
        .select(*here, "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    rows = (
        _join_null_safe(rows, starts, here)
        .withColumn(position, F.col("_offset") + F.col(SLOT) - F.col("_first") + 1)
        .drop("_offset", "_first")
    )

    aggregated = [
        *[_AGGREGATE[kind](value).alias(f"_s_{name}") for name, (kind, value) in {**before, **after}.items()],
        *[F.max_by(F.struct(value.alias("v")), position).alias(f"_s_{name}") for name, value in previous.items()],
        *[F.min_by(F.struct(value.alias("v")), position).alias(f"_s_{name}") for name, value in following.items()],
    ]
    if not aggregated:
        return rows.drop(BLOCK, SLOT)
    carried = (
        rows.groupBy(*here)
        .agg(*aggregated)
        .select(
            *here,
            *[_AGGREGATE[k](f"_s_{name}").over(earlier).alias(f"_c_{name}") for name, (k, _) in before.items()],
            *[_AGGREGATE[k](f"_s_{name}").over(later).alias(f"_c_{name}") for name, (k, _) in after.items()],
            *[F.lag(f"_s_{name}").over(blocks_before).alias(f"_c_{name}") for name in previous],
            *[F.lead(f"_s_{name}").over(blocks_before).alias(f"_c_{name}") for name in following],
        )
    )

    forward = Window.partitionBy(*here).orderBy(position)
    backward = Window.partitionBy(*here).orderBy(F.col(position).desc())
    in_earlier = forward.rowsBetween(Window.unboundedPreceding, -1)
    in_later = backward.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[F.lag(F.struct(v.alias("v"))).over(forward).alias(f"_l_{name}") for name, v in previous.items()],
        *[F.lead(F.struct(v.alias("v"))).over(forward).alias(f"_l_{name}") for name, v in following.items()],
        *[_AGGREGATE[k](v).over(in_earlier).alias(f"_l_{name}") for name, (k, v) in before.items()],
        *[_AGGREGATE[k](v).over(in_later).alias(f"_l_{name}") for name, (k, v) in after.items()],
    )

    def both(name, kind):
        return _COMBINE[kind](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)

    def nearest(name):
        return F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))["v"].alias(name)

    return _join_null_safe(local, carried, here).select(
        *df.columns,
        position,
        *[nearest(name) for name in [*previous, *following]],
        *[both(name, kind) for name, (kind, _) in {**before, **after}.items()],
    )
