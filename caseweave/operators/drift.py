"""Adaptive windows over errors: where has a prediction become worse, or better, than it was?

A window holds buckets (batch, n, errors), one per batch, and is an additive state: a new batch
adds one bucket. After each batch every cut of the window into an older and a newer part is
tested: the error rates of the two parts differ more than chance allows if

    |e_old - e_new| > sqrt(2/m * v * ln(2/d)) + 2/(3m) * ln(2/d),

with m the harmonic size 1 / (1/n_old + 1/n_new), v = e (1 - e) the variance over the whole window
and d = delta / ln(n). If a cut passes, the part before the one that passes by most (the latest of
equal ones) is dropped, and the new part is the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA = 0.002
BUCKET = "struct<batch:int,n:long,errors:long>"


def _sum(buckets: Column, name: str) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + b[name])


def excess(n_old: Column, e_old: Column, n_new: Column, e_new: Column, delta: float = DELTA) -> Column:
    """By how much the difference of the two error rates exceeds what chance allows, to 9 places."""
    n, m = n_old + n_new, 1 / (1 / n_old + 1 / n_new)
    rate = (e_old + e_new) / n
    log = F.log(2 * F.greatest(F.log(n.cast("double")), F.lit(1.0)) / F.lit(delta))
    allowed = F.sqrt(2 / m * rate * (1 - rate) * log) + 2 / (3 * m) * log
    return F.round(F.abs(e_old / n_old - e_new / n_new) - allowed, 9)


def best_cut(window: Column, delta: float = DELTA) -> Column:
    """struct(by, at): the cut before bucket ``at`` (from 1) that passes by most; NULL in a window that holds."""
    def cut(at: Column) -> Column:
        old, new = F.slice(window, 1, at), F.slice(window, at + 1, F.size(window))
        by = excess(_sum(old, "n"), _sum(old, "errors"), _sum(new, "n"), _sum(new, "errors"), delta)
        return F.struct(by.alias("by"), at.alias("at"))

    cuts = F.when(F.size(window) > 1, F.transform(F.sequence(F.lit(1), F.size(window) - 1), cut))
    return F.array_max(F.filter(cuts, lambda c: c["by"] > 0))


def after_drift(window: Column, delta: float = DELTA) -> Column:
    """The window without the part that a drift has made useless."""
    return F.aggregate(
        F.array(F.lit(0)), F.struct(window.alias("w")),
        lambda acc, _: F.struct(F.slice(acc["w"], F.coalesce(best_cut(acc["w"], delta)["at"], F.lit(0)) + 1, F.size(acc["w"])).alias("w")),
        lambda acc: acc["w"],
    )


def error_windows(buckets: DataFrame, keys: Sequence[str], delta: float = DELTA) -> DataFrame:
    """keys, batch, n, errors, window_start, window_n, window_errors, drift: the windows after each batch.

    ``buckets`` has keys, batch, n (above 0) and errors, one row per key and batch. A key has as
    many buckets as there are batches, so a fold over them is a small array.
    """
    ordered = buckets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("batch").cast("int").alias("batch"), F.col("n").cast("long").alias("n"), F.col("errors").cast("long").alias("errors")))).alias("_all")
    )
    out = "struct<batch:int,n:long,errors:long,window_start:int,window_n:long,window_errors:long,drift:boolean>"
    start = F.struct(F.array().cast(f"array<{BUCKET}>").alias("window"), F.array().cast(f"array<{out}>").alias("seen"))

    def step(state: Column, bucket: Column) -> Column:
        grown = F.array_append(state["window"], bucket)
        kept = after_drift(grown, delta)
        row = F.struct(
            bucket["batch"].alias("batch"), bucket["n"].alias("n"), bucket["errors"].alias("errors"),
            F.get(kept, F.lit(0))["batch"].alias("window_start"), _sum(kept, "n").alias("window_n"),
            _sum(kept, "errors").alias("window_errors"), (F.size(kept) < F.size(grown)).alias("drift"),
        )
        return F.struct(kept.alias("window"), F.array_append(state["seen"], row).alias("seen"))

    folded = F.aggregate("_all", start, step, lambda state: state["seen"])
    return ordered.select(*keys, F.inline(folded))
