"""Lossy counting over traces: drop the events of rarely seen cases, with bounded error.

Events are numbered through the whole log and cut into buckets of ``w = ceil(1/epsilon)``.
A tracked case has a frequency f and an error d; a new case starts with f = 1 and
d = bucket - 1 and its event is not passed on, a tracked case has f raised and its event is
passed on, and at the end of bucket b all cases with f + d <= b are forgotten.

For one case with event buckets b1 <= b2 <= ... the sum s = f + d obeys
``s_i = max(b_i, s_(i-1) + 1)``, hence ``s_i = i + max over j <= i of (b_j - j)``, and event
i is passed on exactly if an earlier event has a larger ``b_j - j``. So the whole algorithm is
one running maximum per case, given the global event numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.plans.ordered import keyed_scan, number_rows


def bucket_width(epsilon: float) -> int:
    return math.ceil(1.0 / epsilon)


def lossy_sampled(
    log: DataFrame, epsilon: float = 0.2, *, number: str | None = None, hot_rows: int | None = None
) -> DataFrame:
    """The events lossy counting passes on, with their global number ``n`` and ``bucket``.

    ``number`` names a column that already holds the global event number.
    """
    numbered = log.withColumn("n", F.col(number)) if number else number_rows(log, ["ts", "seq", "case_id"])
    bucketed = numbered.withColumn("bucket", F.ceil(F.col("n") / bucket_width(epsilon)).cast("long"))
    slack = F.col("bucket") - F.col("_nth")
    scanned = keyed_scan(
        bucketed, ["case_id"], ["n"], before={"_best": ("max", slack)}, position="_nth", hot_rows=hot_rows
    )
    return scanned.filter(F.col("_best") > slack).drop("_best", "_nth")


def sample(log: DataFrame, sampling: str = "none", epsilon: float = 0.2) -> DataFrame:
    """``none`` keeps every event (default), ``lossy`` applies lossy counting."""
    if sampling == "none":
        return log
    if sampling == "lossy":
        return lossy_sampled(log, epsilon).select(*log.columns)
    raise ValueError(f"unknown sampling {sampling!r}")
