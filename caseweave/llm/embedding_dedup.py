"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are compared only within their label. They are scaled to length one and turned onto
the principal axes of the corpus, so the first coordinates carry most of a product. In a
tile, products are accumulated block by block; by Cauchy-Schwarz the rest is at most the
product of the two suffix norms, and a pair is given up as soon as it cannot reach the
threshold. What remains is decided by the cosine of the given vectors in double precision.

1. Equal vectors of a label become one row with a multiplicity, however many there are.
2. The covariance is summed by Spark over all vectors (dimension squared numbers per task).
3. Each label is dealt into tiles of about ``TILE`` vectors by a hash; a pair of tiles is a
   task. Every vector goes to as many tasks as its label has tiles. A tile pair returns
   link counts per vector and a forest of links, never the pairs.
4. Components of the forests are the components of all links.

Vectors that are null, empty, zero, or hold a null or a non-finite number link with nothing,
as do vectors without a label or an id, and vectors of different lengths. Rows that repeat id,
label and vector are one vector; an id with several vectors is one vertex that counts the
links of each. A row without an id has n_links 0, no component and kept false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut
from caseweave.llm.components import components

TILE = 2048
#: Leading coordinates per step of the comparison.
STEP = 8
#: Pairs this near to being given up or linked by rounding alone are decided by the given vectors.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (array of double) of the vectors that can link."""
    rows = vectors.select(
        vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"),
        vectors[vector_col].cast("array<double>").alias("v"),
    )
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    nonzero = F.exists("v", lambda x: x != 0)
    # Squares of the largest or smallest numbers leave the range of doubles, so the scale is taken out first.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & nonzero, F.lit(False))).select(
        "id", "label", F.when((top > 1e100) | (top < 1e-100), F.transform("v", lambda x: x / top)).otherwise(F.col("v")).alias("v")
    )


def principal_axes(groups: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the principal axes (columns, largest variance first) of the unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, unit in _by_length(batch.column("v").to_pylist()):
                sums[size] = sums.get(size, 0) + unit.T @ unit
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))],
            ["size", "products"],
        )

    parts = groups.select("v").mapInArrow(run, "size int, products array<double>")
    # Sums of arrays, place by place: each place is a row that is summed before the shuffle.
    places = parts.select("size", F.posexplode("products").alias("place", "x")).groupBy("size", "place").agg(F.sum("x").alias("x"))
    axes = {}
    found = places.toPandas()
    for size, rows in found.groupby("size"):
        covariance = np.zeros(size * size)
        covariance[rows["place"].to_numpy()] = rows["x"].to_numpy()
        values, columns = np.linalg.eigh(covariance.reshape(size, size))
        axes[int(size)] = columns[:, np.argsort(-values, kind="stable")]
    return axes


def _by_length(vectors: list[list[float]]) -> Iterator[tuple[int, np.ndarray]]:
    for size in sorted({len(v) for v in vectors}):
        x = np.array([v for v in vectors if len(v) == size])
        yield size, x / np.linalg.norm(x, axis=1, keepdims=True)


def close_pairs(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` with a cosine of ``threshold`` or more; of equal sides each pair once.

    ``a`` and ``b`` are unit vectors on principal axes, ``raw_a`` and ``raw_b`` the same rows as given.
    """
    size = a.shape[1]
    rest_a = np.sqrt(np.maximum(np.cumsum((a**2)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b**2)[:, ::-1], axis=1)[:, ::-1], 0))
    suffix = lambda rest, at: rest[:, at] if at < size else np.zeros(len(rest))
    at = min(STEP, size)
    partial = a[:, :at] @ b[:, :at].T
    bound = partial + np.outer(suffix(rest_a, at), suffix(rest_b, at))
    left, right = np.nonzero(bound >= threshold - SLACK)
    if same:
        left, right = left[left < right], right[left < right]
    partial = partial[left, right]
    while at < size and len(left):
        until = min(at + STEP, size)
        partial = partial + np.einsum("ij,ij->i", a[left, at:until], b[right, at:until])
        at = until
        alive = partial + suffix(rest_a, at)[left] * suffix(rest_b, at)[right] >= threshold - SLACK
        left, right, partial = left[alive], right[alive], partial[alive]
    sure = cosines(raw_a[left], raw_b[right]) >= threshold
    return left[sure], right[sure]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected to."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def tile_result(pdf: pd.DataFrame, axes: dict[int, np.ndarray], threshold: float) -> pd.DataFrame:
    """Link counts and forest of one tile pair: columns id, n (linked vectors, copies counted), root."""
    key = pdf.iloc[0]
    pdf = pdf.sort_values("id", kind="stable")
    raw = np.array(pdf["v"].tolist(), dtype=float)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    turned = unit @ axes[raw.shape[1]]
    ids, many, own = pdf["id"].to_numpy(), pdf["many"].to_numpy(), pdf["own"].to_numpy()
    n = np.zeros(len(ids), np.int64)
    lefts, rights = [], []
    same = key["x"] == key["y"]
    one = np.flatnonzero(own == key["x"])
    two = one if same else np.flatnonzero(own == key["y"])
    side = 512
    for i in range(0, len(one), side):
        for j in range(i if same else 0, len(two), side):
            p, q = one[i : i + side], two[j : j + side]
            left, right = close_pairs(turned[p], turned[q], raw[p], raw[q], threshold, same and i == j)
            lefts.append(p[left])
            rights.append(q[right])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    np.add.at(n, left, many[right])
    np.add.at(n, right, many[left])
    root = ids[forest(len(ids), left, right)]
    hit = n > 0
    return pd.DataFrame({"id": ids[hit], "n": n[hit], "root": root[hit]})


def links(
    vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col).distinct()
    same_vector = ["label", "v"]
    # Equal vectors together; the smallest id stands for them. Written, since all later steps start here.
    groups = cut(rows.groupBy(*same_vector).agg(F.min("id").alias("rep"), F.count("*").alias("many")))
    axes = spark.sparkContext.broadcast(principal_axes(groups))
    tiles = groups.groupBy("label", F.size("v").alias("size")).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    sized = groups.withColumn("size", F.size("v")).join(tiles, ["label", "size"])
    own = sized.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = other.select(
        "label", "size", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own",
        F.col("rep").alias("id"), "many", "v",
    )
    found = cut(dealt.groupBy("label", "size", "x", "y").applyInPandas(
        lambda pdf: tile_result(pdf, axes.value, threshold), "id long, n long, root long"
    ))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    placed = rows.join(groups, same_vector).select("id", "rep", (F.col("many") - 1).alias("copies"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(placed.select("id", "rep"))
    component = components(edges)
    per_id = (
        placed.join(counts.select(F.col("id").alias("rep"), "n"), "rep", "left")
        .groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies")).alias("n_links"))
    )
    info = per_id.join(component, "id", "left")
    every = vectors.select(vectors[id_col].cast("long").alias("vec_id"))
    joined = every.join(info, every["vec_id"] == info["id"], "left")
    own_component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_component.alias("component_id"),
        F.coalesce(F.col("vec_id") == own_component, F.lit(False)).alias("kept"),
    )
