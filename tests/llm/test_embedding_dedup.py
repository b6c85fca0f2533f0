import math

import numpy as np
import pytest

from caseweave.llm import embedding_dedup as e


def plain(rows, threshold):
    """Links by definition. Rows of one id are one vertex."""
    good = {(i, lab, tuple(v)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    good = sorted(good, key=str)
    parent, n = {}, {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a in good:
        for b in good:
            if a is not b and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    n[a[0]] = n.get(a[0], 0) + 1
                    parent[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    return sorted(str((i, n.get(i, 0) if i is not None else 0, find(i) if i is not None else None, i is not None and find(i) == i)) for i, _, _ in rows)


@pytest.mark.parametrize("tile", [2048, 16])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(e, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows, base = [], rng.normal(size=(25, 24))
    for i in range(220):
        v = base[i % 25] + rng.normal(size=24) * rng.choice([0, 0.1, 0.2, 0.3, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    rows += [(300, rows[0][1], 1), (301, [2 * x for x in rows[0][1]], 1), (302, None, 1), (303, [0.0] * 24, 1), (304, rows[0][1], None)]
    rows += [(305, [float("nan")] + rows[0][1][1:], 1), (306, [None] + rows[0][1][1:], 1), (None, rows[0][1], 1), (307, rows[0][1][:5], 1), (308, rows[0][1][:5], 1)]
    rows += [(300, rows[0][1], 1), (309, [], 1), (310, [float("inf")] * 24, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, rep int")
    got = sorted(str(tuple(r)) for r in e.links(df, threshold=0.93).collect())
    assert got == plain(rows, 0.93)


def test_bounds_give_up_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 20))
    x = np.concatenate([x, x + 0.25 * rng.normal(size=x.shape)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    for threshold in (0.2, 0.8, 0.95):
        left, right = e.close_pairs(unit @ axes, unit @ axes, x, x, threshold, True)
        want = {(i, j) for i in range(120) for j in range(i + 1, 120) if e.cosines(x[[i]], x[[j]])[0] >= threshold}
        assert set(zip(left.tolist(), right.tolist())) == want


def test_empty_table(spark):
    assert e.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
