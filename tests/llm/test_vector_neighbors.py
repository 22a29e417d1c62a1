import math

import numpy as np
import pytest

from textquarry.llm.vector_neighbors import chi_square_quantile, leaf_order, nearest_vectors, similar_pairs


def brute(rows, k, dimensions):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = [i for i, _ in ok], np.array([v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v in ok])
    cosines = np.round(x @ x.T, 9)
    return {i: sorted(((-cosines[a, b], ids[b]) for b in range(len(ids)) if b != a))[:k] for a, i in enumerate(ids)}


def vectors(seed=0, clusters=60, dimensions=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        center = rng.standard_normal(dimensions)
        for _ in range(rng.integers(1, 12)):
            rows.append((center + 0.4 * rng.standard_normal(dimensions)) * rng.uniform(0.1, 50))
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def test_chi_square():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(chi_square_quantile(0.99, 2) - 9.2103) < 1e-3


def test_leaves_hold_every_row():
    points = np.random.default_rng(0).standard_normal((1000, 4))
    order, starts = leaf_order(points, 10)
    assert sorted(order.tolist()) == list(range(1000)) and np.diff(np.append(starts, 1000)).max() <= 10


@pytest.mark.parametrize(("least", "sample_rows"), [(-1.0, 1 << 18), (0.85, 1 << 18), (-1.0, 48)])
def test_recall_and_exactness(spark, least, sample_rows):
    rows = vectors()
    n = len(rows)
    rows += [(n + i, rows[3][1]) for i in range(12)]  # more copies than neighbours
    rows += [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 63), (5003, [float("nan")] + [1.0] * 63), (5004, [float("inf")] * 64), (5005, [None] + [1.0] * 63), (None, [1.0] * 64), (5006, [1e-200] * 64)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, vec array<double>, key string")
    want = {(q, i) for q, hits in brute(rows, 5, 64).items() for c, i in hits if -c >= least}
    found = nearest_vectors(df, min_cosine=least, cell_rows=64, leaf_rows=8, sample_rows=sample_rows).collect()
    got = {(r["vec_id"], r["neighbor_id"]) for r in found}
    assert len(got) == len(found) and len(got & want) >= 0.98 * len(want)
    exact = {(q, i): -c for q, hits in brute(rows, 10**6, 64).items() for c, i in hits}
    assert all(abs(exact[r["vec_id"], r["neighbor_id"]] - r["cosine"]) < 1e-6 for r in found)


def test_hot_copies_give_bounded_rows(spark):
    rows = [(i, [1.0] + [0.0] * 63) for i in range(400)] + [(1000 + i, v) for i, v in vectors(3, 10)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    found = nearest_vectors(df, min_cosine=0.85)
    of_copies = found.where("vec_id < 400")
    assert of_copies.count() == 2000 and of_copies.agg({"neighbor_id": "max"}).first()[0] == 5
    # each copy with the five smallest others: 6 copies all among themselves, the other 394 with five each
    assert similar_pairs(found, 0.85).where("vec_a < 400").count() == 15 + 394 * 5


def test_copies_of_other_lengths_are_one_point(spark):
    """Vectors of one direction tie, whatever their lengths, and the smaller ids come first."""
    direction = np.random.default_rng(5).standard_normal(64)
    rows = [(i, (direction * (1 + (i * 7) % 50)).tolist()) for i in range(50)]
    found = nearest_vectors(spark.createDataFrame(rows, "vec_id long, vec array<double>")).collect()
    assert {(r["vec_id"], r["neighbor_id"]) for r in found} == {(i, j) for i in range(50) for j in [x for x in range(6) if x != i][:5]}


def test_small_tables(spark):
    schema = "vec_id long, vec array<double>"
    assert nearest_vectors(spark.createDataFrame([], schema)).count() == 0
    assert nearest_vectors(spark.createDataFrame([(1, [1.0] * 64)], schema)).count() == 0
    assert nearest_vectors(spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], schema)).count() == 2
