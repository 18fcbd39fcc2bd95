import numpy as np
import pytest

from loomwork.operators import neighbours


def table(spark, matrix, ids=None):
    ids = ids if ids is not None else range(len(matrix))
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix, strict=True)], "vec_id long, embedding array<float>")


def brute(matrix, asked, k, ids=None):
    ids = np.arange(len(matrix)) if ids is None else np.array(ids)
    e = np.asarray(matrix, np.float32).astype(float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    out = set()
    for q in asked:
        cosine = np.round(e @ e[q], 6)
        order = [v for v in np.lexsort((ids, -cosine)) if v != q][:k]
        out |= {(int(ids[q]), int(ids[v]), r + 1) for r, v in enumerate(order)}
    return out


def found(df):
    return {(r.query_id, r.vec_id, r.rank) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    return np.concatenate([m + 0.35 * rng.normal(size=(60, 16)) for m in middles])


def test_exact_way_equals_brute_force_and_fast_way_recalls(spark, clustered):
    asked = list(range(0, len(clustered), 20))
    vectors = table(spark, clustered)
    queries = vectors.where("vec_id % 20 = 0")
    want = brute(clustered, asked, 5)
    assert found(neighbours.nearest(vectors, queries, 5)) == want
    fast = {x[:2] for x in found(neighbours.nearest(vectors, queries, 5, exact=False, cells=24))}
    assert len(fast & {x[:2] for x in want}) >= 0.9 * len(want)
    few = [p for p in (neighbours.nearest(vectors, queries, 5)._jdf.queryExecution().executedPlan().toString(),)]
    assert "BroadcastNestedLoopJoin" not in few[0] and "CartesianProduct" not in few[0]


def test_unclustered_vectors_copies_and_small_blocks(spark, monkeypatch):
    """Random vectors, where the bound leaves nearly all cells; a third of the rows are copies; blocks smaller than cells and queries."""
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(150, 8))
    matrix[50:100] = matrix[50]
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    vectors = table(spark, matrix)
    assert found(neighbours.nearest(vectors, vectors, 3)) == brute(matrix, range(150), 3)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [2.0, 0.1]), (6, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id, r.rank) for r in neighbours.nearest(vectors, vectors, 5).collect()}
    assert got == {(1, 5, 1), (1, 6, 2), (5, 1, 1), (5, 6, 2), (6, 5, 2), (6, 1, 1)} or got == {(1, 5, 1), (1, 6, 2), (5, 1, 1), (5, 6, 2), (6, 5, 1), (6, 1, 2)}
    assert neighbours.nearest(vectors.where("vec_id = 2"), vectors, 5).count() == 0
    assert neighbours.nearest(vectors, vectors.where("vec_id = 2"), 5).count() == 0
