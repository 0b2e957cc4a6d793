"""Planted links between vectors against brute force, and vectors of extreme size."""

import numpy as np

from corpuscle.llm import embeddings


def test_recall_of_planted_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.3, (150, 1))
    v = np.concatenate((base, near, rng.normal(size=(60, 32))))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    true = {(i, j) for i, j in zip(*np.nonzero(cos >= 0.95), strict=True) if i < j}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    got = {r.id: r for r in embeddings.near_duplicates(rows).collect()}
    want = np.zeros(len(v), int)
    for i, j in true:
        want[i] += 1
        want[j] += 1
    found = np.array([got[i].n_links for i in range(len(v))])
    assert len(true) > 60 and (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_tiny_and_huge_components(spark):
    given = [(0, [1e-200, 0.0]), (1, [1e200, 1e199]), (2, [0.0, 1e200]), (3, [5e-324, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0])]
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(spark.createDataFrame(given, "vec_id int, embedding array<double>")).collect()}
    assert got[2] == (0, 2) and all(got[k] == (0, k) for k in (4, 5, 6, 7))
    assert {got[k][1] for k in (0, 1, 3)} == {0}
