"""Embedding groups against all pairs, and the recall of the cells."""

import math

import numpy as np

from spendgrid.llm.embedding_dedup import embedding_groups, spherical_kmeans, unit

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell string, vector string"


def brute(rows, threshold=0.98):
    good = []
    for i, (_, v, label) in enumerate(rows):
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(ok)
    near = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = unit(np.array([np.float32(a[1]), np.float32(b[1])], dtype=float))
                if x @ y >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (vid, _, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vid, len(near[i]), component, vid == component))
    return sorted(out, key=str)


def rows_of(n=150, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [(i, base[i].tolist(), int(rng.integers(3))) for i in range(n)]
    for i in range(n, 2 * n):  # near copies, some just off the threshold
        j = int(rng.integers(n))
        noise = rng.normal(size=dim)
        noise *= rng.uniform(0.05, 0.3) * np.linalg.norm(base[j]) / np.linalg.norm(noise)
        rows.append((i, (base[j] + noise).tolist(), rows[j][2]))
    one = rows[0][1]
    return rows + [
        (900, one, rows[0][2]), (901, one, rows[0][2]), (901, one, rows[0][2]), (902, one, None), (903, None, 1), (904, [], 1), (905, [0.0] * dim, 1),
        (906, [0.0] * dim, 1), (907, [None] + one[1:], 1), (908, [float("nan")] + one[1:], 1), (909, [float("inf")] + one[1:], 1),
        (910, one[:3], rows[0][2]), (911, one[:3], rows[0][2]), (None, one, rows[0][2]), (912, [1e30] * dim, 2), (913, [1e-30] * dim, 2),
    ]


def result(spark, rows, **k):
    df = spark.createDataFrame([(*r, "c", "v") for r in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(df, **k).collect()), key=str)


def test_one_cell_matches_all_pairs(spark):
    rows = rows_of()
    assert result(spark, rows) == brute(rows)


def test_cells_with_the_exact_bound_match_all_pairs(spark):
    rows = rows_of(seed=1)
    assert result(spark, rows, vectors_per_cell=20, deviations=math.sqrt(8)) == brute(rows)


def test_recall_of_the_default(spark):
    rows = rows_of(n=600, dim=32, seed=2)
    found = sum(r[1] for r in result(spark, rows, vectors_per_cell=100))
    links = sum(r[1] for r in brute(rows))
    assert links > 500 and 0.99 * links <= found <= links


def test_no_good_vector_and_empty_table(spark):
    assert result(spark, [(1, None, 1), (2, [0.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert result(spark, []) == []


def test_kmeans_centroids_are_units():
    x = unit(np.random.default_rng(0).normal(size=(50, 4)))
    c = spherical_kmeans(np.concatenate([x, x[:1].repeat(30, axis=0)]), 7)
    assert c.shape == (7, 4) and np.allclose(np.linalg.norm(c, axis=1), 1)
