"""Scans in tiles: bounded memory, equal vectors at equal distances, lists where they lie, exact medians."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import kernels
from vexel.operators import binary, evaluate, flat, graph, ivf


def vectors(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("metric", ["l2", "cosine", "l1"])
def test_no_matrix_of_distances_is_larger_than_the_bound(monkeypatch, metric):
    """Queries came all at once: 3,000 x 2,000 distances here, which grew with the square of the table."""
    monkeypatch.setattr(kernels, "CELLS", 1 << 16)
    seen, whole = [], kernels.pairwise
    monkeypatch.setattr(kernels, "pairwise", lambda *a: seen.append(len(a[1]) * len(a[2])) or whole(*a))
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(3000, 6)), rng.normal(size=(2000, 6))
    near = kernels.Nearest(np.arange(3000), q, 5, metric)
    near.see(x, np.arange(2000))
    got = near.found().to_pandas().groupby("query_id")["id"].apply(list)
    assert max(seen) <= 1 << 16 and len(seen) > 80
    key = -whole(metric, q[:50], x) if metric == "cosine" else whole(metric, q[:50], x)
    assert all(got[i] == np.argsort(key[i], kind="stable")[:5].tolist() for i in range(50))


def test_copies_are_ranked_by_id():
    """A matrix product gives equal vectors distances that differ in the last bits."""
    rng = np.random.default_rng(2)
    one = rng.normal(size=(40, 64))
    ids = np.arange(800)
    near = kernels.Nearest(np.arange(40), one, 20, "l2")
    for a in range(0, 800, 130):
        near.see(one[ids[a : a + 130] % 40], ids[a : a + 130])
    got = near.found().to_pandas()
    assert (got["distance"] == 0).all() and all(g["id"].tolist() == list(range(i, 800, 40)) for i, g in got.groupby("query_id"))


def test_nan_comes_last():
    near = kernels.Nearest(np.arange(1), np.zeros((1, 2)), 3, "l2")
    near.see(np.array([[np.nan, 0], [1, 0], [2, 0]]), np.arange(3))
    assert near.found().column(1).to_pylist() == [1, 2, 0]


def test_nearest_pairs_hold_what_the_radius_needs(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (300, 3))
    base = vectors(spark, x)
    asked = base.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    for most in (5, 120, 400):
        want = evaluate.radius_for(flat.range_search(base, asked, 9.0), most)
        got = evaluate.radius_for(flat.nearest_pairs(base, asked, most + 1, 9.0), most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    parts = max(base.rdd.getNumPartitions(), 1)
    assert flat.nearest_pairs(base, asked, 51, 9.0).count() <= 51 * parts


def test_lists_are_scanned_without_a_join(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    index = ivf.IvfIndex.build(vectors(spark, x), 5, rounds=0, init=x[:5], sample=False)
    asked = vectors(spark, rng.normal(size=(30, 4)), "query_id")
    probes = spark.createDataFrame([(q, (q + j) % 5) for q in range(30) for j in range(2)] + [(0, -1)], "query_id long, list_no int")
    found = index.search_preassigned(asked, probes, 4)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    q, at = np.array([r["vec"] for r in asked.orderBy("query_id").collect()]), {r["id"]: r["list_no"] for r in index.lists.collect()}
    for i in range(30):
        mine = [n for n in range(400) if at[n] in (i % 5, (i + 1) % 5)]
        want = sorted(mine, key=lambda n: (((x[n] - q[i]) ** 2).sum(), n))[:4]
        assert [r["id"] for r in found.where(F.col("query_id") == i).orderBy("rank").collect()] == want


def test_medians_are_exact_in_large_tables(spark):
    """Approximate ranks were taken for medians: off beyond some 10,000 rows."""
    x = np.random.default_rng(5).permutation(60_001) % 50_000 * 1.0
    rows = vectors(spark, np.stack([x, -x, np.ones(60_001)], axis=1))
    got = binary.medians(rows).first()["thresholds"]
    assert got == [float(np.sort(c)[30_000]) for c in (x, -x, np.ones(60_001))]


def test_words_with_the_highest_bit(spark):
    words = spark.createDataFrame([(0, -1), (1, 0), (2, -(1 << 63)), (3, None)], "id long, word long")
    found = binary.WordLists.build(words, [0]).search(words.withColumnRenamed("id", "query_id"), 3)
    assert {(r["query_id"], r["id"]): r["distance"] for r in found.collect()} == {(0, 0): 0, (0, 2): 63, (0, 1): 64, (1, 1): 0, (1, 2): 1, (1, 0): 64, (2, 2): 0, (2, 1): 1, (2, 0): 63}


def test_relinking_does_not_walk_through_all_deleted_rows(monkeypatch):
    """A deleted third hangs together, so each row had the whole shard for candidates."""
    x = np.random.default_rng(6).normal(size=(500, 16))
    layers, gone = graph.link(x, np.arange(500), 6, 24), {n for n in range(500) if n % 3 == 1}
    met, prune = [], graph.prune
    monkeypatch.setattr(graph, "prune", lambda x, i, c, most: met.append(len(c)) or prune(x, i, c, most))
    kept = graph.relink(x, layers, gone, 6)
    assert np.mean(met) < 150
    asked, alive = x[::25] + 0.01, np.array([n for n in range(500) if n not in gone])
    hits = 0
    for q in asked:
        found = {n for _, n in graph.beam(x, kept[0], q, [0], 64)[:10]}
        hits += len(found & set(alive[((x[alive] - q) ** 2).sum(1).argsort()[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(asked)
