"""Graphs, samples and joined searches that don't send vectors along with pairs, compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import flat, graph, transforms


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "id long, vec array<double>").repartition(parts)


def spied(monkeypatch):
    """Plans of the tables that the module of graphs writes, by label."""
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), write(df, label))[1])
    return plans


def test_descent_takes_distances_where_vectors_meet(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 6))
    x[::3] = np.float32(x[::3])  # some are floats exactly, some are not
    x[7] = x[5]
    plans = spied(monkeypatch)
    found = graph.nn_descent(table(spark, x), 5).toPandas()
    assert not any("zip_with" in p for _, p in plans)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.testing.assert_allclose(found["distance"], d[found["src"], found["dst"]], rtol=1e-12)
    np.fill_diagonal(d, np.inf)
    exact = {(i, j) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:5].tolist()}
    assert len(found) == 1500 and len(exact & set(zip(found["src"], found["dst"]))) >= 0.95 * 1500


@pytest.mark.parametrize("cells", [64, 1 << 21])
def test_pairs_within_the_bound_whatever_the_batches(spark, monkeypatch, cells):
    monkeypatch.setattr(graph, "CELLS", cells)  # one pair at a time, or all
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        x = np.arange(12.0)[:, None] * [1.0, 0.1]
        meet = spark.createDataFrame([(v, i, i % 2 == 0, i % 3 == 0) for v in (1, 2) for i in range(12)], "via long, id long, a boolean, b boolean")
        rows = graph._narrow(table(spark, x)).withColumn("bound", F.when(F.col("id") == 4, 2.0).otherwise(float("inf")))
        got = sorted(map(tuple, graph._pairs_met(meet, rows).select("src", "dst").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, j) for _ in (1, 2) for i in range(0, 12, 2) for j in range(0, 12, 3) if i != j and (i != 4 or j == 3)]
    assert got == sorted(want)


def test_navigating_graph_joins_no_vectors_to_links(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(400, 5))
    plans = spied(monkeypatch)
    index = graph.GraphIndex.build(table(spark, x), shards=2, m=4, kind="nsg")
    made = [p for label, p in plans if label in ("thinned", "graph")]
    assert made and not any("Join" in p or "zip_with" in p for p in made)
    assert graph.reachable(index.edges(), index.nodes.where("entry").select("id")).count() == 400
    assert index.nodes.where("entry").count() == 2


def test_a_tree_takes_in_rows_that_links_do_not_reach():
    empty = np.zeros(0, int)
    far = np.array([2, 1, 0]), np.array([3, 3, 4]), np.array([0.5, 0.7, 0.1])
    assert graph.spanned(6, 0, (np.array([0, 1]), np.array([1, 2])), far) == [[1, 4, 5], [2], [3], [], [], []]  # 5 knows none, and is taken in from the root
    assert graph.spanned(1, 0, (empty, empty), (empty, empty, np.zeros(0))) == [[]]


def test_pruned_links_whatever_the_batches(spark):
    x = np.random.default_rng(5).normal(size=(40, 3))
    links = [(i, j) for i in range(0, 40, 2) for j in range(40) if i != j]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = graph.nsg_prune(spark.createDataFrame(links, "src long, dst long"), table(spark, x), 4)
        assert made._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # with the candidates' vectors only
        got = {r["src"]: r["neighbors"] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: graph.prune(x, i, np.delete(np.arange(40), i), 4) for i in range(0, 40, 2)}


def test_a_sample_brings_no_other_vectors_to_the_driver(spark, monkeypatch):
    kind = type(spark.range(1))
    x, plans, collect = np.arange(600.0).reshape(300, 2), [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
    rows = table(spark, x, 6)
    got = transforms.sample_matrix(rows, 20)
    assert plans and not any("vec" in line for p in plans for line in p.splitlines() if "TakeOrdered" in line)  # that sends so many rows of each task
    order = [r["id"] for r in collect(rows.orderBy(F.xxhash64("id"), "id"))]
    np.testing.assert_array_equal(got, x[order[:20]])
    assert len(transforms.sample_matrix(rows, 1000)) == 300 and len(transforms.sample_matrix(rows.where("false"))) == 0


@pytest.mark.parametrize("metric", ["l2", "ip", "l1", "linf", "cosine"])
def test_columns_rank_only_pairs_within_a_bound(spark, monkeypatch, metric):
    x = np.random.default_rng(6).integers(-3, 4, (500, 4)) + 0.5  # ties
    rows = table(spark, x)
    queries = rows.where("id % 25 = 0").select(F.col("id").alias("query_id"), "vec")
    ranked, rank = [], flat.best
    monkeypatch.setattr(flat, "best", lambda found, *a: (ranked.append(found.count()), rank(found, *a))[1])
    monkeypatch.setattr(flat, "SHARE", 10, raising=False)
    monkeypatch.setattr(flat, "QUERY_BYTES", 400)  # blocks of queries
    rows = rows.union(spark.createDataFrame([(999, None)], "id long, vec array<double>"))
    got = sorted(map(tuple, flat.knn_columns(rows, queries, 3, metric).select("query_id", "rank", "id", "distance").collect()))
    assert sum(ranked) < 500 * 20 * 2 / 3
    want = sorted(map(tuple, flat.knn(rows, queries, 3, metric).select("query_id", "rank", "id", "distance").collect()))
    if metric != "cosine":  # quotients that are equal may differ in the last bit
        assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)


def test_columns_with_few_rows_or_none(spark):
    rows = table(spark, np.eye(3))
    queries = rows.select(F.col("id").alias("query_id"), "vec")
    assert flat.knn_columns(rows, queries, 10).count() == 9
    assert flat.knn_columns(rows.where("false"), queries.where("false"), 10).count() == 0
