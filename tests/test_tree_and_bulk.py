"""Balanced trees, bulk search that is taken up again, and k-means in growing dimensions."""

import numpy as np
import pytest

from vexel import catalog
from vexel.operators import bulk, cluster, coded, evaluate, flat, ivf, quantizers, tree
from vexel.plans import storage

SF = "/root/testdata/sf0.001"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def told(found):
    return sorted((r["query_id"], r["id"], round(r["distance"], 6)) for r in found.collect())


def test_leaves_are_small_even_and_hold_each_row_once(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (500, 4)), rng.normal(3, 1, (60, 4)), np.full((40, 4), 9.0)])  # a tight group with most rows, equal rows
    made = tree.Tree.build(table(spark, x), 4, 30)
    assert sorted(r["id"] for r in made.rows.select("id").collect()) == list(range(600))
    sizes = {r["node"]: r["n"] for r in made.leaf_sizes().collect()}
    equal = {r["node"] for r in made.rows.where("id >= 560").select("node").collect()}
    assert all(n <= 30 for node, n in sizes.items() if node not in equal)
    nodes = {r["node"]: r for r in made.nodes.collect()}
    assert all(r["parent"] == 1 or r["parent"] in nodes for r in nodes.values()) and all(n["parent"] == k // 4 for k, n in nodes.items())


def test_the_penalty_evens_sizes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.5, (900, 3)), rng.normal(4, 0.5, (100, 3))])
    spread = [tree.balanced(x, 4, f, 15)[2].std() for f in tree.FACTORS]
    assert min(spread[1:]) < spread[0]


def test_a_tree_of_few_or_no_rows(spark):
    assert tree.Tree.build(table(spark, np.eye(3)), 2, 5).rows.count() == 3
    assert tree.Tree.build(table(spark, np.eye(3)).where("false"), 2, 5).rows.count() == 0


@pytest.mark.parametrize("make", [lambda r: ivf.IvfIndex.build(r, 6), lambda r: coded.CodedIvf.build(r, 6, quantizers.Scalar(8))])
def test_bulk_search_goes_on_where_it_broke(spark, make, monkeypatch):
    rows = catalog.base(spark, SF)
    index, asked, path = make(rows), catalog.asked(rows), storage.new_path(spark, "bulk")
    plain, calls = type(index).search_preassigned, []

    def breaks(self, queries, probes, *more):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return plain(self, queries, probes, *more)

    monkeypatch.setattr(type(index), "search_preassigned", breaks)
    with pytest.raises(RuntimeError):
        bulk.search(index, asked, 5, 4, path, rows=30)
    assert len(calls) == 3
    found = told(bulk.search(index, asked, 5, 4, path, rows=30))
    assert len(calls) == 3 + len(bulk.ranges(getattr(index, "codes", None) or index.lists, 30)) - 2  # two ranges were kept
    monkeypatch.undo()
    assert found == told(index.search(asked, 5, nprobe=4))
    with pytest.raises(ValueError):
        bulk.search(index, asked, 6, 4, path, rows=30)


def test_growing_dimensions_end_near_plain_kmeans(spark):
    rows = catalog.base(spark, SF)
    grown, plain = cluster.growing_dimensions(rows, 6), cluster.Kmeans(6, 20).fit(rows)
    assert [h["dimensions"] for h in grown.history if h] == sorted(h["dimensions"] for h in grown.history) and grown.history[-1]["dimensions"] == 64
    cost = lambda m: sum(r["distance"] for r in m.assign(rows).collect())
    assert cost(grown) <= 1.05 * cost(plain)


def test_representatives_are_the_nearest_of_all_rows(spark):
    rows = storage.materialize(catalog.base(spark, SF).select("id", "vec"), "rows")
    centroids, subs = cluster.two_level(rows, 3, 9)
    x = {r["id"]: np.array(r["vec"]) for r in rows.collect()}
    of = {i: int(((centroids - v) ** 2).sum(1).argmin()) for i, v in x.items()}
    subs = subs.collect()
    for s in subs:
        mine = [i for i in x if of[i] == s["list_no"] and min((((np.array(o["vec"]) - x[i]) ** 2).sum(), o["sub_no"]) for o in subs if o["list_no"] == s["list_no"])[1] == s["sub_no"]]
        assert s["rep_id"] == min(mine, key=lambda i: (((x[i] - np.array(s["vec"])) ** 2).sum(), i))


def test_tree_recall(spark):
    rows = catalog.base(spark, "/root/testdata/sf0.1")
    assert evaluate.intersection_at(catalog.balanced_tree(spark, "/root/testdata/sf0.1"), flat.knn(rows, catalog.asked(rows), 10), 10).first()[0] >= 0.9
