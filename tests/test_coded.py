"""Indexes over codes, by their strings and from files; recall is measured against exact search."""

import numpy as np
import pytest

from vexel import catalog
from vexel.operators import cluster, coarse, coded, codes, evaluate, flat, graph, ivf, quantizers
from vexel.plans import factory, storage

SF = "/root/testdata/sf0.001"


def recall(found, truth):
    return evaluate.intersection_at(found, truth, 10).first()[0]


@pytest.fixture(scope="module")
def truth(spark):
    rows = catalog.base(spark, SF)
    return storage.materialize(flat.knn(rows, catalog.asked(rows), 10), "truth")


@pytest.mark.parametrize("text, options, least", [
    ("SQ8", {}, 0.9), ("IVF8,SQ8", {"nprobe": 8}, 0.9), ("IVF8,PQ16x8,RFlat", {"nprobe": 8}, 0.9), ("Pad80,Flat", {}, 1.0), ("PQ8x4,Refine(SQ8)", {"k_factor": 20}, 0.9), ("IDMap,SQ4,RFlat", {}, 0.9),
])
def test_recall_of_codes(spark, truth, text, options, least):
    rows = catalog.base(spark, SF)
    assert recall(factory.build(text, rows).search(catalog.asked(rows), 10, **options), truth) >= least


@pytest.mark.parametrize("text", ["ZnLattice2x3_4", "IVF8,LSH", "ITQ16,Flat", "HNSW8,LSH"])
def test_what_has_no_builder_raises(spark, text):
    with pytest.raises(NotImplementedError):
        factory.build(text, catalog.base(spark, SF)).search(catalog.asked(catalog.base(spark, SF)), 3)


def test_projection_of_opq(spark):
    rows = catalog.base(spark, SF)
    from vexel.operators import transforms

    fitted = transforms.opq(transforms.sample_matrix(rows), 8, rounds=2, out=32)
    assert fitted.a.shape[0] == 32 and np.allclose(fitted.a @ fitted.a.T, np.eye(32), atol=1e-6)


def test_polysemous_order_brings_hamming_nearer():
    x = np.random.default_rng(3).normal(size=(2000, 8))
    codec = quantizers.Product(2, 4).fit(x)

    def loss():
        h = np.bitwise_count(np.arange(16)[:, None] ^ np.arange(16))
        d = [((b[:, None] - b[None]) ** 2).sum(2) for b in codec.books]
        return sum(((v / v.mean() * h.mean() - h) ** 2).sum() for v in d)

    before = loss()
    codec.order_codes()
    assert loss() < before


@pytest.mark.parametrize("make", [lambda r: ivf.IvfIndex.build(r, 8), lambda r: coded.CodedIvf.build(r, 8, quantizers.Scalar(8)), lambda r: coded.CodedIvf.build(r, 8, quantizers.Product(8, 4)), lambda r: coded.CodedIvf.around(coarse.MultiIndex.fit(r, 2), r, quantizers.Normed(quantizers.Residual(3, (4, 4, 5)), "cqint8")), lambda r: ivf.IvfIndex.around(coarse.Additive.fit(r, quantizers.Residual(2, 2)), r)])
def test_stored_indexes_find_the_same(spark, make):
    rows = catalog.base(spark, SF)
    index, path = make(rows), storage.new_path(spark, "index")
    coded.save(index, path)
    found = lambda i: sorted((r["query_id"], r["id"], round(r["distance"], 6)) for r in i.search(catalog.asked(rows), 5, nprobe=3).collect())
    assert found(coded.load(spark, path)) == found(index)


def test_added_codes_and_range_search(spark):
    rows = catalog.base(spark, SF)
    index = coded.CodedIvf.build(rows.where("id % 2 = 0"), 4, quantizers.Scalar(8)).add(rows.where("id % 2 = 1"))
    asked = catalog.asked(rows)
    assert index.codes.count() == rows.count()
    exact = {(r["query_id"], r["id"]) for r in flat.range_search(rows, asked, 40.0).collect()}
    near = {(r["query_id"], r["id"]) for r in index.range_search(asked, 40.0, nprobe=4).collect()}
    assert len(exact ^ near) <= 0.1 * max(len(exact), 20)


def test_bucket_start_by_rank(spark):
    x = [(int(i), [float(i), 1.0]) for i in np.random.default_rng(2).permutation(1000) * 3]
    rows = spark.createDataFrame(x, "id long, vec array<double>").repartition(7)
    assert cluster.bucket_start(rows, 7)[:, 0].tolist() == [3.0 * 142 * k for k in range(7)]


def test_graph_without_queries(spark):
    rows = catalog.base(spark, SF)
    assert graph.GraphIndex.build(rows).search(catalog.asked(rows).where("false"), 3).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n.startswith("index_") and n not in ("index_pad", "index_itq")))
def test_registered_settings_reach_their_recall(spark, name):
    """At sf0.1, with the settings of the catalog."""
    at = "/root/testdata/sf0.1"
    rows = catalog.base(spark, at)
    if not hasattr(test_registered_settings_reach_their_recall, "truth"):
        test_registered_settings_reach_their_recall.truth = storage.materialize(flat.knn(rows, catalog.asked(rows), 10), "truth")
    assert recall(catalog.queries()[name](spark, at), test_registered_settings_reach_their_recall.truth) >= 0.9


def test_graph_queries_reach_their_recall(spark):
    rows = catalog.base(spark, "/root/testdata/sf0.1")
    assert recall(catalog.two_level_graph(spark, "/root/testdata/sf0.1"), flat.knn(rows, catalog.foreign(rows), 10)) >= 0.9
    assert recall(catalog.graph_removed(spark, "/root/testdata/sf0.1"), flat.knn(rows.where("id % 3 <> 1"), catalog.asked(rows), 10)) >= 0.9


def test_layers_measure_fewer_rows_than_layer_0_alone():
    """From one row; entries near the centres of groups, which a shard has as well, save about as much at this size."""
    rng = np.random.default_rng(3)
    x, asked = rng.uniform(size=(1500, 2)), rng.uniform(size=(40, 2))
    layers = graph.link(x, np.arange(len(x)), 6, 40)
    measured, right = {}, {}
    for down in (True, False):
        measured[down] = right[down] = 0
        for q in asked:
            seen = set()
            seeds = [graph.descend(x, layers, q, min(layers[-1]), seen=seen) if down else 0]
            near = {n for _, n in graph.beam(x, layers[0], q, seeds, 10, seen=seen)}
            measured[down] += len(seen)
            right[down] += len(near & set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()))
    assert min(right.values()) >= 0.9 * 400 and measured[True] < 0.7 * measured[False]


def test_what_is_linked_through_a_removed_row_stays_reachable(spark):
    x = np.stack([np.arange(60.0), np.zeros(60)], axis=1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    index = graph.GraphIndex.build(rows, shards=1, m=2, ef=4).remove(rows.where("id % 2 = 1"))
    assert graph.reachable(index.edges(), index.nodes.where("entry").select("id")).count() == 30


def test_cells_of_a_multi_index_with_ties():
    books = [np.array([[0.0], [1.0], [1.0], [3.0]])] * 3
    index = coarse.MultiIndex(books, 2)
    assert index.centres(np.array([0b110100])).tolist() == [[0.0, 1.0, 3.0]]


def test_order_of_cells(spark):
    rng = np.random.default_rng(5)
    books = [rng.integers(0, 3, (8, 2)).astype(float) for _ in range(3)]  # many ties
    index, q = coarse.MultiIndex(books, 3), rng.integers(0, 3, (4, 6)).astype(float)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    for n in (1, 7, 40, 512):
        got = {}
        for r in index.probes(asked, n).collect():
            got.setdefault(r["query_id"], {})[r["probe_rank"]] = r["list_no"]
        for i, v in enumerate(q):
            d = [((b - s) ** 2).sum(1) for b, s in zip(books, np.split(v, 3), strict=True)]
            every = sorted((d[0][a] + d[1][b] + d[2][c], a + 8 * b + 64 * c) for a in range(8) for b in range(8) for c in range(8))
            assert [got[i][k + 1] for k in range(n)] == [cell for _, cell in every[:n]]


def test_sums_of_codebooks_as_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    index = coarse.Additive(quantizers.Residual(3, (2, 3, 2)).fit(x), beam=200)
    lists, d = index._nearest_sums(x[0], 128)
    every = ((index.centres(np.arange(128)) - x[0]) ** 2).sum(1)
    assert sorted(lists) == list(range(128)) and np.allclose(d, np.sort(every)) and np.allclose(every[lists], d)


@pytest.mark.parametrize("widths", [[8, 8], [1, 2, 3, 4, 5], [16] * 3, [32, 4, 32], [7] * 9])
def test_packed_codes_come_back(widths):
    c = np.stack([np.random.default_rng(1).integers(0, 1 << w, 50) for w in widths], axis=1)
    raw = codes.pack(c, widths)
    assert raw.shape == (50, (sum(widths) + 7) // 8) and (codes.unpack(raw, widths) == c).all()


def test_tables_give_the_distances_of_decoding(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=8)
    for codec in (quantizers.Product(4, 3), *(quantizers.Normed(c, "float") for c in (quantizers.Residual(3, 3), quantizers.LocalSearch(2, 3), quantizers.ProductAdditive(2, quantizers.Residual, 2, 3)))):
        c = codec.fit(x).encode(x)
        assert np.allclose(codec.distances(q, c, "l2"), ((codec.decode(c) - q) ** 2).sum(1), atol=1e-4)
        assert np.allclose(codec.distances(q, c, "ip"), codec.decode(c) @ q)


def test_search_plan_has_no_exchange_of_codes_and_repeated_ids_stay(spark):
    rows = catalog.base(spark, SF).select("id", "vec")
    twice = rows.union(rows)
    index = coded.CodedIvf.build(twice, 4, quantizers.Product(8, 4))
    assert index.codes.count() == index.reconstruct().count() == 2 * rows.count()
    found = index.search(catalog.asked(rows), 5, nprobe=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan  # codes are only scanned
    exact = {(r["list_no"], r["id"]): r["vec"] for r in index.reconstruct().collect()}
    asked = {r["query_id"]: np.array(r["vec"]) for r in catalog.asked(rows).collect()}
    vec = {i: np.array(v) for (_, i), v in exact.items()}
    assert all(abs(r["distance"] - ((vec[r["id"]] - asked[r["query_id"]]) ** 2).sum()) < 1e-6 for r in found.collect())


def test_threshold_comes_before_distances(spark):
    rows = catalog.base(spark, SF).select("id", "vec")
    index, asked = coded.FlatCodes.build(rows, quantizers.Product(8, 4, polysemous=True)), catalog.asked(rows)
    near = {(r["query_id"], r["id"]) for r in index.search(asked, 1000, ht=10).collect()}
    every = index.search(asked, 1000).count()
    assert 0 < len(near) < every / 2 and {(q, q) for q, _ in near} <= near
