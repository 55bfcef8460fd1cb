"""Lists of words, thresholds and spectral codes on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import binary, evaluate, flat, quantizers
from vexel.operators.ivf import IvfIndex
from vexel.plans import factory


def words(spark, values, name="id"):
    return spark.createDataFrame(list(enumerate(values)), f"{name} long, word long")


def test_centres_are_majorities(spark):
    rng = np.random.default_rng(1)
    seeds = [0x0F0F0F0F0F0F0F0F, -1, 0]
    values = [s ^ (1 << int(rng.integers(0, 62))) for s in seeds for _ in range(20)]
    base = words(spark, [*values, None])
    centres = binary.WordLists.train(base, 6, 5)
    lists = binary.WordLists.build(base, centres)
    assert lists.lists.count() == 60
    exact = binary.knn(base.where("word IS NOT NULL"), words(spark, seeds, "query_id"), 5)
    found = lists.search(words(spark, seeds, "query_id"), 5, nprobe=6)
    key = lambda t: sorted(map(tuple, t.select("query_id", "id", "distance", "rank").collect()))
    assert key(found) == key(exact)  # every list probed
    one = {r["list_no"] for r in lists.lists.collect()}
    assert one <= set(range(6))


def test_sign_bit_and_ties(spark):
    base = words(spark, [-1, -1, 0])
    lists = binary.WordLists.build(base, [-1, -1, 0])
    assert [r["list_no"] for r in lists.lists.orderBy("id").collect()] == [0, 0, 2]
    assert binary.WordLists.train(base, 1, 3) == [-1]


def test_empty_tables(spark):
    none = words(spark, [1]).where("false")
    assert binary.WordLists.train(none, 3) == []
    assert binary.count_within(none, words(spark, [1], "query_id"), 9).count() == 0
    assert binary.WordLists.build(none, [1]).search(words(spark, [1], "query_id"), 2).count() == 0


def test_thresholds(spark):
    x = np.random.default_rng(2).normal(3, 1, (101, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = binary.medians(rows)
    assert found.first()["thresholds"] == pytest.approx(np.median(x, axis=0))
    expected = {i: sum(int(b) << k for k, b in enumerate(v >= np.median(x, axis=0))) for i, v in enumerate(x)}
    assert {r["id"]: r["word"] for r in binary.lsh_words(rows, found).collect()} == expected


def test_spectral_word(spark):
    rows = spark.createDataFrame([([0.1, 0.6, -0.1, 1.1], [0.0, 0.0, 0.0, 0.0])], "v array<double>, c array<double>")
    assert rows.select(binary.spectral_word(F.col("v"), F.col("c"), 1.0)).first()[0] == 0b0110


def test_reset_and_reconstruct(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0])], "id long, vec array<double>")
    index = IvfIndex.build(rows, 2, rounds=0, init=np.array([[0.0, 1.0], [5.0, 1.0]]), sample=False)
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    assert [tuple(r) for r in index.reconstruct(ids).collect()] == [(1, 2, [5.0, 1.0])]
    assert index.reset().lists.count() == 0 and index.reset().add(rows).lists.count() == 2


def test_half_and_lsh_strings(spark):
    x = np.random.default_rng(3).normal(0, 1, (120, 70))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asked = rows.where("id % 20 = 0").selectExpr("id AS query_id", "vec")
    for text, options in (("SQfp16", {}), ("IVF4,SQfp16", {"nprobe": 4})):
        found = factory.build(text, rows).search(asked, 10, **options)
        assert evaluate.intersection_at(found, flat.knn(rows, asked, 10), 10).first()[0] >= 0.9
    for text, t in (("LSH", 0.0), ("LSHt", np.sort(x, axis=0)[59])):
        bits = x >= t
        got = {(r["query_id"], r["id"], r["distance"]) for r in factory.build(text, rows).search(asked, 5).collect()}
        far = {q: sorted((int((bits[q] != b).sum()), i) for i, b in enumerate(bits))[:5] for q in range(0, 120, 20)}
        assert got == {(q, i, d) for q, best in far.items() for d, i in best}
    assert factory.build("LSHrt", rows).search(asked, 5).where("rank = 1 AND id = query_id AND distance = 0").count() == 6


def test_half_is_clipped():
    half = quantizers.Half()
    assert half.decode(half.encode(np.array([[1e9, -1e9, 0.5, 0.0]]))).tolist() == [[65504.0, -65504.0, 0.5, 0.0]]
