"""Range search in inverted lists: lists are scanned where they lie, compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import kernels
from vexel.operators import ivf


def table(spark, x, name="id"):
    return spark.createDataFrame([(i, None if v is None else [float(e) for e in v]) for i, v in enumerate(x)], f"{name} long, vec array<double>").repartition(3)


@pytest.mark.parametrize("metric", ["l2", "ip", "l1"])
def test_no_vector_goes_along_with_a_pair(spark, monkeypatch, metric):
    """Lists were joined with their queries by list number: as few tasks as lists, and both vectors in each of the pairs."""
    monkeypatch.setattr(kernels, "CELLS", 1 << 12)
    x = np.random.default_rng(6).integers(-2, 3, (300, 3)).astype(float)  # many pairs at the radius itself, none of them within
    centres = x[[3, 90, 200, 250]]
    base, asked = table(spark, [*x, None]), table(spark, [*x[:70], None], "query_id")
    index = ivf.IvfIndex.build(base, 4, metric, rounds=0, init=centres, sample=False)
    found = index.range_search(asked, 4.0, nprobe=2, where=F.col("id") % 5 != 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange hashpartitioning" not in plan and "zip_with" not in plan
    got = found.toPandas()
    d = {"l2": ((x[:70, None] - x) ** 2).sum(2), "ip": x[:70] @ x.T, "l1": np.abs(x[:70, None] - x).sum(2)}[metric]
    lists = {r["id"]: r["list_no"] for r in index.lists.collect()}
    probed = {(r["query_id"], r["list_no"]) for r in index.probes(asked, 2).collect()}
    want = {(q, i) for q in range(70) for i in range(300) if i % 5 and (q, lists[i]) in probed and (d[q, i] > 4 if metric == "ip" else d[q, i] < 4)}
    assert want and len(got) == len(want) and set(zip(got["query_id"], got["id"])) == want
    assert (got["distance"] == d[got["query_id"], got["id"]]).all()


def test_no_query_finds_nothing(spark):
    base = table(spark, np.eye(3))
    index = ivf.IvfIndex.build(base, 2, rounds=0, init=np.eye(3)[:2], sample=False)
    assert index.range_search(table(spark, np.eye(3), "query_id").where("query_id < 0"), 1.0).count() == 0
