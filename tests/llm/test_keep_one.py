"""One row of each component, whatever the ids."""

import random

from vexel.llm import simhash


def test_null_and_shared_ids(spark):
    rng = random.Random(11)
    a, b, c, d, e, f = (" ".join(f"{rng.choice('bdfgk')}{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (7, e), (3, f), (None, f), (9, f), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS root", "2 AS h")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted([(None, a), (None, b), (None, c), (7, d), (7, e), (3, f), (None, None)], key=key)
    lone = df.where("doc_id IS NULL").limit(1)
    assert simhash.keep_one(lone).count() == 1
