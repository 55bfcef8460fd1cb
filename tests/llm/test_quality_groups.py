"""Verdicts of the quality rules on planted vectors: groups with much junk, and small groups."""

import numpy as np
import pytest

from vexel.llm import quality

FLOORS = np.array(list(quality.FEATURES.values()))


def kept(spark, parts):
    """The share of kept rows of each part, a tuple (name, lang, source, vectors in floors)."""
    rows = [(name, lang, source, False, *(int(v) for v in x)) for name, lang, source, vectors in parts for x in np.round((1 + vectors * FLOORS) * quality.UNIT)]
    df = spark.createDataFrame(rows, "part string, lang string, source string, base_failed boolean, " + ", ".join(f"x{k} long" for k in range(len(FLOORS))))
    out = quality.judge_rows(df).selectExpr("part", "CAST(kept AS int) AS k").groupBy("part").avg("k")
    return {r[0]: r[1] for r in out.collect()}


def made(rng, n, at=0.0, wide=1.0):
    x = rng.normal(0, wide, (n, len(FLOORS)))
    x[:, 1] += at
    return x


@pytest.mark.parametrize("share", [0.3, 0.34, 0.45])
def test_clustered_junk(spark, share):
    rng = np.random.default_rng(3)
    n = round(400 * share)
    got = kept(spark, [("good", "en", "a", made(rng, 400 - n)), ("junk", "en", "a", made(rng, n, 40.0, 0.5))])
    assert got == {"good": 1, "junk": 0}


def test_small_groups_are_judged_with_all_rows(spark):
    rng = np.random.default_rng(4)
    parts = [("good", lang, source, made(rng, 150)) for lang in ("en", "de") for source in ("a", "b", None)]
    parts += [("junk", "en", "c", made(rng, 55, 40.0, 0.5)), ("junk", "en", "d", made(rng, 20, 40.0, 0.5)), ("junk", "fr", "a", made(rng, 59, 40.0, 0.5)), ("junk", "it", None, made(rng, 2, 40.0))]
    parts += [("lone", "en", "e", made(rng, 1)), ("lone", None, None, made(rng, 1))]
    assert kept(spark, parts) == {"good": 1, "junk": 0, "lone": 1}
