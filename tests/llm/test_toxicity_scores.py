"""Scores of the lexicon against brute force over all places and entries, and their independence of the sample's bound."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import toxicity

ROWS = "doc_id long, text string, toxic int"


def brute(model, text):
    """The score by the docstring: at each word's beginning the heaviest entry, unless an exception covers it."""
    folded = toxicity.fold(text)
    covered = {at for p in model.exceptions for k in range(len(folded)) if folded.startswith(f" {p}", k) for at in range(k, k + len(p))}
    best = [max((v for w, v in model.weights.items() if folded.startswith(w, k)), default=0.0) for k in range(len(folded))]
    values = [v for k, v in enumerate(best) if v > 0 and k not in covered]
    x = (math.log1p(sum(values)), sum(values) / (1 + folded.count(" ")) ** 0.5, max(values)) if values else (0.0, 0.0, 0.0)
    z = model.base + sum(a * b for a, b in zip(x, model.slopes, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_by_brute_force(spark):
    rng = random.Random(1)
    model = toxicity.Model({" trash": 2.0, " trash ": 3.5, " sore": 1.0, " lo": 0.5, " loser ": 4.0, " é": 0.25}, ("trash can", "can sore loser cup", "sore lo"), (0.7, -0.3, 0.9), -2.0)
    words = ["trash", "tr4sh", "TRASH", "trasher", "can", "sore", "loser", "l0$er", "lo", "cup", "été", "ok", "тrаsh", "-", "..", "\n", "sore,", "(loser)"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", " \t", "trash " * 5000, "trashcan trash  can", "trash can sore loser cup"]
    df = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r["score"] for r in toxicity.score(df, model).collect())
    assert np.allclose(got, sorted(brute(model, t) for t in texts), rtol=1e-12)
    assert len(set(got)) > 50


def corpus(seed, n, share):
    """Texts with a toxic word in most of the toxic and few of the plain ones."""
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice("lo mi ra tu be ke".split()) + rng.choice("ne so pa".split()) for _ in range(25))
    out = []
    for k in range(n):
        toxic = rng.random() < share
        bad = rng.random() < (0.9 if toxic else 0.04)
        out.append((k, say() + (f" {rng.choice(['zorgle', 'frobnut'])} " if bad else " ") + say(), int(toxic)))
    return out


@pytest.mark.parametrize("per_class", [60, 3000])
def test_scores_follow_the_share_of_all_labels(spark, per_class):
    rows = corpus(2, 4000, 0.1)
    df = spark.createDataFrame(rows, ROWS)
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), per_class)
    got = toxicity.score(df.select("doc_id", "text"), model).where("held_out").join(df.select("doc_id", "toxic"), "doc_id").toPandas()
    assert abs(got.score.mean() - got.toxic.mean()) < 0.03
    by = got.groupby("predicted").toxic.mean()
    assert by[1] > 0.6 and by[0] < 0.09  # 0.72 of texts with such a word are toxic


def test_without_a_lexicon_nothing_is_toxic(spark):
    rng = random.Random(3)
    rows = [(k, "plain words " + " ".join(rng.choice("abcdefgh") * 4 for _ in range(5)), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, ROWS)
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert not model.weights and toxicity.score(df.select("doc_id", "text"), model).agg(F.max("score")).first()[0] <= toxicity.NO_MATCH + 1e-9
    assert toxicity.keep_clean(df, model).count() == 400


def test_labels_that_repeat_or_contradict(spark):
    rows = corpus(4, 800, 0.3)
    docs = spark.createDataFrame(rows, ROWS).select("doc_id", "text")
    once = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (5, None), (6, 7), (10**9, 1)], "doc_id long, toxic int")
    assert toxicity.weights_of(once.union(once), 100) == toxicity.weights_of(once, 100)
    assert toxicity.learn(docs, once.union(once)).weights == toxicity.learn(docs, once).weights
    assert toxicity.learn(docs, once.union(odd)).weights == toxicity.learn(docs, once).weights
