"""The language model against plain loops, under other partitionings, and on text with structure."""

import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vexel.llm import lm


@pytest.fixture(scope="module")
def chain(spark):
    """Texts in two vocabularies whose words follow each other, with null, empty, long and repeated rows."""
    rng = random.Random(8)
    texts = []
    for k in range(160):
        w, at = [], rng.randrange(30)
        for _ in range(rng.randrange(1, 90)):
            at = (at + rng.choice((1, 1, 1, 2, 7))) % 30
            w.append(f"{'ab'[k % 2]}{at}{'.' if rng.random() < 0.1 else ''}")
        texts.append(" ".join(w) + (f" once{k}" if k % 5 == 0 else ""))
    texts += [None, "", "   ", "One", "a0 a1", "b1 " * 3000, texts[0], texts[0]]
    return spark.createDataFrame([*enumerate(texts), (3, texts[5]), (None, texts[7])], "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("part", F.lit(9))


def told(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["base_score"], r["score"]) for r in rows.collect())


def test_partitionings_agree(chain, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 40)
    one = told(lm.learn_and_score(chain.repartition(2)))
    assert one == told(lm.learn_and_score(chain.repartition(8, F.rand(3)))) and len(one) == 170


def test_held_out_texts_gain(chain):
    got = lm.learn_and_score(chain).where("held_out AND doc_id < 160").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.9 * got[0]


def test_scores_by_plain_loops(chain, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 40)
    counts, encoded, words, m = lm.learn(chain)
    c = {r["token"].encode(): r["c"] for r in counts.collect()}
    known = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(encoded, words, m, counts).collect()}

    def share(level, node, one, two):
        rows = m.contexts(level, np.array([node]), np.array([one], np.uint32), np.array([two], np.uint32))
        x = [math.exp(float(m.bias[level][node, k]) + sum(float(m.tables[level][int(r[0]), k]) for r in rows)) for k in range(m.width)]
        return [v / sum(x) for v in x]

    def event_probability(e, one, two):
        p, node, at = 1.0, 0, int(m.place[e])
        for level in range(lm.LEVELS):
            branch = at // m.width ** (lm.LEVELS - 1 - level) % m.width
            p *= share(level, node, one, two)[branch]
            node = node * m.width + branch
        return p

    for r in chain.where("doc_id < 40 OR doc_id > 159").collect():
        w = (r["text"] or "").encode().lower().split()
        numbers = [words.hot.get(x) or lm._rare(x) for x in w][:60] + [lm.END]
        if len(w) > 60:
            continue
        total, one, two = 0.0, lm.END, lm.END
        for x, n in zip([*w, b""], numbers, strict=True):
            t = crc32(x[-3:]) % lm.TAILS
            total += math.log10(event_probability(1 + t if n >= int(lm.RARE) else n, one, two))
            if n >= int(lm.RARE):
                mass = sum(k for v, k in c.items() if v and v not in words.hot and crc32(v[-3:]) % lm.TAILS == t)
                kinds_ = sum(1 for v in c if v and v not in words.hot and crc32(v[-3:]) % lm.TAILS == t)
                total += math.log10((c.get(x, 0) + 1) / (mass + kinds_ + 1))
            one, two = n, one
        assert known[r["doc_id"], len(w) + 1]["score"] == pytest.approx(total, rel=1e-4, abs=1e-3)
    some = [event_probability(e, 70, lm.END) for e in range(len(words.seen))]
    assert 0.97 < sum(some) <= 1.0001  # leaves without an event have the rest


def test_a_round_by_plain_loops(chain, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 40)
    counts = lm.count_tokens(chain)
    words = lm.words_of(counts)
    encoded = lm.encode(chain, words, rounds=1)
    m = lm.start(words, lm.kinds(encoded, words))
    trained = lm.train(encoded, m, words.total, rounds=1)
    seen, due = defaultdict(int), defaultdict(float)
    for r in encoded.where("part = 0").collect():
        numbers = np.frombuffer(r["ids"], np.uint32)
        for k, n in enumerate(numbers):
            one, two = (int(numbers[k - 1]) if k else lm.END), (int(numbers[k - 2]) if k > 1 else lm.END)
            at, node = int(m.place[int(lm.event(np.array([n], np.uint32))[0])]), 0
            for level in range(lm.LEVELS):
                branch = at // m.width ** (lm.LEVELS - 1 - level) % m.width
                p = np.exp(m.bias[level][node].astype(float))
                for row in m.contexts(level, np.array([node]), np.array([one], np.uint32), np.array([two], np.uint32)):
                    seen[level, int(row[0]), branch] += 1
                    for b, v in enumerate(p / p.sum()):
                        due[level, int(row[0]), b] += v
                node = node * m.width + branch
    for (level, row, b), e in list(due.items())[::7]:
        expected = np.clip((seen[level, row, b] - e) / (3 * e + lm.PULL), -lm.STRIDE, lm.STRIDE)
        assert trained.tables[level][row, b] == pytest.approx(expected, abs=1e-3)


def test_no_training_rows(chain):
    rows = chain.where("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 7 = 2 OR doc_id IS NULL")
    got = lm.learn_and_score(rows).collect()
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["held_out"] and math.isfinite(r["score"]) for r in got)
    assert lm.learn_and_score(rows.where("false")).count() == 0


def test_ties_at_the_edge_go_by_token(spark):
    counts = spark.createDataFrame([("", 4), ("b", 2), ("a", 2), ("c", 2), ("d", 1)], "token string, c long")
    words = lm.words_of(counts, 2)
    assert list(words.hot) == [b"a", b"b"] and words.seen[1 : 1 + lm.TAILS].sum() == 3 and words.spread[1 : 1 + lm.TAILS].sum() == 2


def test_classes_are_learned(chain):
    """Words of one vocabulary get one kind."""
    words = lm.words_of(lm.count_tokens(chain))
    kind = lm.kinds(lm.encode(chain, words), words)
    of = {v: {int(kind[n]) for w, n in words.hot.items() if w.startswith(v) and not w.endswith(b".")} for v in (b"a", b"b")}
    assert not of[b"a"] & of[b"b"]


def test_strips_and_blocks(monkeypatch):
    """Branches are computed a strip at a time, whatever the block, and no sum or score depends on where strips and blocks end."""
    rng = np.random.default_rng(5)
    size = 1 + lm.TAILS + 500
    m = lm.start(lm.Words({}, np.arange(size)[::-1].copy(), np.ones(size, np.int64), size * size // 2, size), np.zeros(size, np.int64))
    m.tables = [rng.normal(0, 2, (m.rows, m.width)).astype(np.float32) for _ in range(lm.LEVELS)]
    numbers = np.where(rng.random(9000) < 0.1, lm.RARE | rng.integers(0, 1 << 31, 9000, np.uint32), rng.integers(0, size, 9000, np.uint32)).astype(np.uint32)
    starts = np.array([0, 1, 3, 40, 6000])
    texts = pa.array([x.tobytes() for x in np.split(numbers, starts[1:])], pa.binary())
    rows, shares = [], lm.Model.shares
    monkeypatch.setattr(lm.Model, "shares", lambda self, level, node, *rest: rows.append(len(node)) or shares(self, level, node, *rest))
    scores, (seen, due) = lm.token_scores(m, numbers, starts), lm.gather(m, [texts])
    assert max(rows) == lm.STRIP < len(numbers) <= lm.BLOCK and sum(rows) == 2 * lm.LEVELS * len(numbers)
    for level in range(lm.LEVELS):
        assert seen[level].sum() == 3 * len(numbers) and due[level].sum() / lm.FINE == pytest.approx(3 * len(numbers), rel=1e-5)
    monkeypatch.setattr(lm, "STRIP", 7)
    monkeypatch.setattr(lm, "BLOCK", 50)
    again, (seen_again, due_again) = lm.token_scores(m, numbers, starts), lm.gather(m, [texts])
    assert np.array_equal(scores, again) and all(np.array_equal(x, y) for x, y in zip([*seen, *due], [*seen_again, *due_again], strict=True))


def test_words_of_slices():
    """Arrow's words of any slice of a column are those of bytes.split()."""
    texts = [None, "", "  ", " a\x0bB\x1cc \x85 d e\x00 ", "Ünï É zz zz  x", "\n\tOne"] * 40 + ["ÀA " * 500, "b"]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string())):
        for k in (0, 1, 5, 77, 241):
            part = column.slice(k, 100)
            want = list(lm._tokens(part))
            found, sizes = lm._split(part)
            assert found.cast(pa.large_binary()).to_pylist() == [w for t in want for w in t] and sizes.tolist() == list(map(len, want))


def test_encoded_rows(chain, monkeypatch):
    """Numbers, rare words and their counts by plain loops, where words are looked up for a few texts at a time."""
    monkeypatch.setattr(lm, "HOT", 40)
    monkeypatch.setattr(lm, "LOOKUP", 100)
    words = lm.words_of(lm.count_tokens(chain))
    rows = lm.encode(chain, words).collect()
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode().lower().split()) for r in chain.collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(r["ids"], np.uint32).tolist(), sorted(map(tuple, r["rare"])), r["n_tokens"], r["n_known"]) for r in rows)
    want = []
    for null, doc_id, w in texts:
        rest = [x for x in w if x not in words.hot]
        want.append((null, doc_id, [words.hot.get(x) or lm._rare(x) for x in w] + [lm.END], sorted((x.decode(), rest.count(x)) for x in set(rest)), len(w) + 1, len(w) + 1 - len(rest)))
    assert got == sorted(want) and len({r["row"] for r in rows}) == len(rows)
