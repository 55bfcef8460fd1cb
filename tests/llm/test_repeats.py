"""Repeated bytes against brute force over all windows, with texts in one span and in many, and every stage of the refinement."""

import hashlib
import random

import numpy as np
import pytest

from vexel.llm import repeats

ROWS = "doc_id long, text string"


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, (rows[k][1] or "").encode()))
    seen, out = set(), []
    for k in order:
        text = (rows[k][1] or "").encode()
        hit = bytearray(len(text))
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                hit[p : p + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(c for c, h in zip(text, hit, strict=True) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((rows[k][0], len(text), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, docs=80):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop éü€ "
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [say(n) for n in (60, 99, 100, 101, 120, 134, 180, 300, 900)]
    made = []
    for k in range(docs):
        parts = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s) + 1), rng.randrange(len(s) + 1))) if rng.random() < 0.5 else (0, len(s))
            parts += [say(rng.choice([0, 1, 5, 40, 200])), s[a:b]]
        made.append((k, "".join(parts)))
    return made


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize(("seed", "span"), [(1, repeats.SPAN), (2, 300), (3, 2000)])
def test_equal_to_brute_force(spark, seed, span):
    rows = corpus(seed)
    got = told(repeats.deduplicated(spark.createDataFrame(rows, ROWS).repartition(5), span, digest=True))
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 20 and any(r[3] > 1 for r in got)


def test_periodic_long_empty_and_repeated_rows(spark):
    rng = random.Random(5)
    far = "".join(rng.choice("xyz") for _ in range(150))
    rows = [(1, "a" * 5000), (2, "ab" * 300), (3, "ba" * 300), (4, None), (5, ""), (6, "a" * 99), (7, "a" * 100), (8, "abc" * 70 + "ab" * 70)]
    rows += [(9, far), (9, far), (9, "b" + far), (None, far + "q"), (None, None), (10, "é" * 200), (11, "\x00" * 101)]
    assert told(repeats.deduplicated(spark.createDataFrame(rows, ROWS).repartition(3), digest=True)) == brute(rows)


def test_texts_longer_than_a_part(spark):
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(33, 127, repeats.PART + 100_000, dtype=np.uint8))
    near = text[repeats.PART - 250 : repeats.PART + 250]  # across the parts' border
    rows = [(1, text.decode()), (2, "é" + near.decode() + "é"), (3, (text[5000:5100] + text[:50]).decode())]
    got = told(repeats.deduplicated(spark.createDataFrame(rows, ROWS), digest=True))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == [(1, len(text), 0, 0, sha(text)), (2, 504, 500, 1, sha("éé".encode())), (3, 150, 100, 1, sha(text[:50]))]


def test_kept_bytes_empty_table_and_clashing_columns(spark):
    assert repeats.deduplicated(spark.createDataFrame([], ROWS)).count() == 0
    text = "".join(random.Random(1).choices("abcdef", k=150))
    rows = [(1, text, 3, "x", 4), (2, "<" + text + ">", 5, "y", 6)]
    got = repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, key int, bucket string, start int"))
    assert {(r["doc_id"], bytes(r["kept"]), r["n_spans"]) for r in got.collect()} == {(1, text.encode(), 0), (2, b"<>", 1)}
