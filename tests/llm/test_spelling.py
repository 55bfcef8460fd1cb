"""Spelling variants against brute force: all pairs of a small vocabulary, and every part split to the last level."""

import random
import re
import zlib
from collections import Counter

import pytest

from vexel.llm import spelling

ROWS = "doc_id long, text string"


def vocabulary(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    known = vocabulary(rows)
    close = {w: [v for v in known if near(w, v)] for w in known}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 10 * known[w] else None
    out = set()
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, known[w], len(close[w]), known[form[w]] if form[w] else None))
    return out


def made(seed, docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "École÷xÿ"]

    def spelled():
        w = rng.choice(stems[: 5 if rng.random() < 0.6 else None])
        if rng.random() < 0.3:
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcd") + w[k:], w[:k] + rng.choice("abcd") + w[k + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    return [(k, rng.choice([" ", ", ", "1", "\n"]).join(spelled() for _ in range(rng.randint(0, 60)))) for k in range(docs)]


@pytest.mark.parametrize("most", [spelling.MOST, 3])
def test_equal_to_brute_force(spark, most):
    rows = made(1) + [(None, "Repeated repeated repeateds"), (None, "repeated"), (7, None), (8, ""), (9, "  \n"), (9, "  \n"), (10, "abcdefgh" * 3000 + " " + "abcdefgh" * 3000)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, ROWS), most).collect()}
    assert got == brute(rows)
    assert sum(r[1] is not None for r in got) > 20


def test_each_pair_once_whatever_the_parts(spark):
    words = sorted(vocabulary(made(2, 150)))
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for most in (1, 10, 1000):
        got = sorted(tuple(sorted((r["word"], r["near"]))) for r in spelling.pairs(table, most).collect())
        assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_forms_are_followed_to_the_last(spark):
    texts = [" ".join([w] * n) for w, n in (("zzzzzzz", 2), ("zzzzzzy", 20), ("zzzzzyy", 200), ("zzzzyyy", 2000))]
    rows = [(next(d for d in range(k, 10**6) if set(vocabulary([(d, t)])) == {t[:7]}), t) for k, t in enumerate(texts)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == dict.fromkeys(("zzzzzzz", "zzzzzzy", "zzzzzyy", "zzzzyyy"), "zzzzyyy")


def test_empty_table_and_clashing_columns(spark):
    assert spelling.variants(spark.createDataFrame([], ROWS)).count() == 0
    rows = [(1, "spelling spelling", "x", 1, None)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string, word string, n int, key string")).collect()
    assert {(r["word"], r["n"]) for r in got} == {(w, 2) for w in vocabulary([rows[0][:2]])}
