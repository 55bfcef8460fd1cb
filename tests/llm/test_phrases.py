"""Collocations against brute force over all phrases of a small corpus, in one chunk and in many."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vexel.llm import phrases

ROWS = "doc_id long, text string, lang string"


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    known = {(g, w): a for (g, w), a in f.items() if len(w) > 1 and a >= least}
    out = []
    for (g, w), a in known.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(h == g and len(v) > len(w) and 100 * b >= 80 * a and inside(v) for (h, v), b in known.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        out.append((g, " ".join(w), a, left, right, n[g], score))
    result = set()
    for g in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == g), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result |= {(g, k + 1, *r[1:]) for k, r in enumerate(mine)}
    return result


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "The", "a", "naïve", "x y", "New", "York", "city", "É", "zz\x1fz", "\x00"]
    rows = [(k, "".join(rng.choice(words[: rng.choice([3, 12])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", "de", None])) for k in range(120)]
    rows += [(k, "in New York City today. in new york city", "en") for k in range(20)]
    return rows + [(300, None, "en"), (301, "", None), (302, " \t\n..", "fr"), (303, "word " * 20000, "it"), (303, "word " * 20000, "it"), (None, "only one", "es")]


@pytest.mark.parametrize("chunk", [phrases.CHUNK, 200])
@pytest.mark.parametrize("top", [2000, 7])
def test_equal_to_brute_force(spark, chunk, top):
    rows = corpus(3)
    got = phrases.collocations(spark.createDataFrame(rows, ROWS).repartition(3), top, chunk, 30).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = {tuple(r) for r in got.collect()}
    assert got == brute(rows, 30, top)
    assert len(got) > 7


def test_parents_point_to_the_halves(spark):
    every, _ = phrases.phrases(spark.createDataFrame(corpus(5), ROWS), 10)
    rows = every.collect()
    by = {(r["level"], r["id"]): r for r in rows}
    assert all(by[r["level"] - 1, r["left"]]["phrase"] == r["phrase"].rsplit(" ", 1)[0] and by[r["level"] - 1, r["right"]]["phrase"] == r["phrase"].split(" ", 1)[1] for r in rows if r["level"])
    assert len(by) == len(rows) > 20


def test_empty_table_and_clashing_columns(spark):
    assert phrases.collocations(spark.createDataFrame([], ROWS)).count() == 0
    rows = [("go on", "en", 1, "x", 2)] * 40
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string, code int, phrase string, n int")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "go on", 40, 40, 40, 80, 1000000)]


def test_a_chunk_is_stored_in_rows_of_bounded_size(spark):
    """All keys of a chunk were one row, and a reader holds thousands of rows."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(3000)), "en") for k in range(2)], ROWS)
    state = phrases.chunks(docs.coalesce(1)).collect()
    assert max(len(r["keys"]) for r in state) <= phrases.KEYS
    assert sum(len(r["keys"]) for r in state) == 6000 and sum(r["codes"] is not None for r in state) == len({r["chunk"] for r in state})


def test_packed_places_are_read_back():
    place = np.cumsum(np.random.default_rng(1).integers(1, 1 << 20, 1000))
    ids = np.random.default_rng(2).integers(0, 1 << 62, 1000)
    own, back = phrases._unpack(phrases._pack(place, ids))
    assert (own == place).all() and (back == ids).all()


def test_keys_are_gone_when_the_next_level_is_made(spark, monkeypatch):
    removed, states, remove, paired = [], [], phrases.remove, phrases.paired
    monkeypatch.setattr(phrases, "remove", lambda s, path: (removed.append(path), remove(s, path)))
    monkeypatch.setattr(phrases, "paired", lambda state, names: (states.append((len(removed), state.where("codes IS NULL").count())), paired(state, names))[1])
    every, _ = phrases.phrases(spark.createDataFrame(corpus(5), ROWS), 10)
    assert every.count() and len(states) == 3
    assert all(n and not rows for n, rows in states)


def test_a_turns_keys_are_gone_once_they_are_named(spark, monkeypatch):
    """All turns' keys stood on disk until the last was named, and all chunks' codes until the last of the next level were written."""
    gone, remove = [], phrases.remove
    monkeypatch.setattr(phrases, "remove", lambda s, path: (gone.append(path.rsplit("/", 1)[-1] if "coded=" in path else ""), remove(s, path)))
    every, _ = phrases.phrases(spark.createDataFrame(corpus(5), ROWS), 10, chunk=200)
    turns = [f"turn={k}" for k in range(phrases.TURNS)]
    parts = [f"turn={k}" for k in range(phrases.PARTS)]
    assert every.count() and [x for x in gone if x][: phrases.WORD_TURNS + len(parts) + len(turns)] == [*turns[: phrases.WORD_TURNS], *parts, *turns]


def test_equal_keys_of_all_chunks_are_in_one_turn(spark):
    state = phrases.chunks(spark.createDataFrame(corpus(3), ROWS).repartition(3), 200).where("codes IS NULL").selectExpr("turn", "place", "posexplode(keys) AS (at, k)")
    rows = state.selectExpr("turn", "place + at AS place", "k.lang", "k.word").collect()
    assert len({(r["turn"], r["lang"], r["word"]) for r in rows}) == len({(r["lang"], r["word"]) for r in rows}) < len(rows) == len({r["place"] for r in rows})
    assert len({r["turn"] for r in rows}) == phrases.WORD_TURNS
