"""Spelling variants: words of a vocabulary at distance one, by a self-join of prefix-partitioned tries with active-node sets.

The vocabulary comes from whole texts: maximal runs of Latin letters with A-Z lower-cased; a run loses the code point h % length
where h, the CRC-32 of ``<doc_id>:<run>``, divides by 31. Words are distinct results of ``LEAST_CHARS`` code points and
``LEAST_COUNT`` occurrences at least.

Two words within one inserted, deleted or replaced code point share either their first ``PREFIX`` code points or, as the edit then
stands among those, their last ``SUFFIX``. So the trie of the words is dealt out by first code points, and the trie of
the words spelled backwards by last ones; each part is a subtrie, and every near pair meets in a part. A part
of more than ``MOST`` words is not held by a task: its subtrie is dealt out once more, a level deeper, and pairs that part at
that level (one replaces a code point there, or has one more) are joined by what they spell without it.

In a part, nodes go down level by level. The active nodes of a node are those within distance one of it: itself, and the pairs made by
replacing one code point or inserting one; a pair goes on only to children with the same code point, so it is dropped as soon as it
is two apart. Of the places where an insertion could stand, the last counts, so each pair of words is emitted once. All nodes
of a level are one numpy step.

Defined results: null and blank texts have no words; a null doc_id counts as empty in ``<doc_id>:<run>``; repeated rows count as often
as they stand there; a word without near words has null for its form and is its own root; an empty table gives an empty result;
runs of any length are words like others.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.text import cut, shipped
from vexel.plans.storage import materialize

LEAST_CHARS, LEAST_COUNT, SLIP, TIMES = 7, 2, 31, 10
PREFIX, SUFFIX, MOST, HELD = 3, 4, 1 << 12, 1 << 16
#: What each Latin-1 byte becomes: letters stay, A-Z in lower case, all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The runs of a text in Latin-1, a byte for each code point, lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def slipped(doc_id: bytes, run: bytes) -> bytes:
    """The run as this document spells it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc_id + b":"))
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word and n over all texts, of words long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 4000):
            seen: Counter[bytes] = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = (doc_id or "").encode()
                for r, n in Counter(r for r in runs_of(text) if len(r) >= LEAST_CHARS).items():
                    seen[slipped(name, r)] += n
            kept = [(w.decode("latin-1"), n) for w, n in seen.items() if len(w) >= LEAST_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    rows = shipped(docs).select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _children(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its child node, and for each child its parent and label; rows are sorted, so equal ones are neighbours."""
    first = np.r_[True, (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])] if len(parent) else np.zeros(0, bool)
    return np.cumsum(first) - 1, parent[first], label[first]


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Level:
    """Nodes of one depth: their children by label, and the word that ends at each."""

    def __init__(self, parent: np.ndarray, label: np.ndarray, nodes: int):
        self.begin = np.searchsorted(parent, np.arange(nodes + 1))
        self.parent, self.label, self.keys = parent, label, parent << 9 | label

    def of(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of each node, and which of the given nodes each belongs to."""
        sizes = self.begin[u + 1] - self.begin[u]
        which = np.repeat(np.arange(len(u)), sizes)
        return np.repeat(self.begin[u], sizes) + _ragged(sizes), which

    def step(self, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node under a label, or -1."""
        if not len(self.keys):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.keys, want := v << 9 | label), len(self.keys) - 1)
        return np.where(self.keys[at] == want, at, -1)


def near_pairs(part: list[int], words: list[bytes], skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of one part at distance one whose first skip bytes are equal; words are distinct within a part, any order.

    Levels hold each distinct beginning once: ``same`` pairs replace a byte and stand at one depth, ``deeper`` pairs have one more byte in the second."""
    if not words:
        return np.zeros(0, int), np.zeros(0, int)
    size = np.array([len(w) for w in words])
    order = np.array(sorted(range(len(words)), key=lambda k: (part[k], words[k])))
    flat, offset = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    size, offset, part = size[order], offset[order], np.asarray(part)[order]
    rows = np.arange(len(order))  # those that reach this depth
    _, at = np.unique(part, return_inverse=True)  # a root for each part
    none = np.zeros(0, np.int64)
    levels: list[tuple[_Level, np.ndarray]] = []  # children of the nodes of each depth, and the word that ends at each node or -1
    depth, nodes = skip, int(at.max()) + 1
    at = at.astype(np.int64)
    while True:
        ends = size[rows] == depth
        word = np.full(nodes, -1)
        word[at[ends]] = order[rows[ends]]
        rows, at = rows[~ends], at[~ends]
        child, parent, label = _children(at, flat[offset[rows] + depth].astype(np.int64))
        levels.append((_Level(parent, label, nodes), word))
        if not len(rows):
            break
        at, nodes, depth = child, len(parent), depth + 1
    found_a, found_b = [], []
    same = none, none  # u, v at this depth
    deeper = none, none, none  # u at this depth, v one deeper, and the label that u may not go on with (-1: any)
    for k, (level, word) in enumerate(levels):
        below, below_word = levels[k + 1] if k + 1 < len(levels) else (_Level(none, none, 0), none)
        u, v = same
        both = (word[u] >= 0) & (word[v] >= 0)
        found_a.append(word[u][both])
        found_b.append(word[v][both])
        kids = np.arange(len(level.parent))  # node numbers of the next depth
        grown = np.r_[deeper[0], level.parent], np.r_[deeper[1], kids], np.r_[deeper[2], level.label]
        u, v, but = grown
        both = (word[u] >= 0) & (below_word[v] >= 0) if len(v) else np.zeros(0, bool)
        found_a.append(word[u][both])
        found_b.append(below_word[v][both])
        # the next depth: a pair goes on under one label
        c, which = level.of(same[0])
        d = level.step(same[1][which], level.label[c])
        on = d >= 0
        more = level.begin[level.parent + 1] - 1 - kids  # siblings after each child
        same = np.r_[c[on], np.repeat(kids, more)], np.r_[d[on], np.repeat(kids, more) + 1 + _ragged(more)]
        c, which = level.of(u)
        d = below.step(v[which], level.label[c]) if len(c) else none
        on = (d >= 0) & (level.label[c] != but[which]) if len(c) else np.zeros(0, bool)
        deeper = c[on], d[on], np.full(int(on.sum()), -1)
    return np.concatenate(found_a), np.concatenate(found_b)


def _joined(keyed: DataFrame) -> DataFrame:
    """word, n, near, m: the near pairs within the parts of key; so many whole parts are taken at once as have ``HELD`` words, or one larger part."""
    def emit(keys: list[str], words: list[str], n: list[int]) -> pa.RecordBatch:
        backward = np.array([k[0] == "<" for k in keys])
        skip = np.array([len(k) - 1 for k in keys])
        ids = np.unique(np.array(keys, str), return_inverse=True)[1].tolist()
        spelled = [w.encode("latin-1") for w in words]
        spelled = [s[::-1] if back else s for s, back in zip(spelled, backward.tolist(), strict=True)]
        found = []
        for s in np.unique(skip).tolist():
            mine = np.flatnonzero(skip == s)
            a, b = near_pairs([ids[k] for k in mine.tolist()], [spelled[k] for k in mine.tolist()], s)
            found.append((mine[a], mine[b]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        new = ~backward[a] | np.array([words[i][:PREFIX] != words[j][:PREFIX] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[new], b[new]
        w, c = np.array(words, object), np.array(n)
        return pa.RecordBatch.from_arrays([pa.array(w[a], pa.string()), pa.array(c[a], pa.int64()), pa.array(w[b], pa.string()), pa.array(c[b], pa.int64())], ["word", "n", "near", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, n = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            words += batch.column(1).to_pylist()
            n += batch.column(2).to_pylist()
            if len(keys) > HELD and keys[0] != keys[-1]:
                end = keys.index(keys[-1])
                yield emit(keys[:end], words[:end], n[:end])
                keys, words, n = keys[end:], words[end:], n[end:]
        if keys:
            yield emit(keys, words, n)

    return keyed.select("key", "word", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, n long, near string, m long")


def _parted_here(large: DataFrame) -> DataFrame:
    """word, n, near, m: pairs of a large part that part right after what its key spells, joined by what they spell without that code point."""
    rows = large.select("key", "word", "n", F.col("s").alias("rest"))
    out = F.expr("substring(s, length(key), 1)")
    less = large.where(out != "").select("key", F.expr("concat(substring(s, 1, length(key) - 1), substring(s, length(key) + 1))").alias("rest"), F.col("word").alias("near"), F.col("n").alias("m"), out.alias("out"))
    other = less.select("key", "rest", F.col("near").alias("word"), F.col("m").alias("n"), F.col("out").alias("instead"))
    replaced = other.join(less, ["key", "rest"]).where("instead < out")
    inserted = rows.join(less, ["key", "rest"]).where("substring(rest, length(key), 1) <> out")  # else the code point could stand further on
    told = [F.col(c) for c in ("key", "word", "n", "near", "m")]
    new = F.col("key").startswith(">") | (F.substring("word", 1, PREFIX) != F.substring("near", 1, PREFIX))
    return replaced.select(told).union(inserted.select(told)).where(new).select(told[1:])


def pairs(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, near, m: each pair of near words of word and n once, from words of ``LEAST_CHARS`` code points at least."""
    backward = F.reverse("word")
    forward = F.struct(F.concat(F.lit(">"), F.substring("word", 1, PREFIX)).alias("key"), F.col("word").alias("s"))
    keyed = vocabulary.select(F.explode(F.array(forward, F.struct(F.concat(F.lit("<"), F.substring(backward, 1, SUFFIX)).alias("key"), backward.alias("s")))).alias("e"), "word", "n").select("e.key", "e.s", "word", "n")
    found = None
    while True:  # a turn for each level that large parts are dealt out again
        full = materialize(keyed.groupBy("key").count().where(F.col("count") > most).select("key"), "large-parts")
        split = full.limit(1).count() > 0
        small = _joined(keyed.join(full, "key", "left_anti") if split else keyed)
        found = small if found is None else found.union(small)
        if not split:
            return found
        large = materialize(keyed.join(full, "key", "left_semi"), "large-parts")
        found = found.union(_parted_here(large))
        keyed = large.where("length(s) >= length(key)").withColumn("key", F.expr("concat(substring(key, 1, 1), substring(s, 1, length(key)))"))


def forms(vocabulary: DataFrame, near: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: each word with its near word of largest n, if that has ``TIMES`` as many occurrences."""
    both = near.union(near.select("near", "m", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    is_form = -F.col("best.m") >= TIMES * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word and root of the words that have a form: each turn follows the links twice as far; counts grow tenfold a link, so there are five turns at most."""
    links = materialize(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return links


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    vocabulary = materialize(count_words(docs).where(F.col("n") >= LEAST_COUNT), "vocabulary")
    formed = materialize(forms(vocabulary, materialize(pairs(vocabulary, most), "near-words")), "formed")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
