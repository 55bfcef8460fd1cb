"""Near-duplicates by SimHash: every pair of fingerprints within three bits, without comparing all pairs.

Equal fingerprints are one class from the start. The distinct ones, sorted by population count, are cut into tiles; two tiles are
compared exactly with exclusive-or and bit counts in numpy, unless their population counts differ by more than the radius. So
that this doesn't grow with the square of the table, a tile meets only tiles of its own bucket: of four blocks of 16 bits one at
least agrees between fingerprints that differ in three bits or fewer, so each fingerprint goes to four buckets, one for each
block's first bits, and every close pair meets in one. So many bits are taken that a bucket has about ``SHARE`` fingerprints; a
table of no more is one bucket, compared whole. A bucket of more than ``MOST`` isn't held: it flows through its task and is split
by its other 48 bits in the same way, into four blocks of 12. A bucket hands on a star, each member linked to the least of its
group, so links grow with members and not with pairs. Components are then found by the large-star and
small-star rounds of Kiveris et al. (2014), with each round's links in a table in the shared folder.

Defined results: null and blank texts have fingerprint zero and are linked like others; a null doc_id never names a
component unless all its ids are null; repeated rows are rows of their own in ``components``, and ``keep_one`` keeps
one row of each component, with all columns; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.text import ascii_words, cut, shipped
from vexel.plans.storage import materialize

RADIUS, SEED, TILE, STEP, SHARE, MOST = 3, 42, 512, 1 << 15, 1 << 12, 1 << 16
BLOCKS, WIDTH, FINER = 4, 16, 12


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in over half of the hashes of the three-word shingles, repeats included."""
    words = ascii_words(text)
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    one, digest, counts = b" ".join, xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(words) - 2, STEP):
        part = words[k : k + STEP + 2]
        raw = b"".join([digest(one(s), SEED) for s in zip(part, part[1:], part[2:])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(words) - 2).tobytes(), "big")


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id and print, the fingerprint as a signed long; if hashed, also h, a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 1000):
            made = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), *batch.columns[2:]], ["doc_id", "print", *batch.schema.names[2:]])

    more = [F.xxhash64("text").alias("h")] if hashed else []
    return shipped(docs).select("doc_id", "text", *more).mapInArrow(run, "doc_id long, print long" + (", h long" if hashed else ""))


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def buckets(prints: Column, bits: int = WIDTH) -> Column:
    """The keys of a fingerprint: a block's number and its first bits; a single one where bits is 0."""
    if not bits:
        return F.array(F.lit(0).cast("long"))
    return F.array(*[F.shiftrightunsigned(prints, WIDTH * k).bitwiseAND((1 << bits) - 1) + (k << WIDTH) for k in range(BLOCKS)])


def bits_for(distinct: int) -> int:
    """So many bits of a block that a bucket has about SHARE of so many fingerprints; all 16 at most."""
    return min(WIDTH, max(0, math.ceil(math.log2(max(distinct, 1) / SHARE))))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of each pair (i, j); root holds the least member of each one's group."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root[:] = above


def tiled(prints: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """For distinct fingerprints sorted by population count: each one's group, as the place of its first member."""
    ones, root = np.bitwise_count(prints).astype(np.int16), np.arange(len(prints))
    for a in range(0, len(prints), tile):
        left = prints[a : a + tile]
        for b in range(a, len(prints), tile):
            if ones[b] - ones[min(a + tile, len(prints)) - 1] > radius:
                break
            right = prints[b : b + tile]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            _unite(root, i + a, j + b)
    return root


def _links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over whole buckets, given sorted by key and population count."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes, root = np.diff(np.r_[starts, len(keys)]), np.arange(len(keys))
    for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
        root[s : s + n] = tiled(prints[s : s + n]) + s
    member = np.flatnonzero(root != np.arange(len(keys)))
    return prints[member], prints[root[member]]


def _split(key: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the second level and fingerprints, four for each fingerprint of a bucket of the first; the shared block is turned out of the way."""
    shared = np.uint64(WIDTH * (key >> WIDTH) + WIDTH & 63)
    rest = prints >> shared | prints << (np.uint64(64) - shared & np.uint64(63))
    keys = [rest >> np.uint64(FINER * n) & np.uint64((1 << FINER) - 1) | np.uint64(n << FINER | key << FINER + 2) for n in range(BLOCKS)]
    return np.concatenate(keys).view(np.int64), np.tile(prints, len(keys)).view(np.int64)


def _within(keyed: DataFrame, most: int | None) -> DataFrame:
    """a, b and more: links within the buckets of key and print; where more is set, a is a fingerprint and b its bucket of the second level."""
    def told(a: np.ndarray, b: np.ndarray, more: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), more))], ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, large = np.zeros((2, 0), np.int64), None
        for batch in _and_end(batches):
            if batch is not None:
                rows = np.concatenate([rows, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
            if large is not None and rows.shape[1]:  # the bucket that is being split goes on
                n = int(np.searchsorted(rows[0], large, side="right"))
                keys, prints = _split(large, rows[1, :n].view(np.uint64))
                yield told(prints, keys, True)
                rows, large = rows[:, n:], large if n == rows.shape[1] else None
            cut = rows.shape[1] if batch is None else int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            if cut:
                a, b = _links(rows[0, :cut], rows[1, :cut].view(np.uint64))
                yield told(a.view(np.int64), b.view(np.int64), False)
                rows = rows[:, cut:]
            if most is not None and rows.shape[1] > most:
                large = int(rows[0, 0])
                keys, prints = _split(large, rows[1].view(np.uint64))
                yield told(prints, keys, True)
                rows = rows[:, :0]

    dealt = keyed.repartition("key").sortWithinPartitions("key", F.bit_count("print"), "print").select("key", "print")
    return dealt.mapInArrow(run, "a long, b long, more boolean")


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """a and b: linked fingerprints, a star for each bucket, from the distinct fingerprints in the column print."""
    bits = bits_for(classes.count())
    first = materialize(_within(classes.select(F.explode(buckets(F.col("print"), bits)).alias("key"), "print"), most), "links")
    second = _within(first.where("more").select(F.col("b").alias("key"), F.col("a").alias("print")), None)
    return first.where("NOT more").select("a", "b").union(second.select("a", "b"))


def _and_end(batches):
    yield from batches
    yield None


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """a and b: each linked node other than the least of its component, and that least one."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return edges
        state = now
    raise RuntimeError("components did not settle")


def _components(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """fingerprints() with root, the fingerprint that stands for the component, and component_id."""
    prints = materialize(fingerprints(docs, hashed), "prints")
    classes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = connected(links(classes)).select(F.col("a").alias("print"), F.col("b").alias("root"))
    rooted = classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = materialize(rooted.join(named, "root").select("print", "root", "component_id"), "components")
    return prints.join(by_print, "print")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, print and component_id (the least doc_id that links reach) for each row."""
    return _components(docs).select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least doc_id (null if all are), and of rows that share it the first by text."""
    found = _components(docs.select("doc_id", "text"), hashed=True)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h")).agg(F.count("*").alias("rows"))
    kept = materialize(kept, "kept")
    each = materialize(kept.join(kept.groupBy("root").agg(F.sum("rows").alias("all")), "root").select(F.col("root").alias("kept_root"), "kept_id", "kept_h", "all"), "kept")
    once, more = each.where("all = 1"), each.where("all > 1")
    same = lambda k: docs["doc_id"].eqNullSafe(k["kept_id"]) & (F.xxhash64(docs["text"]) == k["kept_h"])
    single = docs.join(once, same(once), "left_semi")
    repeated = docs.join(more, same(more)).select(more["kept_root"].alias("root"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    first = repeated.groupBy("root").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row"))
    return single.unionByName(first.select("row.*"))
