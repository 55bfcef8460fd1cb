"""Benchmark decontamination with SimHash windows of the size of an item.

Texts become lower-case words of letters and digits, and these shingles of five words (an item of fewer words is one shingle).
A benchmark item of n words is compared with windows of n words. A window that shares no shingle with the item has similarity
zero, and as a window slides, its similarity can only stop growing where a run of equal shingles is wholly inside, or begin to
fall where the window begins with a run; so the windows that are fingerprinted are those that begin with a run, end with one,
or line up with the item at one, each for the item that it shares shingles with. Their 64-bit SimHashes meet the items' in eight blocks of eight bits: a pair within radius 23 has a block that
differs in two bits at most, so equal keys after all such flips of the item's blocks find every pair within the radius. Blocks as wide as that radius asks for tell
few pairs apart, so windows meet only the items that they were cut for, in eight rows a window at most. What meets is
verified by the exact weighted Jaccard similarity of the shingles, weights being their counts.

Only shingles that occur in an item leave a row's own task. The items' tables go by Spark's own size check: broadcast if small, else joined by a shuffle.

Defined results: an item of fewer than five words matches whole texts only, not windows; a null text or item counts as empty and matches nothing; a document shorter than the item is compared
whole; rows are matched each, those that repeat an id or a whole row too; columns other than those named are ignored by ``matches`` and
kept by ``remove_matched``, which drops the rows whose id and text (by its 64-bit hash and length) matched, nulls included. All of it is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.plans.storage import materialize

SHINGLE, SIMILARITY, RADIUS, BLOCK, FLIPS = 5, 0.8, 23, 8, 2


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingles(words: Column) -> Column:
    """A 64-bit hash for each run of five words; for fewer words, one of them all."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))
    return F.when(F.size(words) > SHINGLE, F.slice(each, 1, F.size(words) - SHINGLE + 1)).when(F.size(words) > 0, F.array(F.xxhash64(*[F.get(words, F.lit(k)) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """64 bits; bit b is set if it is in over half of the hashes."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(1).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(bit(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over the sum of the larger counts."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def keys(fingerprint: Column, flips: int = 0) -> Column:
    """Block numbers and values in one integer each, with all flips of so many bits at most."""
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BLOCK), n)]
    blocks = [F.shiftrightunsigned(fingerprint, BLOCK * k).bitwiseAND((1 << BLOCK) - 1).cast("int") + (k << BLOCK) for k in range(64 // BLOCK)]
    flipped = lambda block: F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: block.bitwiseXOR(m))
    return F.flatten(F.array(*[flipped(b) for b in blocks])) if flips else F.array(*blocks)


def items_of(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select("item_id", tokens(F.col("text")).alias("w"))
    rows = rows.select("item_id", F.size("w").alias("n"), shingles(F.col("w")).alias("item_hashes")).where("n > 0")
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "*", simhash(F.col("item_hashes")).alias("item_print")), "items")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, window_start and window_words (in words), hamming and similarity: the best window of each pair that is similar enough."""
    return _found(docs.select(F.struct(F.monotonically_increasing_id().alias("n"), "doc_id").alias("row"), "text"), benchmark).select("row.doc_id", "item_id", "window_start", "window_words", "hamming", "similarity")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = items_of(benchmark)
    spots = items.select("item", "n", "item_hashes", F.posexplode("item_hashes").alias("q", "h")).select(
        "item", "n", "q", "h", F.size("item_hashes").alias("m"), F.get("item_hashes", F.col("q") - 1).alias("h_before"), F.get("item_hashes", F.col("q") + 1).alias("h_after"))
    hashed = docs.select("row", tokens(F.col("text")).alias("w")).select("row", F.size("w").alias("doc_words"), shingles(F.col("w")).alias("hashes"))
    each = hashed.select("row", "doc_words", "hashes", F.posexplode_outer("hashes").alias("p", "h"))  # outer: no filter on the size of hashes, which would be pushed below and compute them twice
    begins = ~F.coalesce(F.get("hashes", F.col("p") - 1) == F.col("h_before"), F.lit(False))
    ends = ~F.coalesce(F.get("hashes", F.col("p") + 1) == F.col("h_after"), F.lit(False))
    fitted = lambda at: F.greatest(F.lit(0), F.least(at, F.col("doc_words") - F.col("n")))
    starts = F.array_distinct(F.array_compact(F.array(fitted(F.col("p") - F.col("q")), F.when(begins, fitted(F.col("p"))), F.when(ends, fitted(F.col("p") - F.col("m") + 1)))))
    placed = each.join(spots, "h").where(begins | ends).select("row", "item", F.col("n").alias("size"), "m", "hashes", F.explode(starts).alias("window_start"))
    windows = placed.select("row", "item", "size", "window_start", F.slice("hashes", F.col("window_start") + 1, F.col("m")).alias("window_hashes")).distinct()
    printed = materialize(windows, "windows").select("*", simhash(F.col("window_hashes")).alias("window_print"))
    left = materialize(printed, "windows").select("*", F.explode_outer(keys(F.col("window_print"))).alias("key"))
    right = items.select("item", "item_id", "item_hashes", "item_print", F.explode_outer(keys(F.col("item_print"), FLIPS)).alias("key"))
    hamming = F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print")))
    met = left.join(right, ["item", "key"]).where(hamming <= RADIUS)
    pairs = met.groupBy("row", "item", "item_id", "window_start").agg(F.any_value("size").alias("window_words"), F.any_value(hamming).alias("hamming"), F.any_value("window_hashes").alias("a"), F.any_value("item_hashes").alias("b"))
    good = pairs.select("row", "item_id", "window_start", "window_words", "hamming", similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    best = Window.partitionBy("row", "item_id").orderBy(F.desc("similarity"), "window_start")
    return good.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def remove_matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that have no match."""
    key = lambda id_, text: F.struct(id_.alias("doc_id"), F.xxhash64(text).alias("h"), F.char_length(text).alias("n"))
    bad = _found(docs.select(key(F.col("doc_id"), F.col("text")).alias("row"), "text"), benchmark).select(F.col("row").alias("bad")).distinct()
    mine = key(docs["doc_id"], docs["text"])
    same = mine["doc_id"].eqNullSafe(bad["bad.doc_id"]) & (mine["h"] == bad["bad.h"]) & (mine["n"] == bad["bad.n"])  # a text that matched isn't null
    return docs.join(bad, same, "left_anti")
