"""Repeated strings by bucket-pointer refinement over a sparse suffix array: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Suffixes are sorted into buckets only as far as it takes to tell strings of ``LENGTH`` apart, and only those that can still
have an equal.

1. Initial buckets: each window of ``LENGTH`` bytes belongs to its least ``GRAM``-byte string by hash (winnowing), so equal windows have the same
   string at the same place and meet in its bucket. Neighbouring windows of one string are one row: its bucket, and the
   name of the text that they cover together.
2. Sorting a bucket by those names: a row whose name stands earlier has only windows that start earlier. If all rows
   of a bucket have one name, the first has none. What's left are first rows of several names in a bucket: strings at the border of
   repeated text.
3. Refinement: these are sorted on the identifiers of buckets at later offsets. A window has ``HALF`` = (LENGTH - GRAM) / 2 bytes or more on one side of
   its string; rows with the same bucket and the same bytes there share a bucket of GRAM + HALF bytes. A window whose bucket of
   that level has one row is done.
4. The identifiers are used again: windows of a shared bucket are sorted on (bucket, offset, rest of the window). All but the
   first of each are repeated.

Each task first does this for its own texts (whole texts of about ``SPAN`` bytes at once): what repeats there is told at once, and a
bucket gets one row of each name from a task, so a passage of a third of all texts makes a row a task. Names and buckets are
hashes: 64 bits for the bucket, another 64 for the name in it.

Defined results: null and empty texts have nothing to remove; texts of fewer than ``LENGTH`` bytes are kept; windows don't cross texts;
rows that share a doc_id are ordered by their bytes, and equal ones as they come, as if they had ids of their own in this order;
a null doc_id comes before all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.text import shipped
from vexel.plans.storage import materialize

LENGTH, GRAM, SPAN, ROWS = 100, 32, 1 << 22, 20_000
WINDOWS, HALF = LENGTH - GRAM + 1, (LENGTH - GRAM) // 2
#: Odd multiplier of the rolling hash, and what a byte counts in it.
BASE = 0x9E3779B97F4A7C15
VALUE = np.random.default_rng(12).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Low bits that hold a place; parts of texts that together have fewer bytes.
PLACE, PART = (1 << 24) - 1, 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)


def grams(raw: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    n = len(raw)
    if n < GRAM:
        return np.zeros(0, np.uint64)
    _Powers.reach(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUE[np.frombuffer(raw, np.uint8)] * _Powers.up[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * _Powers.down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def winnowed(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last start of the windows that share a least string, its place and its bucket; texts end at ``ends`` and have fewer than 2^24 bytes together."""
    none = np.zeros(0, np.int64)
    h = grams(raw)
    if len(h) < WINDOWS:
        return none, none, none, none
    least = keys = h & np.uint64(~PLACE & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64)  # of equal ones the first
    k = 1
    while 2 * k <= WINDOWS:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    count = len(keys) - WINDOWS + 1
    at = (np.minimum(least[:count], least[WINDOWS - k : WINDOWS - k + count]) & np.uint64(PLACE)).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(len(raw) + 1, np.int32)  # windows that don't cross texts
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:count]) > 0
    new = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]
    new[ends[ends < count]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], count] - 1
    first, last = first[inside[first]], last[inside[first]]
    return first, last, at[first], h[at[first]].view(np.int64)


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, a row at least."""
    share = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]).tolist() if len(sizes) else []
    yield from zip(starts, [*starts[1:], len(sizes)], strict=True)


def _first_of(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether a row is the first of its equals in ``same``, in the order given (least important key first)."""
    by = np.lexsort((*order, *same))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in same])
    out = np.empty(len(by), bool)
    out[by] = new
    return out


def rows_of(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows of neighbouring windows: deal (the bucket), name, key (of the text) and spot: start of the first window, how many more there are and how far the string is from it, in one long.

    Rows without a name are those that a task knows to start earlier in its own texts; they have nothing to meet and are dealt evenly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), [t or b"" for t in batch.column(1).to_pylist()]
            # parts of long texts overlap, so that each window is in one
            parts = [(k, c, t if len(t) < PART else t[c : c + PART + LENGTH - 1]) for k, t in enumerate(texts) for c in range(0, max(len(t) - LENGTH + 1, 1), PART)]
            for c, d in _spans(np.array([len(p[2]) for p in parts], np.int64), span):
                yield emit(keys, parts[c:d])

    def emit(keys: np.ndarray, parts: list) -> pa.RecordBatch:
        raw = b"".join(p[2] for p in parts)
        ends = np.cumsum([len(p[2]) for p in parts])
        first, last, at, bucket = winnowed(raw, ends)
        of = np.searchsorted(ends, first, side="right")
        shift = np.array([p[1] for p in parts], np.int64)[of] - np.r_[0, ends[:-1]][of] if len(of) else first
        key = keys[np.array([p[0] for p in parts], np.int64)[of]] if len(of) else first
        digest = xxhash.xxh3_64_intdigest
        name = np.array([digest(raw[x:y]) for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.uint64).view(np.int64)
        start = first + shift
        known = ~_first_of((start, key), (name, bucket))
        deal = np.where(known, _scattered(key, start), bucket)
        spot = start << 16 | (last - first) << 8 | at - first
        return pa.RecordBatch.from_arrays([pa.array(deal, pa.int64()), pa.array(name, pa.int64(), mask=known), pa.array(key, pa.int64()), pa.array(spot, pa.int64())], ["deal", "name", "key", "spot"])

    return shipped(docs).select("key", "text").mapInArrow(run, "deal long, name long, key long, spot long")


def _scattered(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for each row, for dealing it out."""
    h = (key.astype(np.int64).view(np.uint64) * np.uint64(BASE)) ^ start.astype(np.int64).view(np.uint64)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sorted_in_buckets(rows: DataFrame) -> DataFrame:
    """key, spot and bucket: rows of which all windows start earlier (bucket null), and those at borders (with their bucket)."""
    order = Window.partitionBy("deal").orderBy("name", "key", "spot")
    again = F.col("name").isNull() | F.coalesce(F.lag("name").over(order) == F.col("name"), F.lit(False))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = rows.withColumns({"again": again, "several": F.max("name").over(whole) != F.min("name").over(whole)})
    return found.where("again OR several").select("key", "spot", F.when(~F.col("again"), F.col("deal")).alias("bucket"))


def zipped(rows: DataFrame) -> DataFrame:
    """key, doc_id, size and packed: texts as they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = [pa.compress(t, "zstd", asbytes=True) if t else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary())], ["key", "doc_id", "size", "packed"])

    return shipped(rows).select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, size long, packed binary")


def unzipped(size: int, packed: bytes) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if size else b""


def with_text(border: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows at borders with the text that their windows cover; texts as ``zipped`` makes them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part, covered = batch.slice(k, 500), []
                buckets, spots = part.column(3).flatten(), part.column(4).flatten().to_numpy()
                counts = part.column(3).value_lengths().to_numpy()
                begin, more = (spots >> 16).tolist(), (spots >> 8 & 255).tolist()
                done = 0
                for size, packed, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), counts.tolist(), strict=True):
                    text = unzipped(size, packed)
                    covered += [text[begin[i] : begin[i] + more[i] + LENGTH] for i in range(done, done + n)]
                    done += n
                keys = np.repeat(part.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([buckets, pa.array(keys), pa.array(spots), pa.array(covered, pa.binary())], ["bucket", "key", "spot", "covered"])

    listed = border.groupBy("key").agg(F.collect_list(F.struct("bucket", "spot")).alias("rows"))  # of one text
    both = texts.join(listed, "key").select("key", "size", "packed", F.col("rows.bucket").alias("buckets"), F.col("rows.spot").alias("spots"))
    return both.mapInArrow(run, "bucket long, key long, spot long, covered binary")


def refined(rows: DataFrame) -> DataFrame:
    """key and start of the windows at borders that also start earlier, from rows with their text."""
    rows = rows.select("bucket", "key", "spot", F.shiftright("spot", 8).bitwiseAND(255).cast("int").alias("more"), F.col("spot").bitwiseAND(255).cast("int").alias("at"), "covered")
    deeper = lambda side, place: F.xxhash64(F.lit(side), "bucket", F.expr(f"substring(covered, {place}, {GRAM + HALF})"))
    right = F.when(F.col("at") - F.col("more") < HALF, F.struct(F.lit(0).alias("side"), deeper(0, "at + 1").alias("deeper")))
    left = F.when(F.col("at") >= HALF, F.struct(F.lit(1).alias("side"), deeper(1, f"at + 1 - {HALF}").alias("deeper")))
    sides = rows.select("bucket", "key", "spot", "covered", F.explode(F.array(right, left)).alias("s")).where("s IS NOT NULL").select("bucket", "key", "spot", "covered", "s.side", "s.deeper")
    shared = sides.groupBy("deeper").agg(F.count("*").alias("rows")).where("rows > 1").select("deeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield windows(batch.slice(k, ROWS))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, key, spot, side = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
        start, more, at = spot >> 16, spot >> 8 & 255, spot & 255
        low = np.where(side == 0, np.maximum(at - HALF + 1, 0), 0)  # windows with fewer than HALF bytes before the string go by its right side
        high = np.where(side == 0, more, np.minimum(more, at - HALF))
        n = np.maximum(high - low + 1, 0)
        which = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
        covered, digest = batch.column(4).to_pylist(), xxhash.xxh3_64_intdigest
        name = np.array([digest(covered[w][o : o + LENGTH]) for w, o in zip(which.tolist(), offset.tolist(), strict=True)], np.uint64).view(np.int64)
        key, start = key[which], start[which] + offset
        deal = (bucket[which].view(np.uint64) * np.uint64(BASE) + (at[which] - offset).view(np.uint64)).view(np.int64)  # bucket and offset
        known = ~_first_of((start, key), (name, deal))
        return pa.RecordBatch.from_arrays([pa.array(np.where(known, _scattered(key, start), deal)), pa.array(name, mask=known), pa.array(key), pa.array(start)], ["deal", "name", "key", "start"])

    live = shipped(sides.join(shared, "deeper")).select("bucket", "key", "spot", "side", "covered")
    found = live.mapInArrow(run, "deal long, name long, key long, start long")
    same = Window.partitionBy("deal", "name").orderBy("key", "start")
    return found.withColumn("k", F.lag("start").over(same)).where("name IS NULL OR k IS NOT NULL").select("key", "start")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary) and key, a long in the order of doc_id that no two rows share: doc_id itself unless some share it or have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    odd = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1 OR doc_id IS NULL")
    if not odd.limit(1).count():
        return rows.withColumn("key", F.col("doc_id"))
    return materialize(rows.orderBy(F.asc_nulls_first("doc_id"), "text").withColumn("key", F.monotonically_increasing_id()), "keyed")


def spans(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """key, start, more: windows from start to start + more all start earlier; from rows with doc_id, key and text."""
    found = materialize(sorted_in_buckets(rows_of(rows, span)), "buckets")
    border = materialize(with_text(found.where("bucket IS NOT NULL"), zipped(rows)), "borders")
    again = found.where("bucket IS NULL").select("key", F.shiftright("spot", 16).alias("start"), F.shiftright("spot", 8).bitwiseAND(255).cast("int").alias("more"))
    return again.union(refined(border).select("key", "start", F.lit(0).alias("more")))


def _removed(text: bytes, start: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows cover."""
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + more + LENGTH, -1)
    covered = np.r_[False, np.cumsum(edges[:-1]) > 0, False]
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    return turns[::2], turns[1::2]


def deduplicated(docs: DataFrame, span: int = SPAN, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), or kept_sha256 if digest, for each row."""
    last, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                first, starts, mores = part.column(3).offsets.to_numpy(), part.column(3).values.to_numpy(), part.column(4).values.to_numpy()
                told_of = zip(*(c.to_pylist() for c in part.columns[:3]), first[:-1].tolist(), first[1:].tolist(), strict=True)
                yield pa.RecordBatch.from_pylist([told(doc_id, unzipped(size, packed), starts[a:b], mores[a:b]) for doc_id, size, packed, a, b in told_of], schema=schema)

    def told(doc_id: int | None, text: bytes, start: np.ndarray, more: np.ndarray) -> dict:
        begin, end = _removed(text, start, more)
        kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)) if len(begin) else text
        return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(begin), last: hashlib.sha256(kept).hexdigest() if digest else kept}

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), (last, pa.string() if digest else pa.binary())])
    rows = keyed(docs)
    by_text = spans(rows, span).groupBy("key").agg(F.collect_list(F.struct("start", "more")).alias("windows"))  # of one text
    none = lambda kind: F.array().cast(f"array<{kind}>")
    both = zipped(rows).join(by_text, "key", "left").select("doc_id", "size", "packed", F.coalesce("windows.start", none("long")).alias("starts"), F.coalesce("windows.more", none("int")).alias("mores"))
    return both.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")
