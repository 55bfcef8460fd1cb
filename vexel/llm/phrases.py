"""Collocations by hierarchical pair naming: a k-gram is a pair of (k-1)-grams that overlap, and bears one id in the whole corpus.

Texts are cut into chunks of about ``CHUNK`` bytes of whole texts. A chunk holds a code for each place (-1 between pieces) and a
list of what its codes stand for, with counts: words at first, then at each level the pairs of neighbouring ids. All chunks' lists
meet by key: the counts are summed, each key of ``LEAST`` occurrences or more gets an id, and its id goes back to the chunks, where
it replaces the codes. As a phrase is as frequent as its rarest part at most, no frequent phrase is lost when only ids go
on. What is shuffled is a chunk's distinct keys, so a word of every text is one row a chunk and no key is hot.

A pair's two ids are its parent pointers. Along the left ones lie the counts of a phrase's first words, along the right ones those
of its last, which are the two sides of each cut; and a phrase lies inside a longer frequent one with enough occurrences exactly if
it is a parent of one, as anything between the two occurs at least as often as the longer one.

Rules: texts are lower-cased in A-Z, split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at spaces and tabs. Sums and
products are exact decimals.

Defined results: null and empty texts have no words; a null lang counts as ``und``; repeated rows count as often as they stand there;
ties are broken by phrase in UTF-8 byte order, so ranks are the same in any partitioning; an empty table gives an empty result; a text
longer than ``CHUNK`` is a chunk of its own; more than 2^20 partitions of documents, or 2^11 chunks in one (8 GB of text), raise
ValueError, as a place is a chunk's number and a code in one long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.text import shipped
from vexel.plans.storage import materialize, new_path, release, remove

LEAST, LONGEST, SCALE, INSIDE, TOP, CHUNK = 30, 4, 2_000_000, (100, 80), 2000, 1 << 22
#: Turns in which the words and a level's pairs are shuffled, and parts in which chunks meet their names, so that no more than a share of them is on disk at once.
WORD_TURNS, TURNS, PARTS = 2, 6, 3
#: Keys of a chunk in one row, as a reader takes thousands of rows at once; names that a task packs at once.
KEYS, PACKED = 256, 1 << 20
#: Bytes that end a piece become a line feed, tabs a space, A-Z their lower case.
RULES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A byte that UTF-8 doesn't have, to stand as a word between pieces.
END = b"\xff"
#: Rows of a chunk: one with its codes (turn is the part that the chunk is in), and others with its keys of a turn (codes null), which stand at place and the following ones.
CHUNKS = "chunk long, size long, codes binary, turn int, place long, keys array<struct<{key}, n: long>>"
WORDS, PAIRS = CHUNKS.format(key="lang: string, word: binary"), CHUNKS.format(key="left: long, right: long")


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, places: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * places, "zstd", asbytes=True), "<i4")


def _rows(chunk: int, codes: np.ndarray, turn: np.ndarray, keys: pa.StructArray) -> list[pa.Array]:
    """The columns of a chunk's rows; a row's keys are of one turn."""
    edges = np.r_[0, np.flatnonzero(np.diff(turn)) + 1, len(turn)]
    starts = np.concatenate([np.arange(a, b, KEYS) for a, b in zip(edges[:-1], edges[1:], strict=True)]).astype(np.int64)
    ends = np.r_[0, starts, len(keys)]
    n = 1 + len(starts)
    first = np.r_[0, starts]
    return [pa.array(np.full(n, chunk)), pa.array(np.full(n, len(codes))), pa.array([_packed(codes)] + [None] * (n - 1), pa.binary()), pa.array(np.r_[chunk % PARTS, turn[starts]].astype(np.int32)), pa.array((chunk << 32) + first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)]


def _word_turns(words: pa.Array) -> np.ndarray:
    """The turn of each word, from the sum of its bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.add.reduceat(np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]], ends[:-1], dtype=np.int64) % WORD_TURNS


def _pair_turns(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(TURNS)).astype(np.int64)


def _pack(place: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted places of a chunk and their ids: how many, and the bytes of steps and ids, first bytes first."""
    planes = lambda x, kind: x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(place).to_bytes(4, "little") + pa.compress(planes(np.diff(place, prepend=0), "<u4") + planes(ids, "<i8"), "zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    raw = np.frombuffer(pa.decompress(packed[4:], 12 * n, "zstd", asbytes=True), np.uint8)
    whole = lambda x, kind: np.ascontiguousarray(x.reshape(-1, n).T).view(kind).ravel()
    return np.cumsum(whole(raw[: 4 * n], "<u4").astype(np.int64)), whole(raw[4 * n :], "<i8")


def _cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text (the second column), a text at least."""
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)), np.int64, batch.num_rows)
    share = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]) if len(share) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def chunks(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """Chunks of words (``WORDS``); places with the code -1 stand between pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 11
        last = chunk + (1 << 11)
        if last > 1 << 31:
            raise ValueError("more than 2^20 partitions of documents")
        for batch in batches:
            for part in _cut(batch, most):
                if chunk == last:
                    raise ValueError(f"more than {1 << 11} chunks in a partition of documents")
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append((text or b"").translate(RULES).replace(END, b"\n"))
                codes, turns, keys, done = [], [], [], 0
                for lang, found in texts.items():
                    coded = pa.array(b"\n".join(found).replace(b"\n", b" " + END + b" ").split() + [END], pa.binary()).dictionary_encode()
                    order = pa.compute.sort_indices(coded.dictionary).to_numpy()  # neighbours begin alike; END comes last
                    turn = _word_turns(coded.dictionary)[order[:-1]]
                    dealt = np.argsort(turn, kind="stable")
                    order = np.r_[order[dealt], order[-1]]
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    code, n = rank[coded.indices.to_numpy()], len(order) - 1
                    codes.append(np.where(code == n, -1, code + done))
                    turns.append(turn[dealt])
                    listed = [pa.array([lang] * n, pa.string()), coded.dictionary.take(pa.array(order[:-1])), pa.array(np.bincount(code)[:-1].astype(np.int64))]
                    keys.append(pa.StructArray.from_arrays(listed, ["lang", "word", "n"]))
                    done += n
                codes, turns, keys = np.concatenate(codes), np.concatenate(turns), pa.concat_arrays(keys)
                yield pa.RecordBatch.from_arrays(_rows(chunk, codes, turns, keys), ["chunk", "size", "codes", "turn", "place", "keys"])
                chunk += 1

    return shipped(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, WORDS)


def named(state: DataFrame, key: list[str], least: int) -> DataFrame:
    """The frequent keys of the whole corpus: a row each with id (the first place that has the key), the key and its count f, and beside
    them rows of a chunk with packed, the ids of some of its places. Given the rows of some turns, of the keys of these."""
    rows = state.select("place", F.posexplode("keys").alias("at", "k")).select((F.col("place") + F.col("at")).alias("place"), "k.*")
    same = Window.partitionBy(*key)
    found = rows.withColumns({"f": F.sum("n").over(same), "id": F.min("place").over(same)}).where(F.col("f") >= least).select("place", "id", *key, "f")
    names = ["chunk", "packed", "id", *key, "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            place, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(place)
            place, ids = place[order], ids[order]
            starts = np.r_[0, np.flatnonzero(np.diff(place >> 32)) + 1, len(place)]
            packed = [_pack(place[a:b] & 0xFFFFFFFF, ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(place[starts[:-1]] >> 32), pa.array(packed, pa.binary()), *[pa.nulls(len(packed), k) for k in kinds]], names)

        for b in batches:
            if not b.num_rows:
                continue
            place, ids, kinds = b.column(0).to_numpy(), b.column(1).to_numpy(), [c.type for c in b.columns[1:]]
            first = pa.array(np.flatnonzero(place == ids))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary()), *[c.take(first) for c in b.columns[1:]]], names)
            held.append((place, ids))
            n += len(place)
            if n >= PACKED:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.mapInArrow(run, "chunk long, packed binary, " + ", ".join(f"{c} {kinds[c]}" for c in names[2:]))


def paired(state: DataFrame, names: DataFrame) -> list[DataFrame]:
    """The chunks of the next level (``PAIRS``), a DataFrame for each part of the chunks: pairs of ids at neighbouring places."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        chunk, size = left["chunk"][0].as_py(), left["size"][0].as_py()
        codes = _unpacked(left["codes"][0].as_py(), size)
        pairs = [_unpack(p) for p in right["packed"].to_pylist()]
        own, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(ids)
        ids, own = ids[order], own[order]
        at = np.full(int(codes.max(initial=-1)) + 2, -1)  # the last for code -1
        at[own] = np.arange(len(ids))
        at = at[codes]
        first = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        distinct, code, n = np.unique(at[first] * len(ids) + at[first + 1], return_inverse=True, return_counts=True)
        one, two = ids[distinct // max(len(ids), 1)], ids[distinct % max(len(ids), 1)]
        turn = _pair_turns(one, two)
        dealt = np.argsort(turn.astype(np.uint8), kind="stable")
        rank = np.empty(len(dealt), np.int64)
        rank[dealt] = np.arange(len(dealt))
        out = np.full(max(len(at) - 1, 0), -1)
        out[first] = rank[code]
        keys = pa.StructArray.from_arrays([pa.array(one[dealt]), pa.array(two[dealt]), pa.array(n[dealt].astype(np.int64))], ["left", "right", "n"])
        return pa.Table.from_arrays(_rows(chunk, out, turn[dealt], keys), schema=schema)

    schema = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("turn", pa.int32()), ("place", pa.int64()), ("keys", pa.list_(pa.struct([("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])))])

    def part(k: int) -> DataFrame:
        codes = state.where((F.col("turn") == k) & F.col("codes").isNotNull()).select("chunk", "size", "codes")
        packed = names.where((F.pmod("chunk", F.lit(PARTS)) == k) & F.col("packed").isNotNull()).select("chunk", "packed")
        return codes.groupBy("chunk").cogroup(packed.groupBy("chunk")).applyInArrow(run, PAIRS)

    return [part(k) for k in range(PARTS)]


def exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of 2 to so many words, with parent pointers, and each lang's count of words.

    id, lang, phrase, f, left, right (ids, null for words), starts and ends: the counts of the phrase's first and last 1, 2, ... words."""
    spark, made = docs.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        made.append(new_path(spark, "phrases"))
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    def parted(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The rows with codes and those with keys, of parts written one after another; what a part of the chunks before was made from goes with it."""
        before = made[0] if made else None
        made.append(path := new_path(spark, "phrases"))
        for k, part in enumerate(parts):
            part.withColumn("coded", F.col("codes").isNotNull()).write.mode("append").option("compression", "zstd").partitionBy("coded", "turn").parquet(path)
            release(spark)
            if before:
                remove(spark, f"{before}/coded=true/turn={k}")
        read = spark.read.schema(parts[0].schema.add("coded", "boolean")).option("basePath", path).parquet(path)
        return read.where("coded").drop("coded"), read.where("NOT coded").drop("coded")

    def in_turns(key: list[str], turns: int) -> DataFrame:
        """The names of all keys; a turn's keys go as soon as they are named."""
        names, folder = None, made[-1]
        for turn in range(turns):
            part = written(named(keys.where(F.col("turn") == turn), key, least))
            names = part if names is None else names.union(part)
            release(spark)
            remove(spark, f"{folder}/coded=false/turn={turn}")
        return names

    state, keys = parted([chunks(docs, chunk)])
    totals = materialize(keys.select(F.explode("keys").alias("k")).groupBy("k.lang").agg(F.sum("k.n").alias("n")), "totals")
    names = in_turns(["lang", "word"], WORD_TURNS)
    f = F.col("f")
    level = names.where("packed IS NULL").select("id", "lang", F.col("word").cast("string").alias("phrase"), "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.array(f).alias("starts"), F.array(f).alias("ends"))
    level, every = materialize(level, "phrases"), None
    for _ in range(longest - 1):
        state, keys = parted(paired(state, names))
        while len(made) > 1:  # the level before isn't needed any more
            remove(spark, made.pop(0))
        names = in_turns(["left", "right"], TURNS)
        pairs = names.where("packed IS NULL").select("id", "left", "right", "f")
        a = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("front"), F.col("starts").alias("before"))
        b = level.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("last"), F.col("ends").alias("after"))
        level = materialize(pairs.join(a, "left").join(b, "right").select("id", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "f", "left", "right", F.concat("before", F.array(f)).alias("starts"), F.concat("after", F.array(f)).alias("ends")), "phrases")
        every = level.withColumn("level", F.lit(0)) if every is None else every.union(level.withColumn("level", F.size("starts") - 2))
    for path in made:
        remove(spark, path)
    return every, totals


def scored(every: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that aren't dropped: the cut of least score, of the least first part among those."""
    cuts = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda k: F.struct(F.element_at("starts", k).alias("l"), F.element_at("ends", F.size("starts") - k).alias("r"), k.alias("k")))
    value = lambda c: F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * exact(F.col("f")), exact(c["l"]) + exact(c["r"]))
    best = F.array_min(F.transform(cuts, lambda c: F.struct(value(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    inside = every.where("level > 0").select(F.explode(F.array(F.struct("level", F.col("left").alias("id")), F.struct("level", F.col("right").alias("id")))).alias("p"), "f").groupBy((F.col("p.level") - 1).alias("level"), F.col("p.id").alias("id")).agg(F.max("f").alias("longer"))
    whole, part = INSIDE
    kept = every.join(inside, ["level", "id"], "left").where(F.col("longer").isNull() | (exact(F.col("longer")) * whole < exact(F.col("f")) * part))
    return kept.select("lang", "phrase", F.col("f").alias("a"), best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each lang, with rank: the best of ever fewer parts, so no task sorts a whole lang."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    while parts > 1:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
        parts = int(parts**0.5)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    every, totals = phrases(docs, least, chunk=chunk)
    return ranked(scored(every), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
