"""Tables of codes: list_no, id and code, a BINARY of just the bytes that its bits need.

A search doesn't shuffle codes. The queries go to the tasks in blocks of a checked size, with the lists that each probes; a task
makes a query's tables of distances for a list once, when it meets the list's codes, and looks codes up in them. Tables of codes
are stored in the order of lists, so that a scan for few lists skips the rest of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions.distance import SIMILARITIES
from vexel.functions.kernels import matrix, pairwise
from vexel.operators.flat import FOUND, NAMED, best, probed_blocks
from vexel.plans.storage import materialize, ship


def size_of(widths: list[int]) -> int:
    """Bytes of a code."""
    return (sum(widths) + 7) // 8


def pack(codes: np.ndarray, widths: list[int]) -> np.ndarray:
    """A row of bytes for each row of codes, the bits of each code one after another, least first."""
    if set(widths) <= {8}:
        return codes.astype(np.uint8)
    bits = np.concatenate([(codes[:, j, None] >> np.arange(w)) & 1 for j, w in enumerate(widths)], axis=1) if widths else np.zeros((len(codes), 0))
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")


def unpack(raw: np.ndarray, widths: list[int]) -> np.ndarray:
    if set(widths) <= {8}:
        return raw.astype(np.int64)
    bits = np.unpackbits(raw, axis=1, count=sum(widths), bitorder="little").astype(np.int64)
    ends = np.cumsum(widths)
    return np.stack([bits[:, e - w : e] @ (1 << np.arange(w)) for e, w in zip(ends, widths, strict=True)], axis=1)


def packed(codes: np.ndarray, widths: list[int]) -> pa.Array:
    return pa.array([r.tobytes() for r in pack(codes, widths)], pa.binary())


def unpacked(column: pa.Array, widths: list[int]) -> np.ndarray:
    return unpack(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size_of(widths)), widths)


def _lists(rows: DataFrame) -> Column:
    return F.col("list_no") if "list_no" in rows.columns else F.lit(0).alias("list_no")


def encode(vectors: DataFrame, codec, coarse=None, finer=None) -> DataFrame:
    """list_no (0 if there is none), id and code; of what is left of the list's centre, if coarse gives centres. With finer, also the code of what the first code leaves."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2))
            if coarse is not None:
                x = x - coarse.centres(b.column(0).to_numpy())
            codes = codec.encode(x)
            more = [packed(finer.encode(x - codec.decode(codes)), finer.widths)] if finer else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(codes, codec.widths), *more], ["list_no", "id", "code", *["finer"] * len(more)])

    rows = vectors.where("vec IS NOT NULL").select(_lists(vectors), "id", "vec")
    return rows.mapInArrow(run, "list_no int, id long, code binary" + (", finer binary" if finer else ""))


def residuals(placed: DataFrame, coarse) -> DataFrame:
    """list_no, id and vec less the list's centre."""
    ship(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(matrix(b.column(2)) - coarse.centres(b.column(0).to_numpy())), pa.list_(pa.float64()))], ["list_no", "id", "vec"])

    return placed.select("list_no", "id", "vec").where("vec IS NOT NULL").mapInArrow(run, "list_no int, id long, vec array<double>")


def store(codes: DataFrame) -> DataFrame:
    """Codes in a table in the order of lists; a large list is spread over several files."""
    return materialize(codes.repartitionByRange("list_no", F.xxhash64("id")).sortWithinPartitions("list_no"), "codes")


def decode(codes: DataFrame, codec, coarse=None) -> DataFrame:
    """list_no, id and vec."""
    ship(codes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = codec.decode(unpacked(b.column(2), codec.widths))
            if coarse is not None:
                x = x + coarse.centres(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["list_no", "id", "vec"])

    return codes.select(_lists(codes), "id", "code").mapInArrow(run, "list_no int, id long, vec array<double>")


def search(codes: DataFrame, codec, queries: DataFrame, k: int, metric: str = "l2", probes: DataFrame | None = None, coarse=None, ht: int = 0, where: Column | None = None, radius: float | None = None, finer=None, k_factor: int = 4) -> DataFrame:
    """query_id, id, distance and rank of the k best codes of the probed lists, or of all codes; with radius, all strictly within it, without rank.

    With ht, a code that differs from the query's own in that many bits or more is passed over before its distance is looked up.
    With finer, the k * k_factor best are measured again with their second code.
    """
    ship(codes.sparkSession)
    descending, kept = metric in SIMILARITIES, k * k_factor if finer else k
    direct = hasattr(codec, "distances")
    rows = (codes if where is None else codes.where(where)).select(_lists(codes), "id", "code", *["finer"] * bool(finer))

    def scan(names: np.ndarray, block: np.ndarray, who: dict[int, np.ndarray] | None):
        def of_list(no: int, c: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """A query, rows of c and their distances."""
            asked = np.arange(len(block)) if who is None else who.get(no, ())
            if not len(asked):
                return
            centre = coarse.centres(np.array([no]))[0] if coarse is not None else np.zeros(block.shape[1])
            left, add = (block[asked], block[asked] @ centre) if metric == "ip" else (block[asked] - centre, np.zeros(len(asked)))
            own = codec.encode(block[asked] - centre) if ht else None
            x = None if direct else codec.decode(c)
            for i, q in enumerate(asked):
                near = np.flatnonzero(np.bitwise_count(c ^ own[i]).sum(1) < ht) if ht else np.arange(len(c))
                d = codec.distances(left[i], c[near], metric) if direct else pairwise(metric, left[i : i + 1], x[near])[0]
                yield int(q), near, d + add[i]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                no, ids, c = b.column(0).to_numpy(), b.column(1).to_numpy(), unpacked(b.column(2), codec.widths)
                order = np.argsort(no, kind="stable")
                none, found = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)], []
                for mine in np.split(order, np.flatnonzero(np.diff(no[order])) + 1):
                    for q, near, d in of_list(int(no[mine[0]]), c[mine]):
                        at = mine[near]
                        if radius is not None:
                            keep = np.flatnonzero(d > radius if descending else d < radius)
                        else:
                            keep = np.lexsort((ids[at], -d if descending else d))[:kept]
                        found.append((np.full(len(keep), q), at[keep], d[keep]))
                q, at, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
                more = [b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at))] if finer else []
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(d), *more], ["query_id", "id", "distance", *["list_no", "code", "finer"][: len(more)]])

        return run

    def parts() -> Iterator[DataFrame]:
        for names, block, who in probed_blocks(queries, probes):
            asked = rows if who is None or len(who) > NAMED else rows.where(F.col("list_no").isin(sorted(who)))
            yield asked.mapInArrow(scan(names, block, who), FOUND + (", list_no int, code binary, finer binary" if finer else ""))

    out = reduce(DataFrame.unionByName, parts(), codes.sparkSession.createDataFrame([], FOUND + (", list_no int, code binary, finer binary" if finer else "")))
    if radius is not None:
        return out
    out = best(out, kept, descending)
    return best(_measured_again(out, queries, codec, coarse, finer, metric), k, descending) if finer else out


def _measured_again(found: DataFrame, queries: DataFrame, codec, coarse, finer, metric: str) -> DataFrame:
    """Distances of found rows to what both of their codes say."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = codec.decode(unpacked(b.column(3), codec.widths)) + finer.decode(unpacked(b.column(4), finer.widths))
            if coarse is not None:
                x = x + coarse.centres(b.column(2).to_numpy())
            q = matrix(b.column(5))
            d = (q * x).sum(1) if metric == "ip" else ((q - x) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["query_id", "id", "distance"])

    both = found.join(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")), "query_id")
    return both.select("query_id", "id", "list_no", "code", "finer", "vec").mapInArrow(run, FOUND)
