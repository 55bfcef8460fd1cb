"""Distances between blocks of vectors in numpy, for Arrow operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vexel.functions.distance import SIMILARITIES

__all__ = ["CELLS", "SIMILARITIES", "Nearest", "direct", "matrix", "pairwise", "tiles"]

#: Distances that a task holds at once.
CELLS = 1 << 21


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def pairwise(metric: str, q: np.ndarray, x: np.ndarray, p: float = 3.0) -> np.ndarray:
    if metric == "hamming":  # words, not vectors
        return np.bitwise_count((q[:, None] ^ x[None]).view(np.uint64)).astype(np.float64)
    if metric in ("ip", "cosine"):
        if metric == "cosine":
            unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
            q, x = unit(q), unit(x)
        return q @ x.T
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] - 2 * (q @ x.T) + (x**2).sum(1)[None, :], 0)
    out = np.empty((len(q), len(x)))
    for i, a in enumerate(q):  # a row at a time keeps memory at one block
        gap = np.abs(a - x)
        if metric == "l1":
            out[i] = gap.sum(1)
        elif metric == "linf":
            out[i] = gap.max(1)
        elif metric == "lp":
            out[i] = (gap**p).sum(1)
        elif metric == "canberra":
            both = np.abs(a) + np.abs(x)
            out[i] = np.divide(gap, both, out=np.zeros_like(gap), where=both > 0).sum(1)
        elif metric == "braycurtis":
            out[i] = gap.sum(1) / np.abs(a + x).sum(1)
        elif metric == "jensenshannon":
            m = (a + x) / 2
            out[i] = -0.5 * (a * np.log(m / a) + x * np.log(m / x)).sum(1)
        elif metric == "jaccard":
            out[i] = np.minimum(a, x).sum(1) / np.maximum(a, x).sum(1)
        else:
            raise ValueError(f"unknown metric {metric}")
    return out


def direct(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Distances of paired rows without the cancellation of a matrix product: equal vectors have equal distances. None for metrics that pairwise computes so."""
    if metric == "l2":
        return ((q - x) ** 2).sum(1)
    if metric == "ip":
        return (q * x).sum(1)
    if metric == "cosine":
        both = np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1))
        return np.divide((q * x).sum(1), both, out=np.zeros(len(q)), where=both > 0)
    return None


def tiles(n_queries: int, n_rows: int) -> Iterator[slice]:
    """Queries in slices that have at most ``CELLS`` distances to so many rows."""
    wide = max(1, CELLS // max(n_rows, 1))
    for a in range(0, n_queries, wide):
        yield slice(a, min(a + wide, n_queries))


def within_reach(metric: str, block: np.ndarray, x: np.ndarray, mine: np.ndarray, p: float, limit_of) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries (their places in block), rows and keys of the pairs whose key (the distance, negative for similarities) is at most the limit that limit_of(keys, queries) gives each query; a tile of queries at a time."""
    sign, slack = -1.0 if metric in SIMILARITIES else 1.0, 0.0
    if metric in ("l2", "ip") and len(mine) and len(x):  # what a matrix product may be off by
        slack = 1e-12 * float((block[mine] ** 2).sum(1).max() + (x**2).sum(1).max())
    for s in tiles(len(mine), len(x)):
        asked = mine[s]
        key = sign * pairwise(metric, block[asked], x, p)
        limit = limit_of(key, asked)
        q, c = np.nonzero(~(key > (limit + slack + 1e-12 * (1 + np.abs(limit)))[:, None]))  # NaN goes on, and is sorted last
        for a in range(0, len(q), CELLS // 64):
            place, j = q[a : a + CELLS // 64], c[a : a + CELLS // 64]
            exact = direct(metric, block[asked[place]], x[j])
            yield asked[place], j, key[place, j] if exact is None else sign * exact


class Nearest:
    """The k nearest rows of each query of a block so far, by (distance, id), in memory of k rows a query and ``CELLS`` distances."""

    def __init__(self, names: np.ndarray, block: np.ndarray, k: int, metric: str, p: float = 3.0):
        self.names, self.block, self.k, self.metric, self.p = names, block, k, metric, p
        self.held, self.new, self.waiting = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], [], 0
        self.bound = np.full(len(names), np.inf)

    def _limit(self, key: np.ndarray, asked: np.ndarray) -> np.ndarray:
        bound = self.bound[asked]
        return np.fmin(bound, np.partition(key, self.k - 1, axis=1)[:, self.k - 1]) if key.shape[1] > self.k else bound

    def see(self, x: np.ndarray, ids: np.ndarray, mine: np.ndarray | None = None) -> None:
        """Rows that the queries at these places, or all, meet."""
        mine = np.arange(len(self.names)) if mine is None else mine
        for q, c, key in within_reach(self.metric, self.block, x, mine, self.p, self._limit):
            self.new.append((q, ids[c], key))
            self.waiting += len(q)
            if self.waiting > max(CELLS // 32, len(self.held[0])):
                self._merge()

    def _merge(self) -> None:
        held = [np.concatenate([h, *n]) for h, n in zip(self.held, zip(*self.new, strict=True), strict=True)] if self.new else self.held
        order = np.lexsort((held[1], held[2], held[0]))
        held = [h[order] for h in held]
        place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
        full = place == self.k - 1
        self.bound[held[0][full]] = np.where(np.isnan(held[2][full]), np.inf, held[2][full])
        self.held, self.new, self.waiting = [h[place < self.k] for h in held], [], 0

    def found(self) -> pa.RecordBatch:
        self._merge()
        q, ids, key = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.names[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(-key if self.metric in SIMILARITIES else key, pa.float64())], ["query_id", "id", "distance"])
