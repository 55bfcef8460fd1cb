"""Graph search. A graph is built within shards, each by one task over its rows, and searched by beams in every shard; the best k
over shards are the result. A shard's size is bounded by the number of shards, which grows with the base."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions.kernels import CELLS, direct, matrix
from vexel.operators.flat import FOUND, best, query_blocks
from vexel.plans.storage import materialize, ship


def prune(x: np.ndarray, i: int, candidates: np.ndarray, most: int) -> list[int]:
    """Candidates nearest first, each kept unless one that is kept is nearer to it than i is."""
    near = x[candidates]
    d = ((near - x[i]) ** 2).sum(1)
    kept: list[int] = []
    open_ = candidates != i
    for c in np.lexsort((candidates, d)).tolist():
        if open_[c]:
            kept.append(int(candidates[c]))
            if len(kept) == most:
                break
            open_ &= ((near - near[c]) ** 2).sum(1) >= d
    return kept


def beam(x: np.ndarray, links, q: np.ndarray, seeds: list[int], ef: int, metric: str = "l2", seen: set[int] | None = None) -> list[tuple[float, int]]:
    """The ef nearest nodes that greedy expansion from the seeds finds; links give the neighbours of a node. ``seen`` gathers the nodes whose distance was measured."""
    seen = set() if seen is None else seen
    far = (lambda ns: -(x[ns] @ q)) if metric == "ip" else (lambda ns: ((x[ns] - q) ** 2).sum(1))
    starts = list(dict.fromkeys(seeds))
    todo = list(zip(far(starts).tolist(), starts, strict=True))
    mine = set(starts)
    heapq.heapify(todo)
    pool = [(-d, n) for d, n in todo]
    heapq.heapify(pool)
    while len(pool) > ef:
        heapq.heappop(pool)
    while todo:
        d, n = heapq.heappop(todo)
        if len(pool) >= ef and d > -pool[0][0]:
            break
        fresh = [m for m in links[n] if m not in mine]
        if not fresh:
            continue
        mine.update(fresh)
        for e, m in zip(far(fresh).tolist(), fresh, strict=True):
            if len(pool) < ef or e < -pool[0][0]:
                heapq.heappush(todo, (e, m))
                heapq.heappush(pool, (-e, m))
                if len(pool) > ef:
                    heapq.heappop(pool)
    seen |= mine
    return sorted((-d, n) for d, n in pool)


def levels_of(ids: np.ndarray, m: int) -> np.ndarray:
    """The highest layer of each row, from a hash of its id: a share of 1 / m of a layer's rows is also in the next."""
    h = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    share = ((h ^ h >> np.uint64(31)) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(max(m, 2))).astype(int)


def descend(x: np.ndarray, layers: list[dict[int, list[int]]], q: np.ndarray, start: int, metric: str = "l2", to: int = 0, seen: set[int] | None = None) -> int:
    """From the top layer down to the one above ``to``: in each, step to the nearest neighbour until none is nearer."""
    at = start
    for links in layers[:to:-1]:
        at = beam(x, links, q, [at], 1, metric, seen)[0][1]
    return at


def link(x: np.ndarray, ids: np.ndarray, m: int, ef: int, metric: str = "l2") -> list[dict[int, list[int]]]:
    """Neighbours by layer: rows are linked one by one to a pruned choice of what a beam finds, both ways, within m links (2 m in layer 0)."""
    levels, layers, top = levels_of(ids, m), [], 0
    for i, level in enumerate(levels.tolist()):
        high = len(layers) - 1
        seeds = [descend(x, layers, x[i], top, metric, level)] if i and level < high else [top]
        layers += [{} for _ in range(level - high)]
        for k in range(level, -1, -1):
            links, most = layers[k], 2 * m if k == 0 else m
            links[i] = []
            if k > high:
                continue
            near = [n for _, n in beam(x, links, x[i], seeds, ef, metric)]
            links[i] = prune(x, i, np.array(near), m)
            for n in links[i]:
                links[n].append(i)
                if len(links[n]) > most:
                    links[n] = prune(x, n, np.array(links[n]), most)
            seeds = near
        if level > high:
            top = i
    return layers


def relink(x: np.ndarray, layers: list[dict[int, list[int]]], gone: set[int], m: int) -> list[dict[int, list[int]]]:
    """Without some rows: who was linked to one gets its other neighbours as candidates, and is pruned again."""
    out = []
    for k, links in enumerate(layers):
        kept: dict[int, list[int]] = {}
        for n, near in links.items():
            if n in gone:
                continue
            lost = [o for o in near if o in gone]
            if not lost:
                kept[n] = near
                continue
            reached, todo = set(near) - gone, lost  # through deleted rows that are linked to each other as well
            been = set(lost)
            while todo and (len(been) == len(lost) or len(reached) < 8 * m):  # one step at least; deleted rows may all hang together, and lead to the whole shard
                found = {o for w in todo for o in links.get(w, ())} - been
                been |= found
                todo = [o for o in found if o in gone]
                reached |= found - gone
            reached.discard(n)
            kept[n] = prune(x, n, np.array(sorted(reached), int), 2 * m if k == 0 else m) if reached else []
        for n, near in list(kept.items()):
            for o in near:  # both ways, so that no row is left without a way to it
                if n not in kept[o]:
                    kept[o] = kept[o] + [n]
        out.append(kept)
    return [links for links in out if links] or [{}]


#: Vectors of a shard: a graph is built and searched in one task, so shards are small enough for a task's time, and grow in number with the base.
PER_SHARD = 5_000
LINKS = "shard int, src long, dst long, distance double"
NODES = "shard int, id long, vec array<double>, layers array<array<long>>, entry boolean"


def _vectors(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(frame["vec"]).astype(float), frame["id"].to_numpy()


def _layers(frame: pd.DataFrame, ids: np.ndarray) -> list[dict[int, list[int]]]:
    place = {v: i for i, v in enumerate(ids.tolist())}
    out = [{} for _ in range(max(len(r) for r in frame["layers"]))]
    for i, row in enumerate(frame["layers"]):
        for k, near in enumerate(row):
            out[k][i] = [place[n] for n in near if n in place]
    return out


def _frame(shard: int, ids: np.ndarray, x: np.ndarray, layers: list[dict[int, list[int]]], entry: list[bool], rows: list[int]) -> pd.DataFrame:
    told = [[[int(ids[n]) for n in links[i]] for links in layers if i in links] for i in rows]
    return pd.DataFrame({"shard": shard, "id": ids[rows], "vec": [x[i] for i in rows], "layers": told, "entry": [entry[i] for i in rows]})


@dataclass
class GraphIndex:
    """nodes: shard, id, vec, layers (ids of neighbours in layer 0 and in each higher one that the row is in) and entry (whether a search of layer 0 may start there).

    With layers, a search goes down from the top one; without (as in NSG), it starts at entries."""

    nodes: DataFrame
    metric: str = "l2"
    m: int = 12

    @staticmethod
    def build(base: DataFrame, shards: int | None = None, m: int = 12, ef: int = 48, entries: int | DataFrame = 8, metric: str = "l2", kind: str = "hnsw") -> GraphIndex:
        """A graph for each shard; without a number of shards, one for each ``PER_SHARD`` vectors, four at least.

        entries: so many rows a shard, near the centres of groups, or a table of ids, such as the representatives of ``cluster.two_level``.
        """
        ship(base.sparkSession)
        shards = shards or max(4, -(-base.count() // PER_SHARD))
        rows = base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
        if kind == "nsg":
            return GraphIndex(nsg(rows, m), metric, m)
        doors = entries if isinstance(entries, int) else 0
        rows = rows.join(entries.select("id", F.lit(True).alias("entry")).distinct(), "id", "left").select("shard", "id", "vec", F.coalesce("entry", F.lit(False)).alias("entry")) if not doors else rows.withColumn("entry", F.lit(False))

        def make(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            x, ids = _vectors(frame)
            entry = frame["entry"].tolist()
            if doors:
                c = x[np.linspace(0, len(x) - 1, min(doors, len(x))).astype(int)]
                for _ in range(5):
                    at = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
                    c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
                for v in c:
                    entry[int(((x - v) ** 2).sum(1).argmin())] = True
            entry[0] |= not any(entry)
            return _frame(int(frame["shard"].iloc[0]), ids, x, link(x, ids, m, ef, metric), entry, list(range(len(x))))

        return GraphIndex(materialize(rows.groupBy("shard").applyInPandas(make, NODES), "graph"), metric, m)

    def _found(self, queries: DataFrame, k: int, ef: int, start: str, nprobe: int | None) -> DataFrame:
        """query_id, id and distance of the k best of each shard, and how many distances it measured (in ``visited``)."""
        if ef < k:
            raise ValueError("ef must be at least k")
        ship(queries.sparkSession)
        metric, kind = self.metric, FOUND + ", visited long"

        def searcher(names: np.ndarray, block: np.ndarray):
            def run(frame: pd.DataFrame) -> pd.DataFrame:
                frame = frame.sort_values("id")
                x, ids = _vectors(frame)
                layers, doors = _layers(frame, ids), np.flatnonzero(frame["entry"].to_numpy())
                top = min(layers[-1])
                out = []
                for q, v in zip(names.tolist(), block, strict=True):
                    seen: set[int] = set()
                    if start == "top" and len(layers) > 1:
                        seeds = [descend(x, layers, v, top, metric, 0, seen)]
                    elif nprobe is None:
                        seeds = doors.tolist()
                    else:  # the entries nearest to the query
                        far = -(x[doors] @ v) if metric == "ip" else ((x[doors] - v) ** 2).sum(1)
                        seeds = doors[np.lexsort((doors, far))[:nprobe]].tolist()
                        seen.update(doors.tolist())
                    near = beam(x, layers[0], v, seeds, ef, metric, seen)
                    out += [(q, int(ids[n]), -d if metric == "ip" else d, len(seen)) for d, n in near[:k]]
                return pd.DataFrame(out, columns=["query_id", "id", "distance", "visited"])

            return run

        parts = [self.nodes.groupBy("shard").applyInPandas(searcher(names, block), kind) for names, block in query_blocks(queries)]
        return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], kind)

    def search(self, queries: DataFrame, k: int, ef: int = 64, start: str = "top", nprobe: int | None = None) -> DataFrame:
        """start: "top" goes down the layers; "entries" starts a beam in layer 0 at all entries of a shard, or at the nprobe nearest to the query."""
        return best(self._found(queries, k, ef, start, nprobe).drop("visited"), k, self.metric == "ip")

    def visited(self, queries: DataFrame, k: int, ef: int = 64, start: str = "top", nprobe: int | None = None) -> DataFrame:
        """query_id and how many rows a search measures over all shards."""
        found = self._found(queries, k, ef, start, nprobe).withColumn("n", F.col("visited") / F.count("*").over(Window.partitionBy("query_id", "visited")))
        return found.groupBy("query_id").agg(F.round(F.sum("n")).cast("long").alias("visited"))

    def layers(self) -> DataFrame:
        """shard, layer, src, ord and dst: the links of each layer."""
        each = self.nodes.select("shard", F.col("id").alias("src"), F.posexplode("layers").alias("layer", "near"))
        return each.select("shard", "layer", "src", F.posexplode_outer("near").alias("ord", "dst"))

    def remove(self, ids: DataFrame) -> GraphIndex:
        """Without these rows. Rows that were linked to them are linked again to what they reached through them, and a shard that lost its entries gets another."""
        m, away = self.m, self.nodes.join(ids.select("id", F.lit(True).alias("marked")).distinct(), "id", "left").withColumn("away", F.coalesce("marked", F.lit(False))).drop("marked")

        def repair(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            x, all_ids = _vectors(frame)
            gone = set(np.flatnonzero(frame["away"].to_numpy(bool)).tolist())
            layers, kept = relink(x, _layers(frame, all_ids), gone, m), [i for i in range(len(x)) if i not in gone]
            entry = frame["entry"].tolist()
            if kept and not any(entry[i] for i in kept):
                entry[kept[int(((x[kept] - x[kept].mean(0)) ** 2).sum(1).argmin())]] = True
            return _frame(int(frame["shard"].iloc[0]), all_ids, x, layers, entry, kept)

        return GraphIndex(materialize(away.groupBy("shard").applyInPandas(repair, NODES), "graph"), self.metric, m)

    def edges(self) -> DataFrame:
        return self.nodes.select(F.col("id").alias("src"), F.posexplode(F.get("layers", F.lit(0))).alias("ord", "dst"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids that links (src, dst) lead to from the roots (id), themselves included: a turn for each step."""
    reached = materialize(roots.select("id").distinct(), "reached")
    front = reached
    while True:
        new = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti")
        front = materialize(new, "reached")
        if not front.limit(1).count():
            return reached
        reached = reached.union(front)


def nsg(rows: DataFrame, r: int, wide: int = 2) -> DataFrame:
    """Nodes of a navigating graph for each shard, from rows (shard, id, vec).

    Each row's wide * r nearest of its shard, and those that have it among theirs, are thinned by the occlusion rule to r links; so are the
    links taken both ways. The navigating row is the one nearest to the mean. Rows that it doesn't reach are linked from their
    nearest row that it does; rows that know none are taken in through the least id among them. So a tree from the
    navigating row spans its shard. Vectors are shuffled by shard only, a few times each, and not by link.
    """
    ship(rows.sparkSession)
    rows = materialize(rows.select("shard", "id", "vec"), "shards")

    def nearest(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = _vectors(frame.sort_values("id"))
        ids = np.sort(frame["id"].to_numpy())
        k, out = min(wide * r, len(x) - 1), []
        for a in range(0, len(x), 1024):
            d = ((x[a : a + 1024] ** 2).sum(1)[:, None] - 2 * x[a : a + 1024] @ x.T + (x**2).sum(1)).clip(0)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            at = np.argpartition(d, max(k - 1, 0), axis=1)[:, :k]
            i, j = np.repeat(np.arange(a, a + len(d)), k), at.ravel()
            out.append(pd.DataFrame({"shard": frame["shard"].iloc[0], "src": ids[i], "dst": ids[j], "distance": direct("l2", x[i], x[j])}))  # the same both ways, to the bit
        return pd.concat(out)

    def both_ways(links: DataFrame, most: int) -> DataFrame:
        all_ = links.union(links.select("shard", F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()
        ranked = Window.partitionBy("src").orderBy("distance", "dst")
        return all_.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= most).drop("k")  # a hub has as many candidates as others

    def thin(frame: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x, ids = _vectors(frame)
        links = links.sort_values(["src", "dst"], ignore_index=True)
        src, dst = (np.searchsorted(ids, links[c].to_numpy(np.int64)) for c in ("src", "dst"))
        kept = []
        for mine in np.split(np.arange(len(src)), np.flatnonzero(np.diff(src)) + 1) if len(src) else ():
            chosen = prune(x, src[mine[0]], dst[mine], r)
            kept.append(mine[np.searchsorted(dst[mine], np.sort(chosen))])
        return links.iloc[np.concatenate(kept)] if kept else links

    def span(frame: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x, ids = _vectors(frame)
        src, dst = (np.searchsorted(ids, links[c].to_numpy(np.int64)) for c in ("src", "dst"))
        kept, d = links["kept"].to_numpy(bool), links["distance"].to_numpy(float)
        root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        near = spanned(len(ids), root, (src[kept], dst[kept]), (src[~kept], dst[~kept], d[~kept]))
        return _frame(int(frame["shard"].iloc[0]), ids, x, [dict(enumerate(near))], [i == root for i in range(len(ids))], list(range(len(ids))))

    def beside(links: DataFrame):
        """Links meet the vectors of their shard; no vector is sent along with a link."""
        return rows.groupBy("shard").cogroup(links.groupBy("shard"))

    def thinned(links: DataFrame) -> DataFrame:
        return materialize(beside(links).applyInPandas(thin, LINKS), "thinned")

    near = materialize(rows.groupBy("shard").applyInPandas(nearest, LINKS), "near")
    known = both_ways(near, 2 * wide * r)
    links = thinned(both_ways(thinned(known), 2 * r))
    both = links.withColumn("kept", F.lit(True)).unionByName(known.withColumn("kept", F.lit(False)))
    return materialize(beside(both).applyInPandas(span, NODES), "graph")


def spanned(n: int, root: int, links: tuple[np.ndarray, np.ndarray], known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[int]]:
    """Neighbours of n nodes by links (from, to) and by what a tree adds, so that all are reached from the root: known has candidates (from, to, distance)."""
    near: list[set[int]] = [set() for _ in range(n)]
    for i, j in zip(*(e.tolist() for e in links), strict=True):
        near[i].add(j)
    reached, front = np.zeros(n, bool), [root]
    a, b, d = known
    while True:
        while front:
            reached[front] = True
            front = list({j for i in front for j in near[i] if not reached[j]})
        if reached.all():
            return [sorted(o) for o in near]
        open_ = np.flatnonzero(reached[a] & ~reached[b])
        open_ = open_[np.lexsort((a[open_], d[open_], b[open_]))]
        first = open_[np.flatnonzero(np.r_[True, np.diff(b[open_]) > 0][: len(open_)])]
        new = list(zip(a[first].tolist(), b[first].tolist(), strict=True)) or [(root, int(np.flatnonzero(~reached)[0]))]
        for i, j in new:
            near[i].add(j)
        front = [j for _, j in new]


def knn_graph(base: DataFrame, k: int) -> DataFrame:
    """src, rank, dst and distance: the exact k nearest other rows of each."""
    from vexel.operators.flat import knn

    found = knn(base, base.select(F.col("id").alias("query_id"), "vec"), k + 1).where("id <> query_id")
    return best(found.select("query_id", "id", "distance"), k).select(F.col("query_id").alias("src"), "rank", F.col("id").alias("dst"), "distance")


def _narrow(rows: DataFrame) -> DataFrame:
    """id with the vector as floats (f) where they hold it exactly, and else as doubles (d)."""
    floats = F.col("vec").cast("array<float>")
    exact = floats.cast("array<double>") == F.col("vec")
    return rows.select("id", F.when(exact, floats).alias("f"), F.when(~exact, F.col("vec")).alias("d"))


def _wide(t: pa.Table) -> np.ndarray:
    f, d = t["f"].combine_chunks(), t["d"].combine_chunks()
    short = f.is_valid().to_numpy(zero_copy_only=False)
    if short.all() or not short.any():
        return matrix(f if short.any() else d)
    x = np.empty((len(t), len(f.drop_null()[0])))
    x[short], x[~short] = matrix(f.drop_null()), matrix(d.drop_null())
    return x


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, so cut that all of a value are together."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        keys = t.column(0).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield t.slice(0, end)
        held = t.slice(end)
    if held is not None:
        yield held


def _gathered(meet: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of meet (via, id and more) with the vectors of their ids (from rows as _narrow makes them), those of a via together."""
    return meet.join(rows, "id").select(*meet.columns, *[c for c in rows.columns if c != "id"]).repartition("via").sortWithinPartitions("via", "id")


def nsg_prune(graph: DataFrame, base: DataFrame, r: int) -> DataFrame:
    """src and neighbors: each row's candidates thinned by the occlusion rule. A row meets its candidates' vectors, once each."""
    ship(base.sparkSession)
    rows = _narrow(base)
    meet = graph.select(F.col("src").alias("via"), F.col("dst").alias("id"), F.lit(False).alias("own"))
    meet = meet.union(graph.select("src").distinct().select("src", "src", F.lit(True)))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            via, ids, own, x = t["via"].to_numpy(), t["id"].to_numpy(), t["own"].to_numpy(), _wide(t)
            src, near = [], []
            for mine in np.split(np.arange(len(via)), np.flatnonzero(np.diff(via)) + 1):
                if own[mine].any() and not own[mine].all():
                    src.append(via[mine[0]])
                    near.append(ids[prune(x, int(mine[own[mine]][0]), mine[~own[mine]], r)])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(near, pa.list_(pa.int64()))], ["src", "neighbors"])

    return _gathered(meet, rows).mapInArrow(thin, "src long, neighbors array<long>")


def _pairs_met(meet: DataFrame, rows: DataFrame) -> DataFrame:
    """src, dst and distance of the pairs of different ids of a via (meet: via, id, a, b), the first marked a and the second b, that
    lie within the bound of the first (rows: id, f, d, bound). Distances are taken where the vectors have met, at most ``CELLS`` / 64 at once."""
    ship(meet.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            via, ids, bound = t["via"].to_numpy(), t["id"].to_numpy(), t["bound"].to_numpy()
            one, two = np.flatnonzero(t["a"].to_numpy()), np.flatnonzero(t["b"].to_numpy())
            low = np.searchsorted(via[two], via[one])
            n = np.searchsorted(via[two], via[one], side="right") - low
            x, ends = np.ascontiguousarray(_wide(t).T), np.cumsum(n)
            for s in range(0, int(ends[-1]) if len(ends) else 0, CELLS // 64):
                p = np.arange(s, min(s + CELLS // 64, ends[-1]))
                at = np.searchsorted(ends, p, side="right")
                i, j = one[at], two[low[at] + p - (ends - n)[at]]
                other = ids[i] != ids[j]
                i, j = i[other], j[other]
                d = np.zeros(len(i))
                for v in x:  # a coordinate at a time, as the expression adds them
                    gap = v[i] - v[j]
                    d += gap * gap
                near = ~(d > bound[i])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[near]]), pa.array(ids[j[near]]), pa.array(d[near])], ["src", "dst", "distance"])

    return _gathered(meet, rows).mapInArrow(run, "src long, dst long, distance double")


def nn_descent(base: DataFrame, k: int, rounds: int = 6, seed: int = 2021, pool: int = 12) -> DataFrame:
    """Approximate k-nearest-neighbour graph: neighbours of neighbours are tried, round after round, until none is better.

    First neighbours are the rows beside a row in some orders by a seeded hash of ids. A row keeps k + pool neighbours on the way and
    tries as many of those that have it among theirs, chosen anew by hash each round, so a hub makes no more pairs than others.
    Vectors are sent to the rows that are tried as ways, and of the pairs that meet there only those go on that are no farther than the
    last of the first one's k + pool neighbours so far.
    """
    wide = k + pool
    rows = base.select("id", "vec").where("vec IS NOT NULL")
    graph, state = None, None
    for i in range(max(1, k // 2)):
        spread = materialize(rows.select("id").repartitionByRange(F.xxhash64("id", F.lit(seed + i)), "id").sortWithinPartitions(F.xxhash64("id", F.lit(seed + i)), "id").withColumn("at", F.monotonically_increasing_id()), "orders")
        ends = spread.groupBy(F.shiftright("at", 33).alias("part")).agg(F.max("at").alias("last"), F.min("at").alias("first")).orderBy("part").collect()  # a row a partition
        follow = {r["last"]: ends[(n + 1) % len(ends)]["first"] for n, r in enumerate(ends)}
        jump = F.create_map(*[F.lit(v) for e in follow.items() for v in e]) if follow else F.create_map().cast("map<long,long>")
        beside = spread.select(F.col("id").alias("src"), F.coalesce(F.element_at(jump, F.col("at")), F.col("at") + 1).alias("at")).join(spread.select("at", F.col("id").alias("dst")), "at").select("src", "dst")
        graph = beside if graph is None else graph.union(beside)
    graph = graph.union(graph.select("dst", "src")).distinct()
    mark = lambda links, via, of, a: links.select(F.col(via).alias("via"), F.col(of).alias("id"), F.lit(a).alias("a"), F.lit(not a).alias("b"))
    narrow = materialize(_narrow(rows), "vectors")
    first = mark(graph, "src", "dst", False).union(mark(rows, "id", "id", True))
    out = materialize(_pairs_met(first, narrow.withColumn("bound", F.lit(float("inf")))).withColumn("rank", F.lit(0)), "descent")
    for turn in range(rounds):
        graph = out.select("src", "dst")
        lot = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed + turn)))
        back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("k", F.row_number().over(lot)).where(F.col("k") <= wide).drop("k")
        both = graph.union(back).distinct()
        few = materialize(both.withColumn("k", F.row_number().over(lot)).where(F.col("k") <= wide).drop("k"), "ways")  # ways that are tried this round
        meet = mark(few, "dst", "src", True).union(mark(few, "src", "dst", False)).groupBy("via", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        last = out.where(F.col("rank") == wide).select(F.col("src").alias("id"), F.col("distance").alias("bound"))
        bounded = narrow.join(last, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        tried = out.select("src", "dst", "distance").union(_pairs_met(meet, bounded)).repartition("src").distinct()
        out = materialize(best(tried.withColumnRenamed("dst", "id"), wide, by="src").withColumnRenamed("id", "dst"), "descent")
        now = out.agg(F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return out.where(F.col("rank") <= k).select("src", "rank", "dst", "distance")
