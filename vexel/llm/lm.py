"""A hashed maximum-entropy language model beside a unigram base.

The model predicts a token through a tree of ``LEVELS`` softmaxes: its class, classes within that, and itself among the rest. Classes
are learned: words go together by the kind of text they are commonest in (kinds are found by spectral clustering of the frequent
words' co-occurrence in texts), and by frequency within a kind. Features of each softmax are the previous token, the one before
it (a skip) and the pair (an n-gram), whole tokens hashed with the class reached into a table of rows; a row holds a weight for
each branch. Branches start from their unigram log probabilities.

The tree, its branching and the tables grow with the number of distinct words, up to ``HOT`` words in it, a bound on what a worker
and the driver hold. Rarer words are ``TAILS`` events of the tree by their last bytes, and within one a word has its unigram
share, from counts that are joined and have no bound; as contexts they are told apart by their hash.

Training visits texts in ``ROUNDS`` shards by a hash of their id, one diagonal Newton step on the gradient after each. A task sums
observed and expected counts of each row and branch as integers (probabilities in fixed point), so that sums, and with them the
model and all scores, are the same however rows were dealt out. Texts are cut into words once for counting and once for
encoding; training and scoring read numbers. Scoring is in numpy, by blocks of tokens.

Defined results: a null text is one end token; null ids hash as no text and are held out; repeated rows are scored each and
learned from each; ties of counts go by the token; with no training rows N and V are 0, nothing is known and every token's base
score is the same; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.text import cut, shipped
from vexel.plans import storage
from vexel.plans.storage import materialize

END, TAILS = 0, 64
HOT = (1 << 18) - 1 - TAILS
#: Softmaxes to a token; different tokens that a counting task holds; shards of training; tokens in a block, and in the strips of it whose branches stay in a core's cache; tokens of a training task and round.
LEVELS, HELD, ROUNDS, BLOCK, STRIP, TASK = 4, 300_000, 6, 1 << 15, 1 << 12, 1 << 22
#: Frequent words that tell kinds of text apart, and the number of kinds.
MARKERS, KINDS = 128, 8
#: Fixed-point steps to a probability; rows to a message; strength of the pull towards zero; the most a weight moves in a step, and its bound.
FINE, BLOCK_ROWS, PULL, STRIDE, BOUND = 1 << 20, 1024, 4.0, 1.5, 8.0
#: Steps to a unit of log10, so that joined sums are exact.
UNIT = 10**12
RARE = np.uint32(1 << 31)
#: Words that are looked up in one call of Arrow, which builds its table of the listed words anew for each.
LOOKUP = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(True))


def _tokens(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text of a column as UTF-8 with A-Z lower-cased; bytes.split() knows the same six space characters."""
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").lower().split()


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same words on end, as an Arrow column, and how many each text has."""
    whole = pc.fill_null(column.cast(pa.large_string()), "").take(pa.array(np.arange(len(column))))  # a copy: ascii_lower() misreads large strings whose first doesn't begin at 0, as in slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    flat = lists.flatten()
    there = pc.not_equal(pc.binary_length(flat), 0)  # spaces at either end of a text leave an empty string
    before = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))]
    return flat.filter(there), np.diff(before[lists.offsets.to_numpy()])


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (empty for the end) and c, over all training rows."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for frame in frames:
            for words in _tokens(frame.column(0)):
                seen.update(words)
                seen[b""] += 1
                if len(seen) > HELD:
                    yield told(seen)
                    seen = Counter()
        yield told(seen)

    def told(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

    usable = shipped(docs).where(~held_out(F.col("doc_id"))).select("text")
    return materialize(usable.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Words:
    """The events: END, the classes of rarer words, and the commonest words from the most frequent on."""

    hot: dict[bytes, int]
    seen: np.ndarray  # training counts of the events
    spread: np.ndarray  # distinct words of the events
    total: int
    distinct: int

    @property
    def log_size(self) -> float:
        return math.log10(self.total + self.distinct + 1)


def words_of(counts: DataFrame, hot: int | None = None) -> Words:
    """The commonest words are collected, so many at most, and sums of the rest."""
    hot = HOT if hot is None else hot
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where("token <> ''").withColumn("bin", F.floor(F.log2("c") * 32))
    left, least = hot, 0
    for bin_, n in words.groupBy("bin").agg(F.count("*")).orderBy(F.desc("bin")).collect():  # 32 bins for each doubling of a count
        left, least = left - n, bin_
        if left <= 0:
            break
    top = words.where(F.col("bin") >= least).orderBy(F.desc("c"), "token").limit(hot).select("token", "c").toArrow()  # so that partitions send few rows in vain
    names = [x.as_py() for x in top.column(0).cast(pa.binary())]
    often = top.column(1).to_numpy().astype(np.int64)
    ends = counts.where("token = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    seen, spread = np.zeros(1 + TAILS, np.int64), np.zeros(1 + TAILS, np.int64)
    seen[END], spread[END] = ends, 1
    if names:
        last, least_c = names[-1].decode("utf-8"), int(often[-1])
        rest = words.where((F.col("c") < least_c) | ((F.col("c") == least_c) & (F.col("token") > last)))
        ending = F.substring(F.encode("token", "UTF-8"), -3, 3)
        for t, n, k in rest.groupBy(F.crc32(ending) % TAILS).agg(F.sum("c"), F.count("*")).collect():
            seen[1 + t], spread[1 + t] = n, k
    return Words({w: k for k, w in enumerate(names, 1 + TAILS)}, np.r_[seen, often], np.r_[spread, np.ones(len(names), np.int64)], total, distinct)


def _rare(word: bytes) -> int:
    """What stands for a word that isn't listed: a mark, bits of its hash, and its class."""
    return int(RARE) | (crc32(word) & 0x1FFFFFF) << 6 | crc32(word[-3:]) % TAILS


def event(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers & RARE, (numbers & np.uint32(TAILS - 1)) + np.uint32(1), numbers)


def encode(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: row, doc_id, part (its training shard, -1 if held out), n_tokens, n_known and base (both without rare words), ids (a number a token, end last) and rare (words that aren't listed, and how often)."""
    logs = np.log10(words.seen + 1) - words.log_size
    known = (words.seen > 0).astype(np.int64)
    listed = pa.array(list(words.hot), pa.large_binary()).cast(pa.large_string())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n = TaskContext.get().partitionId() << 40, [], 0
        for frame in cut(frames):
            held.append((frame, *_split(frame.column(2))))
            n += len(held[-1][1])
            if n >= LOOKUP:
                yield from told(held, task)
                task, held, n = task + sum(frame.num_rows for frame, *_ in held), [], 0
        if held:
            yield from told(held, task)

    def told(held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]], task: int) -> Iterator[pa.RecordBatch]:
        places = pc.fill_null(pc.index_in(pa.chunked_array([w for _, w, _ in held]), value_set=listed), -1).to_numpy()
        done = 0
        for frame, found, sizes in held:
            place = places[done : done + len(found)]
            numbers, missing = (place + (1 + TAILS)).astype(np.uint32), np.flatnonzero(place < 0)
            n, text = frame.num_rows, np.repeat(np.arange(len(sizes)), sizes)
            rest = found.take(pa.array(missing)).dictionary_encode()
            code, which = rest.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False), rest.indices.to_numpy()
            numbers[missing] = np.fromiter(map(_rare, code), np.uint32, len(code))[which]
            pairs, times = np.unique(text[missing] * max(len(code), 1) + which, return_counts=True)
            of, which = np.divmod(pairs, max(len(code), 1))
            flat = pa.StructArray.from_arrays([rest.dictionary.take(pa.array(which)).cast(pa.string()), pa.array(times.astype(np.int64))], ["token", "tf"])
            ids = np.zeros(len(numbers) + n, np.uint32)  # END stays behind each text
            ids[np.arange(len(numbers)) + text] = numbers
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            own = ids < RARE
            at = np.where(own, ids, END)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(n) + task), frame.column(0), frame.column(1), pa.array(sizes + 1), pa.array(np.add.reduceat(known[at] * own, starts)), pa.array(np.add.reduceat(logs[at] * own, starts)),
                pa.array([x.tobytes() for x in np.split(ids, starts[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), flat),
            ], ["row", "doc_id", "part", "n_tokens", "n_known", "base", "ids", "rare"])
            task, done = task + n, done + len(found)

    part = F.when(held_out(F.col("doc_id")), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(rounds))).cast("int")
    schema = "row long, doc_id long, part int, n_tokens long, n_known long, base double, ids binary, rare array<struct<token:string,tf:long>>"
    made = shipped(docs).select("doc_id", part.alias("part"), "text").mapInArrow(run, schema)
    path = storage.new_path(docs.sparkSession, "lm-encoded")
    made.write.option("compression", "zstd").partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the texts of a column on end, and where each begins."""
    raw = [np.frombuffer(x.as_buffer(), np.uint32) for x in column]
    sizes = np.array([len(x) for x in raw], np.int64)
    return np.concatenate(raw) if raw else np.zeros(0, np.uint32), np.cumsum(sizes) - sizes


def kinds(encoded: DataFrame, words: Words) -> np.ndarray:
    """The kind of text that each event is commonest in, by its share of the kind's tokens, over all training texts."""
    size, n = len(words.seen), min(MARKERS, max(len(words.seen) - 1 - TAILS, 0))
    if not n:
        return np.zeros(size, np.int64)
    train_ = encoded.where("part >= 0").select("ids")

    def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, starts = _numbers(column)
        text = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(numbers)]))
        at = numbers - np.uint32(1 + TAILS)  # smaller numbers wrap round
        mark = at < n
        return np.bincount(text[mark] * n + at[mark], minlength=len(starts) * n).reshape(-1, n), numbers, text

    def together(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((n, n))
        for frame in cut(frames):
            there = (presence(frame.column(0))[0] > 0).astype(np.float64)
            both += there.T @ there
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(list(both.astype(np.int64)), pa.list_(pa.int64()))], ["marker", "both"])

    sums = shipped(train_).mapInArrow(together, "marker int, both array<long>").select("marker", F.posexplode("both").alias("other", "c")).groupBy("marker", "other").agg(F.sum("c").alias("c"))
    both = np.zeros((n, n))
    for r in sums.collect():  # MARKERS squared at most
        both[r["marker"], r["other"]] = r["c"]
    group = _clusters(both)

    def vote(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros((KINDS, size), np.int64)
        of = np.eye(KINDS, dtype=np.int64)[group]
        for frame in cut(frames):
            counted, numbers, text = presence(frame.column(0))
            mine = (counted @ of).argmax(axis=1)
            often += np.bincount(mine[text] * size + event(numbers), minlength=KINDS * size).reshape(KINDS, size)
        kind, which = np.nonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(often[kind, which])], ["event", "kind", "c"])

    tasks = max(1, int(words.total // TASK))
    votes = materialize(shipped(train_).coalesce(tasks).mapInArrow(vote, "event int, kind int, c long").groupBy("event", "kind").agg(F.sum("c").alias("c")), "lm-kinds")
    share = [0.0] * KINDS
    for r in votes.groupBy("kind").agg(F.sum("c").alias("c")).collect():
        share[r["kind"]] = 1.0 / r["c"]
    best = votes.groupBy("event").agg(F.max_by("kind", F.struct(F.col("c") * F.get(F.array(*map(F.lit, share)), F.col("kind")), -F.col("kind"))).alias("kind")).toArrow()  # a row an event
    out = np.zeros(size, np.int64)
    out[best.column(0).to_numpy()] = best.column(1).to_numpy()
    return out


def _clusters(both: np.ndarray) -> np.ndarray:
    """A group for each marker: k-means on the leading eigenvectors of the normalised co-occurrence, from the farthest points on."""
    often = np.maximum(np.diag(both), 1)
    values, vectors = np.linalg.eigh(both / np.sqrt(np.outer(often, often)))
    x = vectors[:, -KINDS:] * np.sqrt(np.maximum(values[-KINDS:], 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:1]
    while len(centres) < min(KINDS, len(x)):
        centres = np.vstack([centres, x[((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).argmax()]])
    for _ in range(20):
        group = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[group == k].mean(axis=0) if (group == k).any() else centres[k] for k in range(len(centres))])
    return group


@dataclass
class Model:
    place: np.ndarray  # of each event in the order of the tree's leaves
    width: int
    rows: int
    bias: list[np.ndarray] = field(default_factory=list)  # log share of each branch, by the node above
    tables: list[np.ndarray] = field(default_factory=list)

    def digits(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the node above and the branch taken to these places."""
        steps = [at // self.width**k for k in range(LEVELS, -1, -1)]
        return [(above, step - above * self.width) for above, step in zip(steps, steps[1:])]

    def contexts(self, level: int, node: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """Rows of the three features."""
        salt = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)

        def mixed(x: np.ndarray, low: int, size: int) -> np.ndarray:
            h = x + salt
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h >>= np.uint64(40)
            h &= np.uint64(size - 1)
            h += np.uint64(low)
            return h.view(np.int64)

        one = one.astype(np.uint64, copy=False)
        return [mixed(x, *range_) for x, range_ in zip((one, two, one << np.uint64(32) | two), self.ranges(), strict=True)]

    def ranges(self) -> list[tuple[int, int]]:
        """First row and number of rows of each feature: a quarter of the table for the previous token and for the one before, half of it for pairs."""
        return [(0, self.rows // 4), (self.rows // 4, self.rows // 4), (self.rows // 2, self.rows // 2)]

    def shares(self, level: int, node: np.ndarray, rows: list[np.ndarray], x: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """Unnormalised probabilities of the branches, in x; weights are bounded, so that no exponent overflows. x and spare are reused from strip to strip and have a row for each token at least."""
        x, spare = x[: len(node)], spare[: len(node)]
        np.take(self.bias[level], node, axis=0, out=x, mode="clip")  # all rows are there; other modes copy
        for r in rows:
            x += np.take(self.tables[level], r, axis=0, out=spare, mode="clip")
        return np.exp(x, out=x)

    def buffers(self) -> tuple[np.ndarray, np.ndarray]:
        """For shares() of a strip."""
        return np.empty((STRIP, self.width), np.float32), np.empty((STRIP, self.width), np.float32)


def start(words: Words, kind: np.ndarray) -> Model:
    """The tree over events by kind and frequency, with unigram shares and no weights."""
    size = len(words.seen)
    order = np.lexsort((np.arange(size), -words.seen, kind))
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    width = 2
    while width**LEVELS < size:
        width += 1
    rows = 1 << max(8, (size // 16).bit_length() - 1)
    mass = np.full(width**LEVELS, 1e-3)
    mass[place] = words.seen + 0.5
    bias = []
    for level in range(LEVELS):
        summed = mass.reshape(width ** (level + 1), -1).sum(axis=1).reshape(-1, width)
        bias.append(np.log(summed / summed.sum(axis=1, keepdims=True)).astype(np.float32))
    return Model(place, width, rows, bias, [np.zeros((rows, width), np.float32) for _ in range(LEVELS)])


def _blocks(numbers: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of so many tokens with their numbers, the number before and the one before that; END stands before a text."""
    one, two = np.r_[np.uint32(END), numbers[:-1]], np.r_[np.uint32(END), np.uint32(END), numbers[:-2]][: len(numbers)]
    one[starts], two[starts] = END, END
    second = starts[np.diff(np.r_[starts, len(numbers)]) > 1] + 1
    two[second] = END
    for k in range(0, len(numbers), size):
        s = slice(k, k + size)
        yield s, numbers[s], one[s].astype(np.uint64), two[s].astype(np.uint64)


def token_scores(m: Model, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's event."""
    out = np.ones(len(numbers))
    buffers, first = m.buffers(), np.arange(STRIP) * m.width
    for s, now, one, two in _blocks(numbers, starts, STRIP):
        for level, (node, branch) in enumerate(m.digits(m.place[event(now)])):
            x = m.shares(level, node, m.contexts(level, node, one, two), *buffers)
            share = x.reshape(-1).take(first[: len(now)] + branch).astype(np.float64)
            share /= np.einsum("ij->i", x)
            out[s] *= share  # bounded weights and LEVELS factors stay far above the least double
    return np.log(out, out=out)


def gather(m: Model, columns: Iterator[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each level, observed counts and expected ones (fixed-point, whole numbers that a double holds exactly) of each row and branch."""
    seen = [np.zeros((m.rows, m.width), np.int64) for _ in range(LEVELS)]
    due = [np.zeros((m.width, m.rows)) for _ in range(LEVELS)]
    buffers, fixed = m.buffers(), np.empty((m.width, BLOCK))
    for column in columns:
        for _, now, one, two in _blocks(*_numbers(column), BLOCK):
            n = len(now)
            for level, (node, branch) in enumerate(m.digits(m.place[event(now)])):
                rows = m.contexts(level, node, one, two)
                for k in range(0, n, STRIP):
                    s = slice(k, min(k + STRIP, n))
                    x = np.ascontiguousarray(m.shares(level, node[s], [r[s] for r in rows], *buffers).T)
                    x *= np.float32(FINE) / np.add.reduce(x, axis=0)
                    fixed[:, s] = np.rint(x, out=x)
                for r, (low, size) in zip(rows, m.ranges(), strict=True):
                    np.add.at(seen[level].reshape(-1), r * m.width + branch, 1)
                    within = r - low
                    for k in range(m.width):
                        due[level][k, low : low + size] += np.bincount(within, fixed[k, :n], size)
    return seen, [x.T for x in due]


def moved(weights: np.ndarray, seen: np.ndarray, due: np.ndarray) -> np.ndarray:
    """A step of a block's weights: the gradient over a diagonal bound of the curvature (three features are active in each softmax)."""
    expected = due / FINE
    step = (seen - expected - PULL * weights) / (3 * expected + PULL)
    return np.clip(weights + np.clip(step, -STRIDE, STRIDE), -BOUND, BOUND).astype(np.float32)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, all first bytes, then all second ones and so on, compressed."""
    return pa.compress(numbers.astype("<i8", order="C").reshape(-1, 1).view(np.uint8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * 8, codec="zstd"), np.uint8).reshape(8, n).T).view("<i8").ravel()


def _round(now: Model):
    """Functions that sum a task's counts by block of rows, and that add blocks up and move their weights."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, due = gather(now, (f.column(0) for f in cut(frames)))
        for level in range(LEVELS):
            for b in range(0, now.rows, BLOCK_ROWS):
                if seen[level][b : b + BLOCK_ROWS].any():
                    packed = [pa.array([_pack(x[level][b : b + BLOCK_ROWS])], pa.binary()) for x in (seen, due)]
                    yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([b], pa.int32()), *packed], ["level", "block", "seen", "due"])

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        level, b = int(frame["level"].iloc[0]), int(frame["block"].iloc[0])
        old = now.tables[level][b : b + BLOCK_ROWS]
        seen, due = (sum(_unpack(x, old.size) for x in frame[c]).reshape(old.shape) for c in ("seen", "due"))
        new = moved(old, seen, due)
        return pd.DataFrame({"level": [level], "block": [b], "new": [new.tobytes()]})

    return run, step


def train(encoded: DataFrame, m: Model, total: int, rounds: int = ROUNDS) -> Model:
    tasks = max(1, int(total // rounds // TASK))
    for k in range(rounds):
        run, step = _round(m)
        sums = shipped(encoded).where(F.col("part") == k).select("ids").coalesce(tasks).mapInArrow(run, "level int, block int, seen binary, due binary")
        tables = [t.copy() for t in m.tables]
        for r in sums.groupBy("level", "block").applyInPandas(step, "level int, block int, new binary").collect():  # at most the tables
            tables[r["level"]][r["block"] : r["block"] + BLOCK_ROWS] = np.frombuffer(r["new"], np.float32).reshape(-1, m.width)
        m = replace(m, tables=tables)
    return m


def score(encoded: DataFrame, words: Words, m: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row."""
    share = -np.log10(words.seen[1 : 1 + TAILS] + words.spread[1 : 1 + TAILS] + 1)  # of a class's words; joined counts add their part

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in cut(frames):
            numbers, starts = _numbers(frame.column(5))
            each = token_scores(m, numbers, starts) / math.log(10)
            rare = numbers >= RARE
            each[rare] += share[numbers[rare] & np.uint32(TAILS - 1)]
            yield pa.RecordBatch.from_arrays([*frame.columns[:5], pa.array(np.add.reduceat(each, starts) if len(starts) else each)], ["row", "doc_id", "n_tokens", "n_known", "base", "score"])

    told = shipped(encoded).select("row", "doc_id", "n_tokens", "n_known", "base", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double")
    scored = materialize(told, "lm-scored")
    each = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.tf").join(counts, "token", "left")
    log = F.round(F.log10(F.coalesce("c", F.lit(0)) + 1) * UNIT).cast("long")
    more = each.groupBy("row").agg(F.sum(F.col("tf") * log).alias("logs"), F.sum("tf").alias("tf"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    logs = zero(F.col("logs")) / UNIT
    return scored.join(more, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - zero(F.col("tf")) * words.log_size).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame, Words, Model]:
    """The token counts, the encoded table, the events and the trained model."""
    counts = count_tokens(docs)
    words = words_of(counts)
    encoded = encode(docs, words)
    return counts, encoded, words, train(encoded, start(words, kinds(encoded, words)), words.total)


def learn_and_score(docs: DataFrame) -> DataFrame:
    counts, encoded, words, m = learn(docs)
    return score(encoded, words, m, counts)
