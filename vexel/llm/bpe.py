"""Byte-pair encoding by speculation and verification, and decoding.

Each distinct pretoken is first cut greedily into the longest tokens. The cut is the encoding if each token encodes to itself and
every adjacent pair is compatible: merges within both tokens run to their ends before any merge across the border would be due.
All pairs of a batch are tested at once, walking up the tokens' inner borders in numpy. Only pretokens that fail are merged
exactly, in the order of merge ranks. Results of pretokens are kept in two dictionaries of bounded size: once the newer is full it
becomes the older, and what is asked for again moves up.

Defined results: a null text counts as empty and has no tokens; texts are encoded whole; repeated rows are encoded each;
columns other than doc_id and text are ignored. The special token's string in a text becomes the special token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vexel.llm.text import cut, shipped

#: The split of byte-level BPE into pretokens, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int64).max
#: Pretokens in a dictionary of results; characters of text that are cut and learned at once (one text at least); bytes up to which a pretoken is merged by scanning.
REMEMBERED, AT_ONCE, SHORT = 200_000, 1_000_000, 64


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        told = json.load(open(path, encoding="utf-8"))
        to_byte, vocab = letters(), told["model"]["vocab"]
        size = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes: list[bytes] = [b""] * max(size, *[i + 1 for i in self.special.values()])
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.id = {self.bytes[i]: i for i in vocab.values()}
        lengths: dict[bytes, set[int]] = {}
        for token in self.id:
            if len(token) > 2:
                lengths.setdefault(token[:3], set()).add(len(token))
        self.lengths = {start: sorted(n, reverse=True) for start, n in lengths.items()}
        self.single = np.array([self.id[bytes([b])] for b in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.size, self.rank, self.made = size, {}, {}
        left, right, rank = np.arange(size), np.arange(size), np.full(size, -1, np.int64)
        for k, (x, y) in enumerate(pairs):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.rank[a, b], self.made[a, b] = k, c
            if rank[c] < 0:
                left[c], right[c], rank[c] = a, b, k
        codes = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_rank = codes[order], np.fromiter(self.rank.values(), np.int64)[order]
        self.first, self.first_rank = self._edges(left, rank)
        self.last, self.last_rank = self._edges(right, rank)
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.byte_ranks = {bytes([x, y]): r for x in range(256) for y in range(256) if (r := self.rank.get((int(self.single[x]), int(self.single[y])))) is not None}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.sound = np.zeros(size, bool)
        for token, i in self.id.items():
            self.sound[i] = len(token) == 1 or rank[i] >= 0 and self._self_encodes(i, left, right, rank)

    def _edges(self, inner: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, the tokens at one of its ends as they grow from a byte to the whole, and the rank of the merge that ends each."""
        chain = [np.arange(self.size)]
        while (inner[chain[-1]] != chain[-1]).any():
            chain.append(inner[chain[-1]])
        down = np.stack(chain, axis=1)
        depth = (down != down[:, -1:]).sum(axis=1)
        k = np.arange(down.shape[1])
        up = np.take_along_axis(down, np.maximum(depth[:, None] - k, 0), axis=1)
        after = np.take_along_axis(rank[down], np.maximum(depth[:, None] - k - 1, 0), axis=1)
        return up, np.where(k < depth[:, None], after, NEVER)

    def _self_encodes(self, i: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> bool:
        """Whether exact merging of the token's bytes ends in the token."""
        return self.merge(self.bytes[i]) == [i]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens: whether the border between them stays when their bytes are merged together."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(at):
            code = self.last[a, i] * self.size + self.first[b, j]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            across = np.where(self.codes[place] == code, self.code_rank[place], NEVER)
            on_left, on_right = self.last_rank[a, i], self.first_rank[b, j]
            broken = (across < on_left) & (across <= on_right)
            out[at[broken]] = False
            go = ~broken & ((on_left < NEVER) | (on_right < NEVER))
            grow = on_left <= on_right
            i, j = i + (grow & go), j + (~grow & go)
            at, a, b, i, j = at[go], a[go], b[go], i[go], j[go]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding of one pretoken: the merge of least rank first, and of equals the leftmost."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        return self._merge_short(word, ids) if len(word) <= SHORT else self._merge_long(ids)

    def _merge_short(self, word: bytes, ids: list[int]) -> list[int]:
        get, made = self.rank.get, self.made
        ranks = [self.byte_ranks.get(word[k : k + 2], NEVER) for k in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < NEVER:
            k = ranks.index(least)
            new = ids[k] = made[ids[k], ids[k + 1]]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], new), NEVER)
            if k < len(ranks):
                ranks[k] = get((new, ids[k + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        due = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := self.rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(due)
        while due:
            _, k, x, y = heapq.heappop(due)
            n = after[k]
            if ids[k] != x or n >= len(ids) or ids[n] != y:
                continue
            ids[k], ids[n], after[k] = self.made[x, y], -1, after[n]
            if after[k] < len(ids):
                before[after[k]] = k
            for s in (before[k], k):
                if s >= 0 and after[s] < len(ids) and (r := self.rank.get((ids[s], ids[after[s]]))) is not None:
                    heapq.heappush(due, (r, s, ids[s], ids[after[s]]))
        return [x for x in ids if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        found, k, n, get, lengths = [], 0, len(word), self.id.get, self.lengths.get
        while k < n:
            for m in (*lengths(word[k : k + 3], ()), 2, 1):
                if m <= n - k and (t := get(word[k : k + m])) is not None:
                    found.append(t)
                    k += m
                    break
        return found

    def learn(self, words: set[str]) -> None:
        """Encode new pretokens into self.known, as little-endian 32-bit ids."""
        names = list(words)
        if not names:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in names]
        cuts = [self.greedy(w) for w in raw]
        flat = np.array([t for c in cuts for t in c], np.int64)
        ends = np.cumsum([len(c) for c in cuts])
        bad = ~self.sound[flat]
        inner = np.setdiff1d(np.arange(len(flat) - 1), ends - 1, assume_unique=True)
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad[inner] |= ~self.compatible(codes // self.size, codes % self.size)[back]
        fails = set(np.searchsorted(ends, np.flatnonzero(bad), side="right").tolist())
        for k in fails:
            cuts[k] = self.merge(raw[k])
        for w, c in zip(names, cuts, strict=True):
            self.known[w] = np.array(c, "<u4").tobytes()

    def cut(self, text: str) -> tuple[list[str], bool]:
        """Pretokens in order, and whether special tokens' strings are among them."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.split.findall(text), False
        parts, k = [], 0
        for m in self.specials.finditer(text):
            parts += [*self.split.findall(text[k : m.start()]), m[0]]
            k = m.end()
        return parts + self.split.findall(text[k:]), True

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        held: list[tuple[list[str], bool]] = []
        size = 0
        for text in texts:
            held.append(self.cut(text or ""))
            size += len(text or "")
            if size >= AT_ONCE:
                out += self._join(held)
                held, size = [], 0
        return out + self._join(held)

    def _join(self, held: list[tuple[list[str], bool]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        asked = set().union(*[parts for parts, _ in held]).difference(known, self.special)
        again = asked.intersection(older)
        known.update((w, older[w]) for w in again)
        self.learn(asked - again)
        special = {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        return [b"".join([special[p] if p in special else known[p] for p in parts] if marked else map(known.__getitem__, parts)) for parts, marked in held]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit integers) and decoded (their text) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for batch in cut(batches):
            ids = c.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return shipped(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, each row encoded and decoded in its worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path or default_path()), hashlib.sha256
        for batch in cut(batches):
            ids = c.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                pa.array([sha(c.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shipped(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
