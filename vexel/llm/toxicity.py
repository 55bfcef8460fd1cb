"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases a text, turns letters of other scripts that look Latin, digits and signs that stand for letters into those
letters, and other signs into spaces. The lexicon holds words and beginnings of words, learned with weights from labelled texts;
exception phrases, two words of which one is in the lexicon, cover words within them: those that labelled texts use without harm. A text's score is a logistic function of its matched weight, in all and by length.

Learning takes a bounded sample: at most ``PER_CLASS`` labelled rows of each class, those with the smallest hash of their id; rows
whose crc32(doc_id as text) mod 5 is 0 are never learned from. The lexicon holds all parts of words that the sample shows
to be toxic (a log-likelihood ratio of ``LEAST_G2``), the exceptions all phrases that ``LEAST_PLAIN`` of its harmless texts have
and no toxic one, beside those given. Every text is scored whole.

Defined results: null, empty and blank texts get the score of a text without matches; rows with a null doc_id are scored, and held
out; repeated rows are scored each; without labelled rows of both classes every score is 0; where the sample shows no lexicon, all
scores are the share of toxic labels, or ``NO_MATCH`` if that is less.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.text import cut, shipped

PER_CLASS, LEAST_TOXIC, LEAST_G2, LEAST_PLAIN, NO_MATCH = 3000, 5, 24.0, 5, 0.49
#: What looks like or stands for a Latin letter.
LOOKS = dict(zip("аеорсухіјѕԁһкмтвнαορτυνκιεß", "aeopcyxijsdhkmtbhaoptuvkieß", strict=True))
DIGITS = dict(zip("0134578@$", "oieastbas", strict=True))
#: Phrases whose words are meant otherwise, beside those learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser cup", "white clown fish")
FOLD = {ord(c): " " for c in "\t\n\r\x0b\x0c!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~269«»„“”’…"} | {ord(k): v for k, v in (LOOKS | DIGITS).items()}


def fold(text: str | None) -> str:
    return " " + (text or "").lower().translate(FOLD) + " "


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)
    base: float = -30.0

    def matcher(self):
        a = ahocorasick.Automaton()
        for w, v in self.weights.items():
            a.add_word(w, (len(w), v))
        for p in self.exceptions:
            a.add_word(f" {p}", (len(p) + 1, None))
        if len(a):
            a.make_automaton()
        return a

    def features(self, text: str | None, matcher) -> tuple[float, float, float]:
        """Matched weight (logarithm), by the root of the length, and the largest; the best match counts at each word's beginning."""
        folded = fold(text)
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (n, v) in matcher.iter(folded) if len(matcher) else ():
            start = end - n + 1
            if v is None:
                covered.append((start, end))
            elif v > best.get(start, 0.0):
                best[start] = v
        values = [v for s, v in best.items() if not _inside(s, *merged)] if (merged := _merge(covered))[0] else list(best.values())
        if not values:
            return 0.0, 0.0, 0.0
        total = sum(values)
        return float(np.log1p(total)), total / (1 + folded.count(" ")) ** 0.5, max(values)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + x @ np.array(self.slopes), -30, 30)))


def _merge(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the unions of overlapping spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _inside(at: int, starts: list[int], ends: list[int]) -> bool:
    k = bisect_right(starts, at) - 1
    return k >= 0 and at < ends[k]


def _parts(text: str | None) -> set[str]:
    """Words and beginnings of words, after a space; a whole word ends with one."""
    found: set[str] = set()
    for w in set(fold(text).split()):
        if len(w) > 2:
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in range(3, min(len(w), 9)))
    return found


def _count_parts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            seen = Counter(), Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(_parts(text))
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[k]), pa.string()), pa.array([k] * len(seen[k]), pa.int32()), pa.array(list(seen[k].values()), pa.int64())], ["part", "toxic", "n"])

    rows = shipped(sample).select(F.col("toxic").cast("int"), "text").mapInArrow(run, "part string, toxic int, n long")
    return rows.groupBy("part").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))


def usable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labels that may be learned from."""
    return labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()


def weights_of(labels: DataFrame, per_class: int = PER_CLASS) -> tuple[float, float]:
    """For a row of the sample, plain or toxic: how many learnable labels it stands for."""
    n = {r[0]: r[1] for r in usable(labels).groupBy("toxic").count().collect()}  # two rows
    return tuple(max(1.0, n.get(t, 0) / per_class) for t in (0, 1))


def sample_of(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """toxic and text of at most so many learnable rows of each class; ids are chosen before texts are read."""
    all_ = usable(labels)
    by_hash = lambda t: all_.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return docs.select("doc_id", "text").join(F.broadcast(by_hash(0).union(by_hash(1))), "doc_id").select("toxic", "text")  # at most 2 * per_class ids


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    sample = sample_of(docs, labels, per_class)
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model()
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    n, m = F.col("bad"), F.col("good")
    all_ = n + m
    share = bad / (bad + good)
    g2 = 2 * (term(n, all_ * share) + term(m, all_ * (1 - share)))
    weight = F.ln((n + 0.25) / (bad + 0.5)) - F.ln((m + 0.25) / (good + 0.5))
    ranked = _count_parts(sample).where((n >= LEAST_TOXIC) & (n * good > 3 * m * bad)).select("part", weight.alias("w"), g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
    top = ranked.orderBy(F.desc("g2"), "part").collect()  # parts of at least LEAST_TOXIC of at most per_class texts
    model = Model({r["part"]: float(r["w"]) for r in top}, exceptions)
    return _calibrate(replace(model, exceptions=(*exceptions, *_plain_phrases(sample, model))), sample, weights_of(labels, per_class))


def _plain_phrases(sample: DataFrame, model: Model) -> list[str]:
    """Pairs of neighbouring words, one of them in the lexicon, that harmless texts of the sample have and toxic ones don't."""
    def phrases(text: str | None) -> set[str]:
        words = fold(text).split()
        listed = [f" {w} " in model.weights or any(f" {w[:k]}" in model.weights for k in range(3, min(len(w), 9))) for w in words]
        return {f"{words[k]} {words[k + 1]} " for k in range(len(words) - 1) if listed[k] or listed[k + 1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            seen = Counter((p, t) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in phrases(x))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["phrase", "toxic", "n"])

    told = shipped(sample).select(F.col("toxic").cast("int"), "text").mapInArrow(run, "phrase string, toxic int, n long")
    sums = told.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
    return [r["phrase"] for r in sums.where((F.col("bad") == 0) & (F.col("good") >= LEAST_PLAIN)).orderBy("phrase").collect()]


def _features(frame: DataFrame, model: Model) -> DataFrame:
    """toxic and the features of each sampled row; at most 2 * per_class rows of four numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.matcher()
        for batch in cut(batches):
            x = np.array([model.features(t, a) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(3)]], ["toxic", "x0", "x1", "x2"])

    return shipped(frame).select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, x0 double, x1 double, x2 double")


def _calibrate(model: Model, sample: DataFrame, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Logistic regression by Newton's method with a small ridge; a row of each class counts as many as it stands for, so the share of toxic texts is that of all labels."""
    got = _features(sample, model).toPandas()
    x = np.c_[np.ones(len(got)), got[["x0", "x1", "x2"]].to_numpy()]
    y, w = got["toxic"].to_numpy(float), np.zeros(4)
    times = np.where(y == 1, stands_for[1], stands_for[0])
    times *= len(y) / times.sum()
    ridge = np.diag([0.01, 0.3, 0.3, 0.3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (times * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (times * (y - p)) - ridge @ w)
    return Model(model.weights, model.exceptions, tuple(w[1:]), min(float(w[0]), float(np.log(NO_MATCH / (1 - NO_MATCH)))))


def score_column(model: Model):
    """A pandas function that scores texts."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = model.matcher()
        for texts in batches:
            yield pd.Series(model.score(np.array([model.features(t, a) for t in texts]).reshape(-1, 3)))

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    scored = shipped(docs).select("doc_id", score_column(model)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return shipped(docs).where(score_column(model)(docs["text"]) < 0.5)
