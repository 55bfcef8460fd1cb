"""Binary vectors: tables with id and word (a long of 64 bits)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions.distance import hamming, hamming_words, sign_bits, subtract
from vexel.operators.flat import best, nearest_in_lists
from vexel.plans.storage import materialize


def _pairs(base: DataFrame, queries: DataFrame) -> DataFrame:
    pairs = base.select("id", "word").crossJoin(queries.select("query_id", F.col("word").alias("query_word")))
    return pairs.select("query_id", "id", hamming(F.col("word"), F.col("query_word")).alias("distance"))


def knn(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return best(_pairs(base, queries), k)


def range_search(base: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """Pairs at a distance strictly below the radius."""
    return _pairs(base, queries).where(F.col("distance") < radius)


def key(word: Column, start: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, start).bitwiseAND((1 << bits) - 1)


def hash_search(base: DataFrame, queries: DataFrame, k: int, bits: int = 16, nflip: int = 1, tables: int = 1) -> DataFrame:
    """Rows that share a key of so many bits, up to nflip flips, in any of the tables; then exact distances."""
    masks = F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for n in range(nflip + 1) for c in combinations(range(bits), n)])
    cell = lambda t: F.struct(F.lit(t).alias("t"), key(F.col("word"), t * bits, bits).alias("v"))
    stored = base.select("id", "word", F.explode(F.array(*[cell(t) for t in range(tables)])).alias("c")).select("id", "word", "c.t", "c.v")
    asked = queries.select("query_id", F.col("word").alias("query_word"), F.explode(F.array(*[cell(t) for t in range(tables)])).alias("c"), masks.alias("m"))
    asked = asked.select("query_id", "query_word", F.col("c.t").alias("t"), F.explode("m").alias("m"), F.col("c.v").alias("v")).withColumn("v", F.col("v").bitwiseXOR(F.col("m"))).drop("m")
    met = stored.join(asked, ["t", "v"]).select("query_id", "id", hamming(F.col("word"), F.col("query_word")).alias("distance")).distinct()
    return best(met, k)


def count_within(base: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """query_id and n, the number of rows at a distance strictly below the radius; queries without any are left out."""
    return range_search(base, queries, radius).groupBy("query_id").agg(F.count("*").alias("n"))


@dataclass
class WordLists:
    """Inverted lists of words: centre words (at most a few thousand, held in the plan) and lists (list_no, id, word)."""

    centres: list[int]
    lists: DataFrame

    @staticmethod
    def build(base: DataFrame, centres: list[int]) -> WordLists:
        """Each row goes to the nearest centre, the first of equals; null words are left out."""
        rows = base.where("word IS NOT NULL").select("id", "word")
        return WordLists(centres, rows.select(F.array_min(_ranked(F.col("word"), centres))["i"].alias("list_no"), "id", "word"))

    @staticmethod
    def train(base: DataFrame, nlist: int, rounds: int = 5) -> list[int]:
        """Centres by majority of bits; starts from distinct words of least hash. An empty list keeps its centre."""
        chosen = base.where("word IS NOT NULL").select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(nlist)
        centres = [r["word"] for r in chosen.collect()]
        bit = lambda i: F.when(2 * F.sum(F.shiftright("word", i).bitwiseAND(1)) >= F.count("*"), F.lit(1)).otherwise(F.lit(0))
        for _ in range(rounds if centres else 0):
            votes = WordLists.build(base, centres).lists.groupBy("list_no").agg(*[bit(i).alias(f"b{i}") for i in range(64)]).collect()
            for r in votes:  # one row a list
                word = sum(r[f"b{i}"] << i for i in range(64))
                centres[r["list_no"]] = word - (1 << 64) if word >> 63 else word
        return centres

    def search(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        asked = queries.select("query_id", F.col("word").alias("query_word"), F.explode(F.slice(F.sort_array(_ranked(F.col("word"), self.centres)), 1, nprobe)["i"]).alias("list_no"))
        found = nearest_in_lists(self.lists, queries.select("query_id", "word"), asked.select("query_id", "list_no"), k, "hamming", "word", np.int64)
        return found.withColumn("distance", F.col("distance").cast("int"))


def _ranked(word: Column, centres: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(c).cast("long") for c in centres]), lambda c, i: F.struct(hamming(word, c).alias("d"), i.alias("i")))


def medians(base: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row: thresholds, each coordinate's lower median (the value of rank ceil(n / 2)), as an array.

    Approximate ranks, to one part in accuracy, bound a few values about the middle; those are counted and ranked exactly."""
    long = base.select(F.posexplode("vec").alias("pos", "x")).where("x IS NOT NULL")
    share = 2 / accuracy
    about = long.groupBy("pos").agg(F.percentile_approx("x", F.array(F.lit(0.5 - share), F.lit(0.5 + share)), accuracy).alias("e"))
    edges = materialize(about.select("pos", F.get("e", F.lit(0)).alias("low"), F.get("e", F.lit(1)).alias("high")), "edges")  # a row a coordinate
    met = long.join(F.broadcast(edges), "pos")
    sizes = met.groupBy("pos").agg(F.count("*").alias("n"), F.count_if(F.col("x") < F.col("low")).alias("below"))
    values = met.where(F.col("x").between(F.col("low"), F.col("high"))).groupBy("pos", "x").agg(F.count("*").alias("same"))
    upto = F.sum("same").over(Window.partitionBy("pos").orderBy("x"))
    ranked = values.withColumn("upto", upto).join(F.broadcast(sizes), "pos").where(F.col("below") + F.col("upto") >= F.ceil(F.col("n") / 2))
    exact = ranked.groupBy("pos").agg(F.min("x").alias("t"))
    return exact.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]).alias("thresholds"))  # one row a coordinate


def lsh_words(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """id and word: a bit for each of up to 64 coordinates, one at or above its threshold."""
    return rows.join(F.broadcast(thresholds)).select("id", sign_bits(subtract(F.col("vec"), F.col("thresholds"))).alias("word"))  # thresholds are one row


def lsh_search(rows: DataFrame, d: int, queries: DataFrame, k: int, thresholds: DataFrame | None = None) -> DataFrame:
    """The k rows whose codes differ least from the query's; codes have a bit for each of d coordinates, in words of 64."""
    def coded(t: DataFrame) -> DataFrame:
        t = t.where("vec IS NOT NULL")
        t = t.withColumn("x", F.col("vec")) if thresholds is None else t.join(F.broadcast(thresholds)).withColumn("x", subtract(F.col("vec"), F.col("thresholds")))
        return t.withColumn("words", F.array(*[sign_bits(F.slice("x", i + 1, min(64, d - i))) for i in range(0, d, 64)]))

    pairs = coded(rows).select("id", "words").crossJoin(coded(queries).select("query_id", F.col("words").alias("query_words")))
    return best(pairs.select("query_id", "id", hamming_words(F.col("words"), F.col("query_words")).alias("distance")), k)


def spectral_word(vec: Column, shift: Column, period: float) -> Column:
    """Up to 64 bits: floor(2 * (x - shift) / period) mod 2 of each coordinate."""
    odd = F.zip_with(vec, shift, lambda x, c: F.pmod(F.floor((x.cast("double") - c) * 2.0 / period), F.lit(2)) == 1)
    return sign_bits(F.transform(odd, lambda b: F.when(b, 1).otherwise(-1)))


def spectral_search(lists: DataFrame, centres: DataFrame, queries: DataFrame, probes: DataFrame, k: int, period: float) -> DataFrame:
    """Codes of residuals to the centre of each list (list_no, id, vec; centres: list_no, vec), compared with the query's code in that list."""
    c = centres.select("list_no", F.col("vec").alias("centre"))
    stored = lists.join(c, "list_no").select("list_no", "id", spectral_word(F.col("vec"), F.col("centre"), period).alias("word"))
    asked = probes.select("query_id", "list_no").join(queries, "query_id").join(c, "list_no")
    asked = asked.select("list_no", "query_id", spectral_word(F.col("vec"), F.col("centre"), period).alias("query_word"))
    return best(stored.join(asked, "list_no").select("query_id", "id", hamming(F.col("word"), F.col("query_word")).alias("distance")), k)
