"""Measures of search results against ground truth, and the frontier of operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """Share of queries whose first true id is among the first r found."""
    first = truth.where("rank = 1").select("query_id", F.col("id").alias("true_id"))
    hits = found.where(F.col("rank") <= r).join(first, "query_id").where("id = true_id").select("query_id").distinct().withColumn("hit", F.lit(1))
    return first.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def intersection_at(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """Mean share of the first r true ids among the first r found."""
    both = found.where(F.col("rank") <= r).select("query_id", "id").join(truth.where(F.col("rank") <= r).select("query_id", "id"), ["query_id", "id"], "left_semi")
    return both.agg(F.count("*").alias("n")).crossJoin(truth.agg(F.count_distinct("query_id").alias("q"))).select((F.col("n") / (F.col("q") * r)).alias("overlap"))


def frontier(points: DataFrame) -> DataFrame:
    """Points (perf, t, key) of which none other is as good and faster, or better and as fast; perf 0 is left out."""
    faster = F.min("t").over(Window.orderBy(F.desc("perf"), "t", "key").rowsBetween(Window.unboundedPreceding, -1))
    return points.where("perf > 0").withColumn("before", faster).where(F.col("before").isNull() | (F.col("t") < F.col("before"))).drop("before")


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Over all pairs (query_id, id): precision is 1 if nothing was found; recall without truth is 1 if nothing was found, else 0."""
    n = found.agg(F.count("*").alias("nf")).crossJoin(truth.agg(F.count("*").alias("nt"))).crossJoin(found.join(truth, ["query_id", "id"], "left_semi").agg(F.count("*").alias("nb")))
    return n.select(
        F.when(F.col("nf") > 0, F.col("nb") / F.col("nf")).otherwise(1.0).alias("precision"),
        F.when(F.col("nt") > 0, F.col("nb") / F.col("nt")).when(F.col("nf") > 0, 0.0).otherwise(1.0).alias("recall"),
    )


def radius_for(found: DataFrame, most: int) -> DataFrame:
    """The rows strictly within the distance of the (most + 1)-th smallest; all if there are no more."""
    edge = found.orderBy("distance").limit(most + 1).agg(F.max("distance").alias("edge"), F.count("*").alias("n"))
    return found.join(F.broadcast(edge)).where((F.col("n") <= most) | (F.col("distance") < F.col("edge"))).drop("edge", "n")  # edge is one row


def matrix_stats(vectors: DataFrame) -> DataFrame:
    """pos, min, max, mean, std, n_nan, n_inf and n of each coordinate."""
    x = F.col("x").cast("double")
    return vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.sum(F.isnan(x).cast("long")).alias("n_nan"), F.sum((F.abs(x) == float("inf")).cast("long")).alias("n_inf"), F.count("*").alias("n"),
    )


class ParameterSpace:
    """Values of named parameters, and a walk over all combinations that skips what earlier points rule out."""

    def __init__(self, **values: list):
        self.values = values

    def combinations(self) -> list[dict]:
        out: list[dict] = [{}]
        for name, vs in self.values.items():
            out = [o | {name: v} for o in out for v in vs]
        return out

    @staticmethod
    def parse(text: str) -> dict[str, float]:
        """"nprobe=4,ht=30" as a dictionary."""
        return {k.strip(): float(v) for k, v in (p.split("=") for p in text.split(",") if p)}

    def explore(self, measure) -> list[dict]:
        """measure(params) gives (perf, t); a combination that costs no less than one with the same bound on perf is skipped."""
        done: list[dict] = []
        for params in self.combinations():
            under = [d for d in done if all(params[k] <= d["params"][k] for k in params)]
            over = [d for d in done if all(params[k] >= d["params"][k] for k in params)]
            bound_perf, bound_t = min((d["perf"] for d in under), default=1.0), max((d["t"] for d in over), default=0.0)
            if any(d["perf"] >= bound_perf and d["t"] <= bound_t for d in done):
                continue
            perf, t = measure(params)
            done.append({"params": params, "perf": perf, "t": t})
        return done
