"""Files of vectors: fvecs, ivecs, bvecs (a length before each row) and fbin (two counts, then all values)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.plans.storage import ship

KINDS = {"fvecs": np.dtype("<f4"), "ivecs": np.dtype("<i4"), "bvecs": np.dtype("u1")}


def parse(raw: bytes, kind: str) -> np.ndarray:
    """The rows of a whole file's bytes."""
    if kind == "fbin":
        n, d = np.frombuffer(raw, "<u4", 2)
        return np.frombuffer(raw, "<f4", int(n) * int(d), 8).reshape(int(n), int(d))
    if not raw:
        return np.zeros((0, 0), KINDS[kind])
    d = int(np.frombuffer(raw, "<i4", 1)[0])
    rows = np.frombuffer(raw, "u1").reshape(-1, 4 + d * KINDS[kind].itemsize)
    return np.ascontiguousarray(rows[:, 4:]).view(KINDS[kind])


def pack(x: np.ndarray, kind: str) -> bytes:
    if kind == "fbin":
        return np.array(x.shape, "<u4").tobytes() + x.astype("<f4").tobytes()
    head = np.full((len(x), 1), x.shape[1], "<i4").view("u1")
    return np.hstack([head, np.ascontiguousarray(x.astype(KINDS[kind])).view("u1").reshape(len(x), -1)]).tobytes()


def read(spark: SparkSession, path: str, kind: str, d: int) -> DataFrame:
    """id and vec. Rows of a *vecs file have equal length, so Spark splits the file by records of that size; an fbin file goes whole to one task."""
    ship(spark)
    if kind == "fbin":
        def whole(frames):
            import pandas as pd

            for f in frames:
                for raw in f["content"]:
                    x = parse(raw, kind)
                    yield pd.DataFrame({"id": np.arange(len(x)), "vec": [r.astype(float).tolist() for r in x]})

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(whole, "id long, vec array<double>")
    width = 4 + d * KINDS[kind].itemsize
    rows = spark.sparkContext.binaryRecords(path, width).zipWithIndex().map(lambda t: (t[1], [float(v) for v in np.frombuffer(t[0], KINDS[kind], d, 4)]))
    return spark.createDataFrame(rows, "id long, vec array<double>")


def write(vectors: DataFrame, path: str, kind: str) -> None:
    """To one file on the driver's file system, in the order of ids, a row at a time."""
    with open(path, "wb") as out:
        for r in vectors.select("id", "vec").orderBy("id").toLocalIterator():
            out.write(pack(np.array([r["vec"]]), kind))


def write_parts(vectors: DataFrame, path: str) -> None:
    """As Parquet, clustered by id, so that selectors on ids prune row groups."""
    vectors.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def synthetic(spark: SparkSession, n: int, d: int, seed: int = 1338) -> DataFrame:
    """Vectors of ten hidden dimensions bent by sines."""
    ship(spark)
    rng = np.random.default_rng(seed)
    mix, scale = rng.random((10, d)), rng.random(d) * 4 + 0.1

    def run(frames):
        import pandas as pd

        for f in frames:
            x = np.stack([np.random.default_rng(seed + int(i)).normal(size=10) for i in f["id"]])
            yield pd.DataFrame({"id": f["id"], "vec": list(np.sin(x @ mix * scale))})

    return spark.range(n).mapInPandas(run, "id long, vec array<double>").withColumn("vec", F.col("vec"))
