"""Streams of vectors: a table of slices that keeps the newest, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.plans import storage


class SlidingSlices:
    """A folder with a subfolder per slice. Adding a slice again changes nothing; slices beyond the width are dropped."""

    def __init__(self, spark: SparkSession, path: str, width: int, schema: str = "id long, vec array<double>"):
        self.spark, self.path, self.width, self.schema = spark, path.rstrip("/"), width, schema

    def slices(self) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("slice="))
        return [s for s in found if storage.exists(self.spark, f"{self.path}/slice={s}/_SUCCESS")]

    def step(self, rows: DataFrame, number: int) -> None:
        if number not in self.slices():
            rows.write.mode("overwrite").parquet(f"{self.path}/slice={number}")
        for old in [s for s in self.slices() if s <= number - self.width]:
            storage.remove(self.spark, f"{self.path}/slice={old}")

    def table(self) -> DataFrame:
        held = self.slices()
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/slice={s}" for s in held]) if held else self.spark.createDataFrame([], self.schema)

    def follow(self, stream: DataFrame):
        return stream.writeStream.foreachBatch(lambda rows, number: self.step(rows, number))


def tumbling_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window_start, event_type and n, for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
