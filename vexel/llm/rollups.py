"""Token totals kept up by deltas.

A ledger is a folder with a subfolder for each committed batch; it holds the batch's signed sums by source, language and
tokenizer version, which were combined before they were shuffled. A batch counts once its folder has Spark's _SUCCESS file: a
second commit of its id changes nothing, and a commit that broke off is overwritten. Totals are kept: every ``fold_after`` batches
the last base and the batches since become a new base, which names the ids that it holds, so that reading costs a base and few
batches however many there were. One writer commits and folds at a time, as one stream or one job does.

Events have op (insert, delete or revise), source, lang, version, tokens and, for revise, old_tokens (null: 0). An insert adds
a document and its tokens, a delete takes both back, a revision adds the difference. Null tokens count as 0, other ops raise
an error; null sources, languages and versions are groups of their own; empty batches commit; totals of an empty ledger are
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.plans import storage

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
#: Tokenizer versions that can be counted without a vocabulary: white-space words; runs of ASCII letters and digits or single other characters.
VERSIONS = {"words-1": "[^\\x20\\x09-\\x0D]+", "pieces-2": "[A-Za-z0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]"}


def count_tokens(text: Column, version: str) -> Column:
    """Each token becomes one mark and spaces vanish, so that the count is a length."""
    text = F.coalesce(text, F.lit(""))
    if version == "words-1":
        return F.char_length(F.regexp_replace(F.regexp_replace(text, VERSIONS[version], "x"), "[^x]+", "")).cast("long")
    return F.char_length(F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9]+", "x"), "[\\x20\\x09-\\x0D]+", "")).cast("long")


def deltas(events: DataFrame) -> DataFrame:
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.lit("op must be insert, delete or revise")).cast("int"))
    now, old = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    change = F.when(F.col("op") == "revise", now - old).otherwise(sign * now)
    return events.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(change).cast("long").alias("tokens"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str, fold_after: int = 16):
        self.spark, self.path, self.fold_after = spark, path.rstrip("/"), fold_after

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={int(batch)}"

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of subfolders of a kind; only names are read."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))

    def _base(self) -> int | None:
        """The newest whole base: its ids are written last."""
        return next((b for b in reversed(self._numbers("base")) if storage.exists(self.spark, f"{self.path}/base={b}/ids/_SUCCESS")), None)

    def _ids(self, base: int | None) -> DataFrame:
        return self.spark.createDataFrame([], "batch long") if base is None else self.spark.read.schema("batch long").parquet(f"{self.path}/base={base}/ids")

    def _written(self, batch: int) -> bool:
        return storage.exists(self.spark, f"{self._folder(batch)}/_SUCCESS")

    def committed(self, batch: int) -> bool:
        return self._written(batch) or not self._ids(self._base()).where(F.col("batch") == int(batch)).isEmpty()

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Add a batch; False if it was there before. Every ``fold_after`` batches the totals are folded."""
        if self.committed(batch):
            return False
        deltas(events).write.mode("overwrite").parquet(self._folder(batch))
        if len(self._loose(self._base())) >= self.fold_after:
            self.fold()
        return True

    def _loose(self, base: int | None) -> list[int]:
        """Committed batches that the base doesn't hold; at most fold_after but for folders that a broken-off fold left."""
        found = [b for b in self._numbers("batch") if self._written(b)]
        held = {r[0] for r in self._ids(base).where(F.col("batch").isin(found)).collect()} if found and base is not None else set()
        return [b for b in found if b not in held]

    def _sums(self, base: int | None, loose: list[int]) -> DataFrame:
        paths = ([f"{self.path}/base={base}/totals"] if base is not None else []) + [self._folder(b) for b in loose]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def fold(self) -> None:
        """Write a new base from the last one and the batches since; then the folders that it holds go. A fold that broke off changes nothing and is done again."""
        base = self._base()
        loose = self._loose(base)
        if not loose:
            return
        new = max(self._numbers("base"), default=0) + 1
        self._sums(base, loose).write.parquet(f"{self.path}/base={new}/totals")
        self._ids(base).union(self.spark.createDataFrame([(b,) for b in loose], "batch long")).write.parquet(f"{self.path}/base={new}/ids")
        for old in [self._folder(b) for b in loose] + [f"{self.path}/base={b}" for b in self._numbers("base") if b < new]:
            storage.remove(self.spark, old)

    def totals(self) -> DataFrame:
        """docs and tokens by key: the base's totals and the signed sums of the batches since."""
        base = self._base()
        return self._sums(base, self._loose(base))

    def follow(self, events: DataFrame):
        """A streaming writer that commits each micro-batch under its id."""
        return events.writeStream.foreachBatch(lambda df, batch: self.commit(batch, df))
