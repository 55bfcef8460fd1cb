"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Row groups of tables with whole texts. Parquet's 128 MB, one for each core, can fill a worker's heap.
TEXT_GROUP = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; without one, a local folder in local mode and the warehouse elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):  # one machine and one process
        return f"file://{tempfile.gettempdir()}/vexel-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/vexel-shared"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, group: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the new plan holds no lineage, so a lost executor costs one read.

    With group, row groups of about so many bytes: each task holds one until it is written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer if group is None else writer.option("parquet.block.size", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no DataFrame in use refers to: its cleaner acts when the driver collects garbage, which in a long run of steps may otherwise be after the last."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that materialize() or an archive made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: once for each application, as a zip that Spark distributes."""
    sc = spark.sparkContext
    if getattr(sc, "_vexel_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    packed = Path(tempfile.mkdtemp()) / "vexel.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(packed))
    sc._vexel_shipped = True
