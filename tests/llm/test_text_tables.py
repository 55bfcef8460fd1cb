"""Tables with whole texts are written in small row groups, as each task holds one."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vexel.llm import quality
from vexel.plans.storage import TEXT_GROUP


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng, where = random.Random(5), str(tmp_path_factory.mktemp("texts"))
    rows = [(i, " ".join("%0100x" % rng.getrandbits(400) for _ in range(120)), "en", "s", 1) for i in range(2500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{where}/documents.parquet")
    return where


def groups(table):
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in table.inputFiles()]
    made = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
    return [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in made]


def test_statistics_are_stored_beside_texts_in_small_groups(spark, monkeypatch, docs):
    seen = []
    monkeypatch.setattr(quality, "judge_rows", lambda stats: (seen.append(stats), stats.withColumn("kept", F.lit(True)))[1])
    assert quality.keep_good(spark.read.parquet(f"{docs}/documents.parquet")).count() == 2500
    assert len(groups(seen[0])) >= 2 and max(groups(seen[0])) < 1.5 * TEXT_GROUP


def test_what_goes_on_between_stages_is_in_small_groups(spark, monkeypatch, docs):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda s, d, f: d.coalesce(1)), ("last", lambda s, d, f: d)])
    out = corpus_pipeline.run(spark, docs)
    assert out.count() == 2500 and len(groups(out)) >= 2 and max(groups(out)) < 1.5 * TEXT_GROUP
