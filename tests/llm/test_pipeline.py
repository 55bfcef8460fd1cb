"""The corpus pipeline stage by stage against brute force, on a small folder of tables with odd rows and an extra column."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vexel.llm import bpe

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def prose(rng, n, bad=False):
    said = [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("dlmnrst") + rng.choice("aeiou") + rng.choice("xyz") for _ in range(n)]
    if bad:
        for k in range(0, n, 6):
            said[k] = "grobnak"
    return " ".join(said) + "."


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The folder and, for each document, what it is."""
    rng, where = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    item = prose(rng, 40)
    rows, kind = [], {}

    def add(what, text, toxic=None, **more):
        i = len(rows)
        rows.append((i, text, more.get("lang", "en"), "s", len(text or ""), "clash"))
        kind[i] = (what, toxic)
        return text

    for _ in range(160):
        add("clean", prose(rng, 90), 0)
    for _ in range(60):
        add("toxic", prose(rng, 90, True), 1)
    for _ in range(8):
        add("junk", " ".join(w + "###" for w in prose(rng, 90).split()))
    for text in (None, "", " \n ", "a few words"):
        add("short", text)
    whole = add("clean", prose(rng, 400))
    for _ in range(3):
        add("copy", whole)
    add("copy", whole.capitalize())
    add("leak", prose(rng, 60)[:-1] + " " + item.capitalize() + " " + prose(rng, 60))
    add("clean", prose(rng, 100), lang=None)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, (_, t) in kind.items() if t is not None], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, {k: w for k, (w, _) in kind.items()}, {r[0]: r[1] for r in rows}


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def base_fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = list(zip(w, w[1:], w[2:]))
    often = Counter(runs)
    return len(w) < 50 or 2 * len({i + k for i, x in enumerate(runs) if often[x] > 1 for k in range(3)}) > len(w)


def print_of(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def one_of_each(texts):
    prints, root = {i: print_of(t) for i, t in texts.items()}, {i: i for i in texts}
    for _ in texts:
        before = dict(root)
        for i in texts:
            root[i] = min(root[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 3)
        if root == before:
            break
    return sorted(set(root.values()))


def test_stages(spark, made):
    where, kind, text = made
    docs = spark.read.parquet(f"{where}/documents.parquet")
    expected = {
        "quality rules": lambda left: [i for i in left if not base_fails(text[i]) and kind[i] != "junk"],
        "toxicity": lambda left: [i for i in left if "grobnak" not in text[i]],
        "near-dedup": lambda left: one_of_each({i: text[i] for i in left}),
        "decontamination": lambda left: [i for i in left if kind[i] != "leak"],
    }
    left = ids(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns
        now = ids(out)
        assert now == expected[name](left) and len(now) < len(left), name
        docs, left = docs.where(F.col("doc_id").isin(now)), now
    tokenizer = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, where).collect()}
    for i in left:
        own = tokenizer.encode(text[i], add_special_tokens=False).ids
        assert got.pop(i) == (len(own), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in own)).hexdigest(), hashlib.sha256(tokenizer.decode(own, skip_special_tokens=False).encode()).hexdigest())
    assert not got


def test_odd_rows_pass_each_stage(spark, made):
    """Null ids, repeated rows and an empty table go through every stage alone, with a defined result."""
    where, _, text = made
    long = text[232]
    rows = [(None, long, None, None, None, None), (None, long, None, None, None, None), (7, long, "en", None, None, "x"), (7, long, "en", None, None, "x"), (8, None, None, None, None, None), (9, "", "en", "s", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    count = {"quality rules": 4, "toxicity": 6, "near-dedup": 2, "decontamination": 6, "bpe": 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, where).count() == count[name], name
        assert stage(spark, docs.where("false"), where).count() == 0, name
