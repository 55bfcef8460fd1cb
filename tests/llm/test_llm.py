"""Operators of the training-data folder against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vexel.llm import bpe, chat, decontam, lm, quality, rollups, simhash, toxicity, urls, warc
from vexel.plans import storage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"w{i * 7919 % 613} the{i % 11}" for i in range(120))
TEXTS = [None, "", " \n\t ", "One two", "a b a b a b c", PROSE, PROSE, PROSE.upper(), PROSE.replace("w7 ", "w8 "), "x#$%&\n\nx#$%&\n y \n y ", "étoile 漢字 😀 " * 30, PROSE * 40]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 1, "clash") for i, t in enumerate(TEXTS)] + [(None, PROSE, "en", "s", 1, "clash"), (5, PROSE, "en", "s", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, print string")


def words(text):
    return WORD.findall(text or "")


def test_statistics(docs):
    for r, s in zip(*[sorted(x.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])) for x in (docs, quality.statistics(docs))], strict=True):
        w, text = words(r["text"]), r["text"] or ""
        runs = list(zip(w, w[1:], w[2:]))
        often = Counter(runs)
        spots = {i + k for i, x in enumerate(runs) if often[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(spots))
        assert s["base_failed"] == (len(w) < 50 or 2 * len(spots) > len(w))


def test_outliers(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "to"]) + str(rng.randrange(500)) for _ in range(80)) + "." for _ in range(150)]
    junk = [" ".join(w + "###" for w in clean[i].split()) for i in range(12)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert sum(kept[i] for i in range(150)) == 150 and not any(kept[150 + i] for i in range(12))
    assert quality.keep_good(df).columns == df.columns
    assert quality.judge(df.where("false")).count() == 0


def test_warc(spark):
    rows = [(3, "http://a", "<p>same"), (1, "http://b", "<p>same"), (2, None, None), (4, "http://c", ""), (5, "http://d\r\nX: y", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = storage.new_path(spark, "warc")
    warc.write(pages, path)
    back = warc.restore(spark, path)
    by = {r["page_id"]: r for r in warc.describe(back).collect()}
    assert by[1]["record_type"] == "response" and by[3]["refers_to"] == 1 and by[4]["refers_to"] == 2 and by[5]["payload_bytes"] == 10000
    import base64

    for i, _, html in rows:
        assert by[i]["payload_digest"] == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    for r in back.collect():
        head, rest = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert warc.roundtrip(pages.where("false")).count() == 0


def test_warc_odd_rows_and_damage(spark):
    rows = [(None, "http://a", "same page"), (1, "http://b", "same page"), (1, "http://c", "same page"), (2, "http://ü/\r\n\r\nx", "\r\n\r\n"), (3, None, "x"), (4, None, "x"), (5, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.roundtrip(pages, least=2).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([(0, "revisit", 1, 9), (1, "response", None, 9), (1, "response", None, 9), (2, "response", None, 4), (3, "response", None, 1), (4, "response", None, 1), (5, "response", None, 300_000)], key=lambda k: k[:1] + k[1:2])
    path = storage.new_path(spark, "warc")
    warc.write(pages, path)
    back = warc.restore(spark, path)
    changed = F.encode(F.replace(F.col("record").cast("string"), F.lit("same page"), F.lit("Same page")), "UTF-8")
    with pytest.raises(Exception, match="not what its headers state"):  # the digests are those of the record's own bytes
        warc.describe(back.withColumn("record", changed)).collect()
    with pytest.raises(Exception, match="not what its headers state"):
        warc.describe(back.withColumn("record", F.concat("record", F.encode(F.lit("x"), "UTF-8")))).collect()
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{path}/bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/bad/records")
    with pytest.raises(Exception, match="payload does not match"):
        warc.restore(spark, f"{path}/bad").collect()


def test_decontamination(spark, docs):
    item = " ".join(f"q{i}" for i in range(30))
    near = item.split()
    near.insert(1, "extra")
    bench = spark.createDataFrame([(1, item), (2, "tiny one"), (3, None), (4, "")], "item_id long, text string")
    texts = ["pad " * 20 + item.upper() + "! more words", " ".join(["pad"] * 9 + near + ["pad"] * 9), item[:40], None, "", "some tiny one here", "Tiny, one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(rows, bench).collect()}
    assert {(0, 1), (1, 1), (6, 2)} <= found and not {d for d, _ in found} & {2, 3, 4}
    left = decontam.remove_matched(rows, bench)
    assert left.columns == rows.columns and {r["doc_id"] for r in left.collect()} & {0, 1} == set()
    assert decontam.matches(rows.where("false"), bench).count() == 0 and decontam.matches(rows, bench.where("false")).count() == 0


def test_decontamination_by_brute_force(spark):
    """Every window of each item's size, by exact similarity, on passages with edits at their ends and inside."""
    rng = random.Random(7)
    prose = lambda n: [rng.choice("abcdefgh") + rng.choice("mnop") + str(rng.randrange(12)) for _ in range(n)]
    items, texts = [prose(n) for n in (1, 4, 5, 6, 9, 16, 25, 40, 58, 59, 134)], []
    for k in range(150):
        w = list(items[k % len(items)])
        for _ in range(rng.randrange(4)):
            i = rng.choice((0, len(w) // 2, len(w) - 1, rng.randrange(len(w))))
            w[i : i + rng.randrange(2)] = prose(rng.randrange(1, 3))
        texts.append(prose(rng.randrange(30)) + w + prose(rng.randrange(30)))
    for item, ends, gap in ((items[8], 1, 2), (items[10], 5, 6)):  # the best window begins between the passage's two parts
        mid = len(item) // 2
        texts.append(prose(20) + ["x"] * ends + item[ends:mid] + ["y"] * gap + item[mid:-ends] + ["z"] * ends + prose(20))

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    expected = {}
    for d, w in enumerate(texts):
        for i, item in enumerate(items):
            own = grams(item)
            for at in range(max(1, len(w) - len(item) + 1)) if len(item) > 4 or len(w) <= len(item) else ():
                other = grams(w[at : at + len(item)])
                same = sum((own & other).values()) / sum((own | other).values())
                if same >= 0.8:
                    expected[d, i] = max(same, expected.get((d, i), 0))
    docs_ = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(docs_, bench).collect()}
    assert len(expected) > 60 and (150, 8) in expected and (151, 10) in expected
    assert found == pytest.approx(expected)


def test_blocks_find_all_within_radius(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(60):
        a, far = rng.getrandbits(64), rng.randrange(24)
        b = a
        for k in rng.sample(range(64), far):
            b ^= 1 << k
        pairs.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.arrays_overlap(decontam.keys(F.col("a")), decontam.keys(F.col("b"), decontam.FLIPS))).count() == 60


def test_language_model(spark, docs):
    got = [r for r in lm.learn_and_score(docs).collect()]
    seen, n = Counter(), 0
    rows = docs.collect()
    low = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    for r in rows:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            seen.update(low(r["text"]))
            n += len(low(r["text"]))
    expected = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(low(r["text"])), sum(seen[w] > 0 for w in low(r["text"])), round(sum(math.log10((seen[w] + 1) / (n + len(seen) + 1)) for w in low(r["text"])), 6)) for r in rows)
    assert expected == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["train_tokens"] == n for r in got)
    assert lm.learn_and_score(docs.where("false")).count() == 0


def test_rare_tokens_are_joined(docs, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 3)
    few = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in lm.learn_and_score(docs).collect()}
    monkeypatch.setattr(lm, "HOT", 20_000)
    assert few == {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in lm.learn_and_score(docs).collect()}


def test_chat(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nx", "\\", "<\\|", "\\<|\\\\|<", "", None, "ends <"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)] + [(2, 0, "us\ner\\n<|", "hi"), (3, 0, None, None), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(0))
    made = chat.transcripts(df)
    by = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in (1, 2, 3):
        mine = [r for r in rows if r[0] == c]
        assert by[c]["n_turns"] == len(mine)
        assert by[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (by[c]["loss_chars"], by[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = chat.full_examples(made).orderBy("conv_id", "place").collect()
    assert len(full) == 3 and all(x["context"].endswith("<|im_start|>assistant\n") for x in full)
    assert chat.read_back(chat.transcripts(df.where("false"))).count() == 0


def test_chat_examples_carry_the_result(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (None, 0, "a\x00\\\nb<\\|", "t"), (None, 1, "assistant", "ü\\"), (4, 0, "assistant", None), (5, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("clash"))
    made = chat.transcripts(df)
    by = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in (1, None, 4, 5):
        mine = [r for r in rows if r[0] == c]
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert by[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (by[c]["n_turns"], by[c]["loss_sha256"], by[c]["loss_chars"]) == (len(mine), hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    for r in chat.expand(made).collect():
        assert r["formatted"][r["context_chars"] :].startswith(r["target"] + "<|im_end|>") and r["formatted"][: r["context_chars"]].endswith("<|im_start|>assistant\n")
    moved = made.withColumn("examples", F.transform("examples", lambda e: e.withField("context_chars", e["context_chars"] + 1)))
    with pytest.raises(Exception, match="no assistant's text"):
        chat.read_back(moved).collect()
    none = made.withColumn("examples", F.slice("examples", 1, 0))
    assert {r["loss_chars"] for r in chat.read_back(none).collect()} == {0}  # the loss text is that of the exploded rows


def test_urls(spark):
    cases = {"https://a.example.net/en/1": "example.net/en/", "http://x.net/q": "net/", "http://X.NET": None, "http://a.org/fr/x?y": "org/fr/", "http://example.com/de/": "example.com/de/", "http://badexample.com/de/": None, "nothing": None, None: None, "http://casino-win.example.com/": None, "http://quiet.example.com/x#y": None}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.verdicts(df).collect()}
    assert [got[i]["rule"] for i in range(len(cases))] == list(cases.values())
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow" and got[6]["verdict"] == "allow" and got[9]["path"] == "/x"
    judge = urls.Judge(urls.lexicon())
    assert urls.split_words("freecasinobonus", judge.cost, judge.total) == ["free", "casino", "bonus"]
    assert urls.verdicts(df.where("false")).count() == 0


def test_rollups(spark):
    ledger = rollups.Ledger(spark, storage.new_path(spark, "ledger"))
    event = lambda rows: spark.createDataFrame(rows, "op string, source string, lang string, version string, tokens long, old_tokens long")
    assert ledger.totals().count() == 0
    first = event([("insert", "a", "en", "v", 5, None), ("insert", "a", "en", "v", 7, None), ("insert", None, None, "v", None, None)])
    assert ledger.commit(1, first) and not ledger.commit(1, first)
    ledger.commit(2, event([("delete", "a", "en", "v", 5, None), ("revise", "a", "en", "v", 9, 7)]))
    ledger.commit(3, first.where("false"))
    assert {(r["source"], r["docs"], r["tokens"]) for r in ledger.totals().collect()} == {("a", 1, 9), (None, 1, 0)}
    with pytest.raises(Exception, match="op must be"):
        ledger.commit(4, event([("upsert", "a", "en", "v", 5, None)]))
    assert not ledger.committed(4) and ledger.commit(4, first)  # a commit that broke off is done again


def test_rollups_are_folded(spark):
    """Totals are a base and the batches since; folded batches count once, also where a fold broke off."""
    path = storage.new_path(spark, "ledger")
    ledger = rollups.Ledger(spark, path, fold_after=2)
    one = spark.createDataFrame([("insert", "a", "en", "v", 5, None)], "op string, source string, lang string, version string, tokens long, old_tokens long")
    total = lambda: tuple(ledger.totals().select("docs", "tokens").first())
    for k in (7, 3, 9, 1, 2):
        assert ledger.commit(k, one) and not ledger.commit(k, one)
    assert total() == (5, 25) and ledger._base() == 2 and ledger._numbers("batch") == [2]
    rollups.deltas(one).write.parquet(f"{path}/batch=3")  # a folder that a broken-off fold left behind
    spark.createDataFrame([("a", "en", "v", 99, 99)], rollups.SCHEMA).write.parquet(f"{path}/base=8/totals")  # a base without its ids
    assert total() == (5, 25) and all(not ledger.commit(k, one) for k in (7, 3, 9, 1, 2))
    ledger.fold()
    assert total() == (5, 25) and ledger._base() == 9 and ledger._numbers("base") == [9]


def test_toxicity(spark):
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["lo", "mi", "ra", "tu"]) + rng.choice(["ne", "so", "pa"]) + rng.choice(["x", "y", "z"]) for _ in range(40))
    texts = [(i, plain() + (f" zorgle{i % 3}ish you " if i % 4 == 0 else " ") + plain(), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == t for i, _, t in texts) >= 396
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "Z0RGLE1ISH zоrgle1ish you"), (4, plain())], "doc_id long, text string")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(odd, model).collect()}
    assert scores == {1: 0, 2: 0, None: 1, 4: 0}
    assert toxicity.keep_clean(odd.withColumn("score", F.lit(1)), model).columns == ["doc_id", "text", "score"]
    assert not toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("false")).weights
    many = toxicity.Model({" trash": 5.0, " sore": 1.0}, ("trash can", "can sore"), slopes=(1.0, 0, 0), base=-1)
    began = time.time()
    assert many.features("trash can sore " * 30_000, many.matcher())[0] == 0 and time.time() - began < 5
    assert many.features("trash can " * 5 + "trash", many.matcher())[0] > 0
    m = toxicity.Model({" trash": 5.0}, slopes=(1.0, 0, 0), base=-1)
    assert m.features("a trash can", m.matcher())[0] == 0 and m.features("trash", m.matcher())[0] > 0


def test_exceptions_are_learned(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["lo", "mi", "ra", "tu"]) + rng.choice(["ne", "so", "pa"]) + rng.choice(["x", "y", "z"]) for _ in range(30))
    texts = [(i, plain() + (f" you zorgle {plain()}" if i % 4 == 0 else " zorgle fish " if i % 8 == 1 else " "), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([*texts, (0, texts[0][1], 1)], "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "zorgle fish " in model.exceptions
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == t for i, _, t in texts) >= 590


def test_windows_meet_only_their_items(spark):
    """Rows after the join on blocks grow with windows, not with windows times items; items that share an id or have none are items of their own."""
    words = [f"w{k}" for k in range(400)]
    bench = spark.createDataFrame([((k % 37) or None, " ".join(words[k : k + 20])) for k in range(0, 380, 5)], "item_id long, text string")
    docs_ = spark.createDataFrame([(k, " ".join(words[5 * k : 5 * k + 60])) for k in range(60)], "doc_id long, text string")
    found = decontam.matches(docs_, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, (k % 37) or None) for d in range(60) for k in range(0, 380, 5) if 5 * d <= k and k + 20 <= min(5 * d + 60, 400)} | {(r["doc_id"], r["item_id"]) for r in found if r["similarity"] < 1}
    items = decontam.items_of(bench)
    print_of = items.select("item", "item_print")
    pairs = print_of.select(F.explode(decontam.keys(F.col("item_print"))).alias("key"), "item").join(print_of.select("item", F.explode(decontam.keys(F.col("item_print"), decontam.FLIPS)).alias("key")), ["item", "key"])
    assert pairs.count() <= 8 * items.count()


def test_repeated_ids_in_decontamination(spark):
    items = [" ".join(f"{c}{i}" for i in range(20)) for c in "pq"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame([(1, items[0]), (1, items[1]), (1, items[1]), (1, "clean words " * 9), (None, items[0] + " x " * 20), (None, "also clean " * 9), (2, None), (3, "far " * 60_000 + items[1])], "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0), r["item_id"], r["window_start"]) for r in decontam.matches(rows, bench).collect())
    assert found == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0), (3, 1, 60_000)]
    assert sorted((r["text"] or "")[:5] for r in decontam.remove_matched(rows, bench).collect()) == ["", "also ", "clean"]


def test_simhash(docs):
    def plain(text):
        w = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = simhash.components(docs).select("doc_id", simhash.hex_of(F.col("print")).alias("f"), "component_id").collect()
    prints = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    assert all(r["f"] == f"{prints[r['doc_id']]:016x}" for r in got)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[0] == comp[1] == comp[2] == 0 and comp[5] == comp[6] == comp[7] == 5 and comp[None] == 5
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))
    assert simhash.components(docs.where("false")).count() == 0


def test_tiles_and_components(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.r_[seeds, [s ^ np.uint64(1 << int(rng.integers(63))) ^ np.uint64(1 << int(rng.integers(63))) for s in np.repeat(seeds, 30)]])
    prints = prints[np.argsort(np.bitwise_count(prints), kind="stable")]
    root = list(range(len(prints)))
    def find(i):
        return i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    least = [find(i) for i in range(len(prints))]
    assert (simhash.tiled(prints, tile=64) == least).all()
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    groups = lambda of: {frozenset(v) for v in of.values()}
    for most in (simhash.MOST, 5):  # buckets of the second level lose no link
        found = {r["a"]: r["b"] for r in simhash.connected(simhash.links(df, most)).collect()}
        one, two = {}, {}
        for i, p in enumerate(prints.view(np.int64).tolist()):
            one.setdefault(least[i], []).append(p)
            two.setdefault(found.get(p, p), []).append(p)
        assert groups(one) == groups(two)


def test_split_buckets_keep_close_pairs():
    rng = random.Random(6)
    for n in range(simhash.BLOCKS):
        free = [b for b in range(64) if not simhash.WIDTH * n <= b < simhash.WIDTH * (n + 1)]
        for _ in range(20):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(free, 3):
                b ^= 1 << k
            keys, prints = simhash._split(n << simhash.WIDTH | 5, np.array([a, b], np.uint64))
            mine = [set(keys[prints.view(np.uint64) == np.uint64(x)].tolist()) for x in (a, b)]
            assert mine[0] & mine[1] and len(keys) == 8 and (keys >= 0).all()


def test_tiles_find_the_links(spark, monkeypatch):
    """Without the comparison of tiles there is no link, however small the table; buckets of any number of bits lose none."""
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(6)} | set(seeds))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    found = lambda: simhash.connected(simhash.links(df)).count()
    close = found()
    assert close >= len(prints) - 20
    for bits in (3, 9, 16):
        monkeypatch.setattr(simhash, "bits_for", lambda n, bits=bits: bits)
        assert found() == close
    monkeypatch.setattr(simhash, "tiled", lambda p: np.arange(len(p)))
    assert not len(simhash._links(np.zeros(3, np.int64), np.array([1, 2, 3], np.uint64))[0])


def test_bpe(docs, monkeypatch):
    from tokenizers import Tokenizer

    t, c, rng = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path()), random.Random(5)
    letters = "aab bcd'  \n\té中\U0001f600́\x1c\x85\xa0 ​İ12345 ''s're.,!?#$THEthe ing tion"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.97 else "<|endoftext|>" for _ in range(rng.randrange(60))) for _ in range(500)]
    for text, ids in zip(texts, c.encode_batch(texts), strict=True):
        own = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == own and c.decode(ids) == t.decode(own, skip_special_tokens=False)
    long = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 2, 63, 64, 65, 66, 2000)]
    monkeypatch.setattr(bpe, "REMEMBERED", 20)  # results move between the two dictionaries
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in c.encode_batch(long * 3)] == [t.encode(x).ids for x in long] * 3
    word = "thetionandtheir"
    assert c.merge(word.encode()) == t.encode(word).ids
    for r in bpe.digests(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.where("false")).count() == 0
