"""One query for each operator of this folder, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import bpe, chat, decontam, lm, phrases, quality, repeats, rollups, simhash, spelling, toxicity, urls, warc
from vexel.plans import storage
from vexel.plans.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("lang", "source")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), least=0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.learn_and_score(table(spark, sf_dir, "documents"))


def op5_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    odd = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.read_back(materialize(chat.transcripts(rows), "chat"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages")).drop("score")


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches: all documents under both tokenizer versions; German ones revised to the second version's counts under the first's name; those of fewer than 50 words deleted from the first; that batch once more. Three batches make a base, so the last comes on top of it."""
    docs = table(spark, sf_dir, "documents")
    counts = materialize(docs.select("source", "lang", *[rollups.count_tokens(F.col("text"), v).alias(f"n{k}") for k, v in enumerate(rollups.VERSIONS)]), "token-counts")
    one, two = rollups.VERSIONS
    event = lambda df, op, version, now, old=None: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), now.alias("tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"))
    german = F.col("lang").eqNullSafe(F.lit("de"))
    ledger = rollups.Ledger(spark, storage.new_path(spark, "ledger"), fold_after=3)
    ledger.commit(1, event(counts, "insert", one, F.col("n0")))
    ledger.commit(2, event(counts, "insert", two, F.col("n1")))
    ledger.commit(3, event(counts.where(german), "revise", one, F.col("n1"), F.col("n0")))
    short = event(counts.where("n0 < 50"), "delete", one, F.when(german, F.col("n1")).otherwise(F.col("n0")))
    ledger.commit(4, short)
    ledger.commit(4, short)
    return ledger.totals()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("print")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_warc_archive, op3_decontaminate, op4_lm_scores, op5_chat_examples, op6_url_filter, op7_token_rollups, op8_toxicity, op9_simhash_components, op10_bpe, op11_collocations, op12_repeated_bytes, op13_spelling_variants)}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, sha256(body) AS strong FROM p),
d AS (SELECT *, min(page_id) OVER (PARTITION BY strong) AS first FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ROLLUP_SQL = """
WITH n AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n0,
  len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')) AS n1 FROM documents)
SELECT source, lang, 'words-1' AS version, CAST(count(*) FILTER (n0 >= 50) AS BIGINT) AS docs,
  CAST(coalesce(sum(CASE WHEN lang = 'de' THEN n1 ELSE n0 END) FILTER (n0 >= 50), 0) AS BIGINT) AS tokens FROM n GROUP BY source, lang
UNION ALL SELECT source, lang, 'pieces-2', CAST(count(*) AS BIGINT), CAST(sum(n1) AS BIGINT) FROM n GROUP BY source, lang
"""


PHRASE_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS words FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, words, count(*) AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 30),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, words, f AS a FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.words, c.a, x.f AS l, y.f AS r, x.k AS cut, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM c, f AS x, f AS y WHERE x.lang = c.lang AND y.lang = c.lang AND x.k < c.k AND y.k = c.k - x.k AND x.words = list_slice(c.words, 1, x.k) AND y.words = list_slice(c.words, x.k + 1, c.k)),
b AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, unnest(list_concat(list_transform(range(1, k - 1 + 1), lambda i: list_slice(words, i, i + 1)), list_transform(range(1, k - 2 + 1), lambda i: list_slice(words, i, i + 2)))) AS words, k FROM c),
longer AS (SELECT lang, words, max(a) AS a FROM inner_ WHERE len(words) < k GROUP BY lang, words),
kept AS (SELECT b.* FROM b LEFT JOIN longer AS o ON o.lang = b.lang AND o.words = b.words WHERE o.a IS NULL OR 100 * o.a < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM (SELECT *, array_to_string(words, ' ') AS phrase FROM kept)) JOIN n USING (lang) WHERE rank <= 2000
"""


REPEAT_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
k AS (SELECT doc_id, t, CAST(octet_length(t) AS BIGINT) AS n FROM d),
b AS (SELECT doc_id, 2000 * j AS base, t[2000 * j + 1 : 2000 * j + 2099] AS piece FROM (SELECT doc_id, t, unnest(range(0, n // 2000 + 1)) AS j FROM k)),
w AS (SELECT doc_id, base + i AS start, piece[i + 1 : i + 100] AS s FROM (SELECT doc_id, base, piece, unnest(range(0, least(2000, octet_length(piece) - 99))) AS i FROM b)),
r AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM g) GROUP BY doc_id, run),
o AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS removed FROM s GROUP BY doc_id),
f AS (SELECT k.doc_id, hex(t) AS h, n, coalesce(a, []) AS a, coalesce(z, []) AS z, coalesce(removed, 0) AS removed FROM k LEFT JOIN o ON o.doc_id = k.doc_id)
SELECT doc_id, n AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(len(a) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(a) + 1), lambda i: h[2 * (CASE WHEN i = 0 THEN 0 ELSE z[i] END) + 1 : 2 * (CASE WHEN i = len(a) THEN n ELSE a[i + 1] END)]), ''))) AS kept_sha256 FROM f
"""

SPELLING_SQL = """
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS hex FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT doc_id, run, n, list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(hex) // 2), lambda i: [CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM u),
h AS (SELECT run, n, xor(list_reduce(steps, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h FROM b),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT x.word, y.word AS near, y.n AS m FROM d x JOIN d y USING (i, rest) WHERE x.word <> y.word UNION SELECT w.word, d.word, d.n FROM w JOIN d ON d.rest = w.word UNION SELECT d.word, w.word, w.n FROM w JOIN d ON d.rest = w.word),
t AS (SELECT word, count(*) AS n_near, max(m) AS m, first(near ORDER BY m DESC, near) AS near FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN t USING (word)),
g AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g ON g.word = f.word AND g.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_archive": WARC_SQL, "op5_chat_examples": CHAT_SQL, "op7_token_rollups": ROLLUP_SQL, "op11_collocations": PHRASE_SQL, "op12_repeated_bytes": REPEAT_SQL, "op13_spelling_variants": SPELLING_SQL}
