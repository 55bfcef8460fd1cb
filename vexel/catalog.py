"""The library's queries over the table of embeddings, by name, and the SQL of those that SQL can express.

Queries are the rows whose id is divisible by 100, against all rows. Distances are rounded to six places, so that engines that add
in another order agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import distance as D
from vexel.operators import binary, bulk, cluster, coarse, evaluate, flat, graph, ivf, meta, quantizers, transforms, tree
from vexel.plans import factory
from vexel.plans.storage import materialize, new_path
from vexel.streaming.window import tumbling_counts

K, NLIST, EVERY = 10, 8, 100
PLACES = 6


def base(spark: SparkSession, sf_dir: str, positive: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return rows.withColumn("vec", F.transform("vec", lambda x: x + 1)) if positive else rows


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vec")


def _round(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round(F.col("distance").cast("double"), PLACES))


def _knn(metric: str, positive: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base(spark, sf_dir, positive)
        return _round(flat.knn(rows, asked(rows), K, metric))

    return query


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ivf.IvfIndex]:
    """Lists around the rows i * floor(n / 8), as they are."""
    rows = base(spark, sf_dir)
    return rows, ivf.IvfIndex.build(rows, NLIST, rounds=0, init=cluster.bucket_start(rows, NLIST), sample=False)


def knn_columns(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(flat.knn_columns(rows, asked(rows), K))


def knn_filtered(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(flat.knn(rows, asked(rows), K, where=(F.col("label") == 3) & meta.id_range(50, 10_000_000)))


def range_l2(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(flat.range_search(rows, asked(rows), 1.5))


def range_ip(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(flat.range_search(rows, asked(rows), 0.25, "ip"))


def assign(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    return index.lists.select("id", "list_no")


def distance_subset(spark, sf_dir):
    rows = base(spark, sf_dir)
    wanted = asked(rows).select("query_id").join(rows.where("label = 1").select("id"))
    return _round(flat.distance_subset(rows, asked(rows), wanted))


def residuals(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    out = flat.residual(index.lists, cluster_table(spark, index))
    return out.select("id", F.round(D.ip(F.col("vec"), F.col("vec")), PLACES).alias("norm2"))


def cluster_table(spark, index):
    return index._centres(spark).select(F.col("id").cast("int").alias("list_no"), "vec")


def nearest_1d(spark, sf_dir):
    rows = base(spark, sf_dir).select("id", F.get("vec", F.lit(0)).alias("value"))
    return _round(flat.nearest_1d(rows, rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "value"), K))


def _words(rows: DataFrame) -> DataFrame:
    return rows.select("id", D.sign_bits(F.col("vec")).alias("word"))


def _word_queries(words: DataFrame) -> DataFrame:
    return words.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "word")


def binary_knn(spark, sf_dir):
    words = _words(base(spark, sf_dir))
    return binary.knn(words, _word_queries(words), K)


def binary_range(spark, sf_dir):
    words = _words(base(spark, sf_dir))
    return binary.range_search(words, _word_queries(words), 24)


def binary_hash(spark, sf_dir):
    words = _words(base(spark, sf_dir))
    return binary.hash_search(words, _word_queries(words), K, bits=8, nflip=1, tables=2)


def scalar_codes(spark, sf_dir):
    rows = base(spark, sf_dir)
    return quantizers.scalar_codes(rows, quantizers.scalar_ranges(rows)).select("id", F.aggregate("code", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


def row_minmax(spark, sf_dir):
    return base(spark, sf_dir).select("id", quantizers.row_minmax(F.col("vec")).alias("p")).select("id", F.round("p.scale", PLACES).alias("scale"), F.round("p.least", PLACES).alias("least"), F.round(D.total(F.col("p.vec")), PLACES).alias("total"))


def ivf_search(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    return _round(index.search(asked(rows), K, nprobe=3))


def ivf_max_codes(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    return _round(index.search(asked(rows), K, nprobe=4, max_codes=100))


def ivf_range(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    return _round(index.range_search(asked(rows), 1.6, nprobe=3))


def ivf_list_sizes(spark, sf_dir):
    return _index(spark, sf_dir)[1].list_sizes()


def ivf_upkeep(spark, sf_dir):
    """Every seventh row removed, then added again with a shifted id; element range by lists."""
    rows, index = _index(spark, sf_dir)
    some = rows.where("id % 7 = 0").select("id", "vec")
    return index.remove(some).add(some.withColumn("id", F.col("id") + 1_000_000)).subset("id_range", 100, 2_000_000).lists.select("list_no", "id")


def ivf_dedup(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    doubled = index.add(rows.where("id % 7 = 0").select((F.col("id") + 1_000_000).alias("id"), "vec"))
    stored = ivf.dedup_lists(doubled.lists)
    found = ivf.IvfIndex(index.centroids, stored).search(asked(rows), K, nprobe=3)
    return _round(ivf.expand(found, stored, K))


def find_duplicates(spark, sf_dir):
    rows = base(spark, sf_dir)
    words = _words(rows).withColumn("list_no", F.lit(0)).withColumn("code", F.col("word").bitwiseAND(0xFFF))
    return ivf.find_duplicates(words).select(F.get("ids", F.lit(0)).alias("first"), F.size("ids").cast("long").alias("n"))


def list_tools(spark, sf_dir):
    """Lists masked by others, large ones dropped, and stacked with themselves."""
    _, index = _index(spark, sf_dir)
    low, rest = index.lists.where("list_no < 4"), index.lists.where("list_no >= 2")
    return ivf.stack([(ivf.without_stop_lists(ivf.masked(low, rest), 100), NLIST), (low, NLIST)]).groupBy("list_no").agg(F.count("*").alias("n"))


def sliding(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("slice_no", F.floor(F.col("id") / 100))
    return ivf.slide(rows, 2).groupBy("slice_no").agg(F.count("*").alias("n"))


def sharded(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(meta.sharded_knn([rows.where(F.col("id") % 4 == s) for s in range(4)], asked(rows), K))


def split_vectors(spark, sf_dir):
    rows = base(spark, sf_dir)
    n = rows.count()
    halves = [(rows.select("id", F.slice("vec", 1 + 32 * s, 32).alias("vec")), n) for s in range(2)]
    return _round(meta.split_vectors_nearest(halves, asked(rows), [32, 32]))


def kmeans_step(spark, sf_dir):
    _, index = _index(spark, sf_dir)
    return cluster.compute_centroids(index.lists).select("list_no", "pos", F.round("mean", PLACES).alias("mean"))


def kmeans_arrow_step(spark, sf_dir):
    """The same means from a pass of partial sums."""
    rows, index = _index(spark, sf_dir)
    sums, sizes, _ = cluster.step(rows.select("vec", F.lit(1.0).alias("weight")), index.centroids)
    table = [(i, j, float(sums[i, j] / sizes[i])) for i in range(NLIST) if sizes[i] for j in range(sums.shape[1])]
    return spark.createDataFrame(table, "list_no int, pos int, mean double").withColumn("mean", F.round("mean", PLACES))


def imbalance(spark, sf_dir):
    return cluster.imbalance_factor(_index(spark, sf_dir)[1].lists, NLIST).select(F.round("imbalance", PLACES).alias("imbalance"))


def centered(spark, sf_dir):
    return transforms.center(base(spark, sf_dir)).select("id", F.round(D.ip(F.col("vec"), F.col("vec")), PLACES).alias("norm2"))


def normalized(spark, sf_dir):
    return transforms.normalize(base(spark, sf_dir, True)).select("id", F.round(D.total(F.col("vec")), PLACES).alias("total"))


def matrix_stats(spark, sf_dir):
    s = evaluate.matrix_stats(base(spark, sf_dir))
    return s.select("pos", *[F.round(c, PLACES).alias(c) for c in ("min", "max", "mean", "std")], "n_nan", "n_inf", "n")


def _evaluated(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    return materialize(index.search(asked(rows), K, nprobe=2), "found"), materialize(flat.knn(rows, asked(rows), K), "truth")


def evaluation(spark, sf_dir):
    found, truth = _evaluated(spark, sf_dir)
    pr = evaluate.precision_recall(found, truth)
    both = evaluate.intersection_at(found, truth, K).crossJoin(evaluate.recall_at(found, truth, 1)).crossJoin(pr.withColumnRenamed("recall", "pair_recall"))  # one row each
    return both.select(*[F.round(c, PLACES).alias(c) for c in ("overlap", "recall", "precision", "pair_recall")])


def operating_points(spark, sf_dir):
    """Labels as points: mean first coordinate as accuracy, size as time."""
    points = base(spark, sf_dir, True).groupBy("label").agg(F.avg(F.get("vec", F.lit(0))).alias("perf"), F.count("*").cast("double").alias("t")).withColumn("key", F.col("label").cast("string"))
    return evaluate.frontier(points.select(F.round("perf", PLACES).alias("perf"), "t", "key"))


def max_results(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(evaluate.radius_for(flat.nearest_pairs(rows, asked(rows), 51, 4.0), 50))


def binary_ivf(spark, sf_dir):
    """Words in lists around the words of the rows i * floor(n / 8), three probed."""
    rows, index = _index(spark, sf_dir)
    centres = [r["word"] for r in cluster_table(spark, index).select("list_no", D.sign_bits(F.col("vec")).alias("word")).orderBy("list_no").collect()]
    words = _words(rows)
    return binary.WordLists.build(words, centres).search(_word_queries(words), K, nprobe=3)


def binary_counts(spark, sf_dir):
    words = _words(base(spark, sf_dir))
    return binary.count_within(words, _word_queries(words), 28)


def lsh_medians(spark, sf_dir):
    rows = base(spark, sf_dir)
    words = binary.lsh_words(rows, materialize(binary.medians(rows), "medians"))
    return binary.knn(words, _word_queries(words), K)


def ivf_spectral(spark, sf_dir):
    rows, index = _index(spark, sf_dir)
    return binary.spectral_search(index.lists, cluster_table(spark, index), asked(rows), index.probes(asked(rows), 3), K, 0.5)


def ivf_reconstruct(spark, sf_dir):
    """Every fiftieth row read back from its list; ids that aren't stored give nothing."""
    rows, index = _index(spark, sf_dir)
    ids = rows.where("id % 50 = 0").select("id").union(rows.select(F.col("id") + 1_000_000))
    return index.reconstruct(ids).select("list_no", "id", F.round(D.ip(F.col("vec"), F.col("vec")), PLACES).alias("norm2"))


def id_map(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(meta.translate(flat.knn(rows, asked(rows), K), rows.select("id", (F.col("id") * 10 + 7).alias("user_id"))))


def knn_selectors(spark, sf_dir):
    rows = base(spark, sf_dir)
    return _round(flat.knn(rows, asked(rows), K, where=meta.xor(meta.id_range(20, 150), F.col("label") == 1) & ~meta.id_set([30, 31, 32])))


def event_windows(spark, sf_dir):
    return tumbling_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _built(text: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base(spark, sf_dir)
        return _round(factory.build(text, rows).search(asked(rows), K, **options))

    return query


def _multi(spark, sf_dir) -> tuple[DataFrame, ivf.IvfIndex]:
    """A multi-index of 16 x 16 lists; its books are the halves of the rows i * floor(n / 16)."""
    rows = base(spark, sf_dir).select("id", "vec")
    start = cluster.bucket_start(rows, 16)
    return rows, ivf.IvfIndex.around(coarse.MultiIndex([start[:, :32], start[:, 32:]], 4), rows)


def imi_cells(spark, sf_dir):
    """The 24 nearest of 256 lists of each query, in order."""
    rows, index = _multi(spark, sf_dir)
    return index.probes(asked(rows), 24)


def imi_search(spark, sf_dir):
    rows, index = _multi(spark, sf_dir)
    return _round(index.search(asked(rows), K, nprobe=64))


def bulk_search(spark, sf_dir):
    """ivf_search, a range of some hundred rows' lists at a time, each kept in a folder."""
    rows, index = _index(spark, sf_dir)
    return _round(bulk.search(index, asked(rows), K, 3, new_path(spark, "bulk"), rows=300))


def balanced_tree(spark, sf_dir):
    """Search of the leaves of a balanced tree, three quarters of them probed."""
    rows = base(spark, sf_dir).select("id", "vec")
    index = tree.Tree.build(rows, 6, 80).index()
    return _round(index.search(asked(rows), K, nprobe=-(-3 * index.coarse.size // 4)))


def growing_kmeans(spark, sf_dir):
    """Rows in each list of k-means in ever more dimensions."""
    rows = base(spark, sf_dir).select("id", "vec")
    return cluster.growing_dimensions(rows, NLIST).assign(rows).groupBy("list_no").agg(F.count("*").alias("n"))


def _wide(rows: DataFrame) -> DataFrame:
    """Codes of 128 bits: whether coordinates are at least 0, and at least 0.1."""
    eight = lambda a, least: F.expr(f"aggregate(sequence(0, 7), 0, (s, i) -> s + IF(vec[{a} + i] >= {least}, shiftleft(1, i), 0))")
    byte = lambda a, least: F.unhex(F.lpad(F.hex(eight(a, least)), 2, "0"))
    return rows.select("id", F.concat(*[byte(a, least) for least in (0.0, 0.1) for a in range(0, 64, 8)]).alias("code"))


def _binary(text: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        codes = materialize(_wide(base(spark, sf_dir)), "codes")
        return factory.build(text, codes).search(codes.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), K, **options)

    return query


def foreign(rows: DataFrame) -> DataFrame:
    """Queries from another distribution than the rows: every hundredth vector backwards, longer and shifted."""
    return asked(rows).withColumn("vec", F.transform(F.reverse("vec"), lambda v: 1.5 * v + 0.05))


def two_level_graph(spark, sf_dir):
    """A walk of layer 0 from the four nearest of a shard's representatives of second-level centroids."""
    rows = base(spark, sf_dir).select("id", "vec")
    doors = cluster.two_level(rows, 8, 64)[1].select(F.col("rep_id").alias("id"))
    return _round(graph.GraphIndex.build(rows, entries=doors).search(foreign(rows), K, ef=32, start="entries", nprobe=4))


def graph_layers(spark, sf_dir):
    """How many rows each layer of a graph holds."""
    rows = base(spark, sf_dir).select("id", "vec")
    return graph.GraphIndex.build(rows).layers().groupBy("layer").agg(F.countDistinct("src").alias("n"))


def graph_removed(spark, sf_dir):
    """A search after a third of the rows is gone and those that were linked to them are linked again."""
    rows = base(spark, sf_dir).select("id", "vec")
    return _round(graph.GraphIndex.build(rows).remove(rows.where("id % 3 = 1")).search(asked(rows), K))


def nsg_reachable(spark, sf_dir):
    """Rows of a navigating graph, and those that a walk along links reaches from the navigating rows."""
    nodes = graph.GraphIndex.build(base(spark, sf_dir).select("id", "vec"), kind="nsg")
    reached = graph.reachable(nodes.edges(), nodes.nodes.where("entry").select("id"))
    return nodes.nodes.agg(F.count("*").alias("nodes")).crossJoin(reached.agg(F.count("*").alias("reached")))  # a row each


def code_bytes(spark, sf_dir):
    """Bytes of each stored code and how many there are."""
    rows, out = base(spark, sf_dir).select("id", "vec"), None
    for text in CODES:
        stored = factory.build(text, rows).codes.groupBy(F.octet_length("code").cast("long").alias("bytes")).agg(F.count("*").alias("n"))
        one = stored.select(F.lit(text).alias("code"), "bytes", "n")
        out = one if out is None else out.union(one)
    return out


#: Strings and the bytes of a code of 64 dimensions.
CODES = {"PQ8x4": 4, "PQ16x5np": 10, "SQ4": 32, "SQ6": 48, "SQ8": 64, "SQfp16": 128, "RQ3x4_2x5": 3, "RQ4x4_Nqint8": 3, "LSQ3x4_Nfloat": 6, "PRQ2x3x4": 3, "MinMaxFP16,SQ4": 36}


def nn_descent(spark, sf_dir):
    return _round(graph.nn_descent(base(spark, sf_dir), 8))


def nsg_neighbors(spark, sf_dir):
    rows = base(spark, sf_dir).select("id", "vec")
    return graph.nsg_prune(graph.knn_graph(rows, 12), rows, 6)


def two_level(spark, sf_dir):
    return cluster.two_level(base(spark, sf_dir), 5, 20)[1].select("list_no", "sub_no", "rep_id")


PLAIN = {
    "knn_l2": _knn("l2"), "knn_ip": _knn("ip"), "knn_l1": _knn("l1"), "knn_linf": _knn("linf"), "knn_cosine": _knn("cosine"), "knn_lp": _knn("lp"), "knn_canberra": _knn("canberra"),
    "knn_braycurtis": _knn("braycurtis", True), "knn_jensenshannon": _knn("jensenshannon", True), "knn_jaccard": _knn("jaccard", True),
    "binary_flat_128": _binary("BFlat"), "binary_hash_128": _binary("BHash4x8", nflip=1), "binary_lists_128": _binary("BIVF16", nprobe=13), "binary_lists_graph_128": _binary("BIVF16_HNSW4", nprobe=13), "binary_graph_128": _binary("BHNSW12"),
    "index_graph": _built("HNSW12,Flat"), "index_graph_sq8": _built("HNSW12,SQ8"), "index_graph_two_layers": _built("HNSW12,2x4+PQ32,RFlat"), "index_nsg": _built("NSG12,Flat"), "index_pq": _built("PQ32x8np,RFlat"), "index_pq_polysemous": _built("PQ32x3,RFlat", ht=47, k_factor=20), "index_rq_refine": _built("RQ8x6,RFlat", k_factor=10), "index_rq_norms": _built("RQ8x6_Nqint8,RFlat", k_factor=10), "index_lsq": _built("LSQ8x6_Ncqint8,RFlat", k_factor=10), "index_prq": _built("PRQ4x4x4,RFlat", k_factor=20),
    "index_opq": _built("OPQ16,PQ16x8np,RFlat", k_factor=15), "index_pca_ivf": _built("PCA48,IVF32,Flat,RFlat", nprobe=24, k_factor=10), "index_itq": _built("ITQ,Flat"), "index_imi": _built("IMI2x4,Flat", nprobe=160), "index_residual_coarse": _built("IVF16(RCQ2x2),Flat", nprobe=10), "index_ivf_hnsw": _built("IVF32_HNSW8,SQ8", nprobe=24),
    "index_ivf_sq8": _built("IVF32,SQ8", nprobe=24), "index_ivf_pq": _built("IVF32,PQ64x8np", nprobe=26), "index_ivf_pq_refined": _built("IVF32,PQ16x8np,RFlat", nprobe=24, k_factor=8), "index_ivf_pqr": _built("IVF32,PQ32+32", nprobe=24, k_factor=8), "index_ivf_rq": _built("IVF32,RQ8x6_Nqint8,RFlat", nprobe=24, k_factor=20), "index_sq8": _built("SQ8"), "index_minmax": _built("MinMax,SQ8"), "index_pad": _built("Pad80,Flat"), "index_refine_codes": _built("PQ16x4,Refine(SQ8)", k_factor=20),
}
NAMED = (bulk_search, balanced_tree, growing_kmeans, imi_cells, imi_search, two_level_graph, graph_layers, graph_removed, nsg_reachable, code_bytes, binary_ivf, binary_counts, lsh_medians, ivf_spectral, ivf_reconstruct, id_map, knn_selectors, knn_columns, knn_filtered, range_l2, range_ip, assign, distance_subset, residuals, nearest_1d, binary_knn, binary_range, binary_hash, scalar_codes, row_minmax, ivf_search, ivf_max_codes, ivf_range, ivf_list_sizes, ivf_upkeep, ivf_dedup, find_duplicates, list_tools, sliding, sharded, split_vectors, kmeans_step, kmeans_arrow_step, imbalance, centered, normalized, matrix_stats, evaluation, operating_points, max_results, event_windows, nn_descent, nsg_neighbors, two_level)


def queries() -> dict:
    return PLAIN | {f.__name__: f for f in NAMED}


def _sum(of: str) -> str:
    """SQL sum over coordinates x = t[1] of the query and y = t[2] of the row."""
    return f"list_sum(list_transform(list_zip(w, v), lambda t: {of.replace('x', 't[1]').replace('y', 't[2]')}))"


SQL = {
    "l2": _sum("(x - y) * (x - y)"), "ip": _sum("x * y"), "l1": _sum("abs(x - y)"), "linf": "list_max(list_transform(list_zip(w, v), lambda t: abs(t[1] - t[2])))",
    "cosine": f"{_sum('x * y')} / (sqrt({_sum('x * x')}) * sqrt({_sum('y * y')}))", "lp": _sum("pow(abs(x - y), 3)"), "canberra": _sum("abs(x - y) / (abs(x) + abs(y))"),
    "braycurtis": f"{_sum('abs(x - y)')} / {_sum('abs(x + y)')}", "jensenshannon": _sum("-0.5 * (x * ln((x + y) / 2 / x) + y * ln((x + y) / 2 / y))"),
    "jaccard": f"{_sum('least(x, y)')} / {_sum('greatest(x, y)')}",
}


def _tables(positive: bool = False) -> str:
    vec = "list_transform(embedding, lambda e: e::DOUBLE + 1)" if positive else "list_transform(embedding, lambda e: e::DOUBLE)"
    return f"""WITH b AS (SELECT vec_id AS id, {vec} AS v, label FROM embeddings), q AS (SELECT id AS query_id, v AS w FROM b WHERE id % {EVERY} = 0)"""


def _top(pairs: str, descending: bool = False, k: int = K) -> str:
    return f"SELECT query_id, id, round(distance, {PLACES}) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {'DESC' if descending else 'ASC'}, id) AS rank FROM ({pairs})) WHERE rank <= {k}"


def _sql_knn(metric: str, positive: bool = False, where: str = "true") -> str:
    return f"{_tables(positive)} {_top(f'SELECT query_id, id, {SQL[metric]} AS distance FROM b, q WHERE {where}', metric in D.SIMILARITIES)}"


BITS = "(SELECT id, list_transform(v, lambda e: CASE WHEN e >= 0 THEN 1 ELSE 0 END) AS s FROM b)"
HAMMING = "list_sum(list_transform(list_zip(x.s, y.s), lambda t: abs(t[1] - t[2])))"
LISTS = f""", n AS (SELECT count(*) AS n FROM b), r AS (SELECT v, row_number() OVER (ORDER BY id) - 1 AS r FROM b),
c AS (SELECT CAST(r // (n // {NLIST}) AS INT) AS list_no, v AS w FROM r, n WHERE r % (n // {NLIST}) = 0 AND r < {NLIST} * (n // {NLIST})),
l AS (SELECT id, v, list_no FROM (SELECT id, v, list_no, row_number() OVER (PARTITION BY id ORDER BY {SQL['l2']}, list_no) AS k FROM b, c) WHERE k = 1),
p AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY d, list_no) AS probe FROM (SELECT query_id, list_no, {SQL['l2'].replace('list_zip(w, v)', 'list_zip(q.w, c.w)')} AS d FROM q, c))"""
SCAN = f"SELECT query_id, id, {SQL['l2']} AS distance FROM l JOIN p USING (list_no) JOIN q USING (query_id)"


def oracle_sql() -> dict[str, str]:
    b, bl = _tables(), _tables() + LISTS
    sql = {f"knn_{m}": _sql_knn(m, m in ("braycurtis", "jensenshannon", "jaccard")) for m in SQL}
    sql["knn_columns"] = sql["sharded"] = sql["knn_l2"]
    sql["knn_filtered"] = _sql_knn("l2", where="label = 3 AND id >= 50 AND id < 10000000")
    pair = "SELECT query_id, id, round({0}, 6) AS distance FROM b, q WHERE {1}"
    sql["range_l2"] = f"{b} {pair.format(SQL['l2'], SQL['l2'] + ' < 1.5')}"
    sql["range_ip"] = f"{b} {pair.format(SQL['ip'], SQL['ip'] + ' > 0.25')}"
    sql["distance_subset"] = f"{b} {pair.format(SQL['l2'], 'label = 1')}"
    sql["nearest_1d"] = f"{b} {_top('SELECT query_id, id, abs(w[1] - v[1]) AS distance FROM b, q')}"
    sql["assign"] = f"{bl} SELECT id, list_no FROM l"
    sql["residuals"] = f"{bl} SELECT id, round({SQL['l2']}, 6) AS norm2 FROM l JOIN c USING (list_no)"
    bits = f"SELECT y.id AS query_id, x.id, CAST({HAMMING} AS INT) AS distance FROM {BITS} x, {BITS} y WHERE y.id % {EVERY} = 0"
    sql["binary_knn"] = f"{b} {_top(bits)}".replace("round(distance, 6)", "distance")
    sql["binary_range"] = f"{b} SELECT * FROM ({bits}) WHERE distance < 24"
    near = "list_sum(list_transform(list_zip(x.s[{0}:{1}], y.s[{0}:{1}]), lambda t: abs(t[1] - t[2]))) <= 1"
    sql["binary_hash"] = f"{b} {_top(bits + ' AND (' + near.format(1, 8) + ' OR ' + near.format(9, 16) + ')')}".replace("round(distance, 6)", "distance")
    wide = "(SELECT id, list_concat(list_transform(v, lambda e: CASE WHEN e >= 0 THEN 1 ELSE 0 END), list_transform(v, lambda e: CASE WHEN e >= 0.1 THEN 1 ELSE 0 END)) AS s FROM b)"
    sql["binary_flat_128"] = f"{b} {_top(bits.replace(BITS, wide))}".replace("round(distance, 6)", "distance")
    keyed = " OR ".join(near.format(8 * t + 1, 8 * t + 8) for t in range(4))
    sql["binary_hash_128"] = f"{b} {_top(f'{bits.replace(BITS, wide)} AND ({keyed})')}".replace("round(distance, 6)", "distance")
    sql["binary_counts"] = f"{b} SELECT query_id, count(*) AS n FROM ({bits}) WHERE distance < 28 GROUP BY query_id"
    words = f"{bl}, s AS {BITS}, cs AS (SELECT list_no, list_transform(w, lambda e: CASE WHEN e >= 0 THEN 1 ELSE 0 END) AS s FROM c), near AS (SELECT id, list_no, row_number() OVER (PARTITION BY id ORDER BY {HAMMING}, list_no) AS k FROM s x, cs y)"
    sql["binary_ivf"] = f"{words} {_top(bits + ' AND EXISTS (SELECT 1 FROM near m JOIN near o USING (list_no) WHERE m.id = x.id AND m.k = 1 AND o.id = y.id AND o.k <= 3)')}".replace("round(distance, 6)", "distance")
    above = "(SELECT id, list_transform(list_zip(v, m), lambda t: CASE WHEN t[1] >= t[2] THEN 1 ELSE 0 END) AS s FROM b, m)"
    middle = "m AS (SELECT list(t ORDER BY p) AS m FROM (SELECT p, quantile_disc(e, 0.5) AS t FROM (SELECT unnest(range(0, 64)) AS p, unnest(v) AS e FROM b) GROUP BY p))"
    sql["lsh_medians"] = f"{b}, {middle} {_top(bits.replace(BITS, above))}".replace("round(distance, 6)", "distance")
    code = "list_transform(list_zip({0}, c.w), lambda t: abs(floor((t[1] - t[2]) * 2.0 / 0.5) % 2))"
    sql["ivf_spectral"] = f"""{bl}, x AS (SELECT list_no, id, {code.format('l.v')} AS s FROM l JOIN c USING (list_no)), y AS (SELECT list_no, query_id, {code.format('q.w')} AS s FROM p JOIN q USING (query_id) JOIN c USING (list_no) WHERE probe <= 3)
{_top(f'SELECT query_id, id, CAST({HAMMING} AS INT) AS distance FROM x JOIN y USING (list_no)')}""".replace("round(distance, 6)", "distance")
    sql["ivf_reconstruct"] = f"{bl} SELECT list_no, id, round(list_sum(list_transform(v, lambda e: e * e)), 6) AS norm2 FROM l WHERE id % 50 = 0"
    sql["id_map"] = f"SELECT query_id, id * 10 + 7 AS id, distance, rank FROM ({sql['knn_l2']})"
    sql["knn_selectors"] = _sql_knn("l2", where="((id >= 20 AND id < 150) <> (label = 1)) AND id NOT IN (30, 31, 32)")
    sql["scalar_codes"] = f"""{b}, x AS (SELECT id, unnest(range(1, 65)) AS p, unnest(v) AS e FROM b), s AS (SELECT p, min(e) AS a, max(e) AS z FROM x GROUP BY p)
SELECT id, CAST(sum(CASE WHEN z > a THEN floor(least(1.0, greatest(0.0, (e - a) / (z - a))) * 255) ELSE 0 END) AS BIGINT) AS total FROM x JOIN s USING (p) GROUP BY id"""
    sql["row_minmax"] = f"""{b}, m AS (SELECT id, v, list_min(v) AS a, list_max(v) AS z FROM b)
SELECT id, round(z - a, 6) AS scale, round(a, 6) AS least, round(list_sum(list_transform(v, lambda e: CASE WHEN z > a THEN (e - a) / (z - a) ELSE 0 END)), 6) AS total FROM m"""
    sql["ivf_search"] = f"{bl} {_top(SCAN + ' WHERE probe <= 3')}"
    before = "(SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN (SELECT list_no, count(*) AS n FROM l GROUP BY list_no) USING (list_no) WHERE probe <= 4)"
    sql["bulk_search"] = sql["ivf_search"]
    sql["ivf_max_codes"] = f"{bl} {_top(SCAN.replace('JOIN p', f'JOIN {before} p') + ' WHERE before < 100')}"
    sql["ivf_range"] = f"{bl} SELECT query_id, id, round(distance, 6) AS distance FROM ({SCAN} WHERE probe <= 3) WHERE distance < 1.6"
    sql["ivf_list_sizes"] = f"{bl} SELECT list_no, count(*) AS n FROM l GROUP BY list_no"
    sql["ivf_upkeep"] = f"{bl} SELECT list_no, CASE WHEN id % 7 = 0 THEN id + 1000000 ELSE id END AS id FROM l WHERE id >= 100 OR id % 7 = 0"
    doubled = "(SELECT id, v, list_no FROM l UNION ALL SELECT id + 1000000, v, list_no FROM l WHERE id % 7 = 0)"
    sql["ivf_dedup"] = f"{bl} {_top(SCAN.replace('FROM l JOIN', f'FROM {doubled} l JOIN') + ' WHERE probe <= 3')}"
    sql["find_duplicates"] = f"{b} SELECT min(id) AS first, count(*) AS n FROM {BITS} GROUP BY s[1:12] HAVING count(*) > 1"
    sql["list_tools"] = f"""{bl}, m AS (SELECT list_no, count(*) AS n FROM l GROUP BY list_no)
SELECT list_no, n FROM m WHERE n < 100 UNION ALL SELECT CAST(list_no + {NLIST} AS INT), n FROM m WHERE list_no < 4"""
    sql["sliding"] = f"{b} SELECT CAST(id // 100 AS BIGINT) AS slice_no, count(*) AS n FROM b WHERE id // 100 > (SELECT max(id // 100) - 2 FROM b) GROUP BY 1"
    half = "SELECT query_id, id, list_sum(list_transform(list_zip(w[{0}:{1}], v[{0}:{1}]), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM b, q"
    one = lambda h: f"(SELECT query_id, id, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS k FROM ({h})) WHERE k = 1)"
    sql["split_vectors"] = f"{b} SELECT query_id, CAST(x.id + y.id * (SELECT count(*) FROM b) AS BIGINT) AS id, round(x.d + y.d, 6) AS distance FROM {one(half.format(1, 32))} x JOIN {one(half.format(33, 64))} y USING (query_id)"
    sql["kmeans_step"] = sql["kmeans_arrow_step"] = f"{bl}, u AS (SELECT list_no, unnest(range(0, 64)) AS pos, unnest(v) AS e FROM l) SELECT list_no, CAST(pos AS INT) AS pos, round(avg(e), 6) AS mean FROM u GROUP BY list_no, pos"
    sql["imbalance"] = f"{bl} SELECT round({NLIST} * sum(n * n) / (sum(n) * sum(n)), 6) AS imbalance FROM (SELECT count(*)::DOUBLE AS n FROM l GROUP BY list_no)"
    sql["centered"] = f"{b}, u AS (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS e FROM b), m AS (SELECT pos, avg(e) AS a FROM u GROUP BY pos) SELECT id, round(sum((e - a) * (e - a)), 6) AS norm2 FROM u JOIN m USING (pos) GROUP BY id"
    sql["normalized"] = f"{_tables(True)} SELECT id, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda e: e * e))), 6) AS total FROM b"
    sql["matrix_stats"] = f"""{b}, u AS (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS e FROM b) SELECT CAST(pos AS INT) AS pos, round(min(e), 6) AS min, round(max(e), 6) AS max, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std,
CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) AS n FROM u GROUP BY pos"""
    found, truth = _top(SCAN + " WHERE probe <= 2"), _top(f"SELECT query_id, id, {SQL['l2']} AS distance FROM b, q")
    sql["evaluation"] = f"""{bl}, f AS ({found}), t AS ({truth}), h AS (SELECT count(*)::DOUBLE AS h FROM f JOIN t USING (query_id, id)), s AS (SELECT count(DISTINCT query_id) AS q, count(*) AS nt FROM t)
SELECT round(h / (q * {K}), 6) AS overlap, round((SELECT count(*) FROM f JOIN t USING (query_id, id) WHERE f.rank = 1 AND t.rank = 1) / q, 6) AS recall, round(h / (SELECT count(*) FROM f), 6) AS precision, round(h / nt, 6) AS pair_recall FROM h, s"""
    sql["operating_points"] = f"{_tables(True)}, m AS (SELECT round(avg(v[1]), 6) AS perf, count(*)::DOUBLE AS t, CAST(label AS VARCHAR) AS key FROM b GROUP BY label) SELECT * FROM m WHERE perf > 0 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.t <= m.t AND (o.perf > m.perf OR (o.perf = m.perf AND (o.t < m.t OR o.key < m.key))))"
    sql["max_results"] = f"{b}, d AS (SELECT query_id, id, {SQL['l2']} AS distance FROM b, q), e AS (SELECT * FROM d WHERE distance < 4.0 ORDER BY distance LIMIT 51) SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance < (SELECT max(distance) FROM e)"
    half = lambda part: _sum("(x - y) * (x - y)").replace("list_zip(w, v)", f"list_zip(w[{32 * part + 1}:{32 * part + 32}], v[{32 * part + 1}:{32 * part + 32}])")
    books = f"""{b}, n AS (SELECT count(*) AS n FROM b), r AS (SELECT v, row_number() OVER (ORDER BY id) - 1 AS r FROM b), c AS (SELECT r // (n // 16) AS t, v AS w FROM r, n WHERE r % (n // 16) = 0 AND r < 16 * (n // 16)),
o AS (SELECT id, v, min_by(t, {half(0)}) AS t0, min_by(t, {half(1)}) AS t1 FROM b, c GROUP BY id, v), l AS (SELECT id, v, CAST(t0 + 16 * t1 AS INT) AS list_no FROM o),
h AS (SELECT query_id, t, {half(0).replace('(w[', '(q.w[').replace('v[', 'c.w[')} AS d0, {half(1).replace('(w[', '(q.w[').replace('v[', 'c.w[')} AS d1 FROM q, c),
p AS (SELECT x.query_id, CAST(x.t + 16 * y.t AS INT) AS list_no, CAST(row_number() OVER (PARTITION BY x.query_id ORDER BY x.d0 + y.d1, x.t + 16 * y.t) AS INT) AS probe_rank FROM h x JOIN h y USING (query_id))"""
    sql["imi_cells"] = f"{books} SELECT query_id, probe_rank, list_no FROM p WHERE probe_rank <= 24"
    sql["imi_search"] = f"{books} {_top(SCAN + ' WHERE probe_rank <= 64')}"
    sql["nsg_reachable"] = "SELECT count(*) AS nodes, count(*) AS reached FROM embeddings"
    sql["code_bytes"] = " UNION ALL ".join(f"SELECT '{code}' AS code, CAST({size} AS BIGINT) AS bytes, count(*) AS n FROM embeddings" for code, size in CODES.items())
    low, word = "18446744073709551616::UHUGEINT", lambda x: f"CAST({x} AS UBIGINT)"
    mix = lambda h, shift, times: word(f"(xor({h}, {h} >> {shift})::UHUGEINT * {times}::UHUGEINT) % {low}")
    sql["graph_layers"] = f"""WITH a AS (SELECT vec_id, {word(f'(vec_id::UHUGEINT + 11400714819323198485::UHUGEINT) % {low}')} AS h FROM embeddings), d AS (SELECT vec_id, {mix('h', 30, 13787848793156543929)} AS h FROM a), e AS (SELECT vec_id, {mix('h', 27, 10723151780598845931)} AS h FROM d),
f AS (SELECT CAST(floor(-ln(greatest((xor(h, h >> 31) >> 11)::DOUBLE / 9007199254740992, 1e-300)) / ln(12)) AS INT) AS top FROM e) SELECT layer, count(*) AS n FROM (SELECT unnest(range(0, top + 1))::INT AS layer FROM f) GROUP BY layer"""
    sql["event_windows"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
    return sql
