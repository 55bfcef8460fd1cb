"""Quality rules: robust multivariate outliers among the statistics of texts.

Each text becomes a vector of transformed statistics. For every language and source a minimum-covariance-determinant
estimate gives the location and scatter of the central half of the texts, (n + d + 1) / 2 of them, and texts whose Mahalanobis
distance lies far out are rejected. The estimate has three starts in each group and takes concentration steps: distances, the h-th
smallest of them from a histogram (to 1/32 of its logarithm), then the moments of the rows below it; after two steps the start of
least determinant goes on, until no group's determinant changes. The diagonal of a scatter is raised by a floor for each
statistic, as many are constant in clean text. Vectors are fixed-point integers and their
sums are exact decimals, so the result doesn't depend on how rows were dealt out. All of it is DataFrame expressions; a
group's sums are combined on the map side, and only one row per group and histogram bin is shuffled.

Defined results: a null text counts as empty and fails the base rule; null languages and sources are groups like others;
repeated rows are judged each; groups of fewer than ``min_group`` texts are judged with the estimate of the whole language, or, if
that is small too, of all texts, large groups included; junk that is far tighter than the good texts and nearly half of a group
can hold the core of least determinant itself, and then passes; in an even smaller corpus nothing but the base rule rejects. Columns of the input other than
those named are ignored by ``judge`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm import text as T
from vexel.plans.storage import TEXT_GROUP, materialize

SYMBOLS = "#*$%&|<>"
#: Fixed-point steps to a unit of a transformed statistic.
UNIT = 4096
#: Names of the transformed statistics, and the least standard deviation of each (a floor for statistics that are mostly constant).
FEATURES = {"word_length": 0.12, "symbols": 0.12, "dup_lines": 0.25, "repeats": 0.20, "upper": 0.10, "marks": 0.15}
#: Concentration steps end when no group's log determinant changes by more than SETTLED, or after STEPS; bins to a factor e of squared distance.
SETTLED, STEPS, BINS = 0.01, 40, 32
#: Half the side of the box of the third start, in floored median deviations.
BOX = 2.5
#: A text is rejected beyond this squared distance, scaled so that the median is that of a chi-square with 6 degrees.
CUTOFF, MEDIAN = 100.0, 5.348
MIN_GROUP = 60


def statistics(docs: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Per row: doc_id, lang, source, the base statistics and the transformed vector x0.. as integers, after the columns in extra."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(
        *(extra or []), "doc_id", "lang", "source", T.words(F.col("text")).alias("w"),
        T.count_of(text, SYMBOLS).alias("n_symbols"), T.count_of(text, "A-Z").alias("n_upper"), T.count_of(text, ".,!?;:").alias("n_marks"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    kept = [c for c in first.columns if c not in ("w", "lines")]
    at = lambda i: F.get("w", i)
    counted = first.select(
        *kept, "w", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x, i: F.xxhash64(x, at(i + 1), at(i + 2))).alias("hashes"),
        F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("w"), F.lit(2))))).cast("long").alias("span"),
    )
    # In texts with equal windows: one long for each, the hash's upper bits over the position, sorted. Equal windows are then neighbours, and are compared word by word.
    windows = F.slice("hashes", 1, F.greatest(F.size("w") - 2, F.lit(0)))
    low = F.col("span") - 1
    keyed = counted.select("*", windows.alias("windows")).select("*", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(-F.col("span")).bitwiseOR(i.cast("long")))),
    ).alias("keys"))

    def same(x: Column, y: Column) -> Column:
        place = lambda z, k: at((z.bitwiseAND(low) + k).cast("int"))
        return x.bitwiseXOR(y).between(0, low) & (place(x, 0) == place(y, 0)) & (place(x, 1) == place(y, 1)) & (place(x, 2) == place(y, 2))

    found = keyed.select(*[c for c in keyed.columns if c not in ("keys", "w", "windows", "hashes")], F.when(F.col("keys").isNotNull(), F.sort_array(F.transform(F.filter(
        "keys", lambda x, i: same(x, F.get("keys", i - 1)) | same(x, F.get("keys", i + 1)),
    ), lambda x: x.bitwiseAND(low).cast("int")))).alias("spots"))
    repeated = F.coalesce(F.aggregate(F.transform("spots", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("spots", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x), F.lit(0))
    based = found.select(*[c for c in found.columns if c not in ("spots", "span")], repeated.cast("long").alias("n_repeat_words"))
    chars, count = F.greatest(F.col("word_chars"), F.lit(1)).cast("double"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [
        F.ln(1 + F.col("word_chars") / count),
        F.ln(1 + 100 * F.col("n_symbols") / chars),
        F.ln(1 + 100 * F.col("n_dup_lines") / count),
        F.sqrt(F.col("n_repeat_words") / count),
        F.ln(1 + 20 * F.col("n_upper") / chars),
        F.ln(1 + 20 * F.col("n_marks") / chars),
    ]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return based.select(
        *[c for c in based.columns if c not in ("n_upper", "n_marks")], failed.alias("base_failed"),
        *[F.round(v * UNIT).cast("long").alias(f"x{k}") for k, v in enumerate(values)],
    )


def _grouped(rows: DataFrame, min_group: int) -> DataFrame:
    """Rows with level and g, the group each is judged with (level 3 is none), and feeds, the groups whose estimates it enters."""
    sized = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    lang = sized.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    total = lang.agg(F.sum("n_lang").alias("n_all"), F.min("n_lang").alias("least_lang"))
    level = F.when(F.col("n") >= min_group, 0).when(F.col("n_lang") >= min_group, 1).when(F.col("n_all") >= min_group, 2).otherwise(3)
    key = lambda *of: F.to_json(F.struct(*of), {"ignoreNullFields": "false"})
    feeds = F.array_compact(F.array(
        F.when(F.col("n") >= min_group, key("lang", "source")),
        F.when((F.col("least") < min_group) & (F.col("n_lang") >= min_group), key("lang")),
        F.when((F.col("least_lang") < min_group) & (F.col("n_all") >= min_group), F.lit("all")),
    ))
    plan = sized.join(lang, sized["lang"].eqNullSafe(lang["lang"])).drop(lang["lang"]).join(F.broadcast(total))  # total is one row
    g = F.when(F.col("level") == 0, key("lang", "source")).when(F.col("level") == 1, key("lang")).otherwise(F.lit("all"))
    plan = plan.select("lang", "source", level.alias("level"), feeds.alias("feeds")).withColumn("g", g)
    plan = materialize(plan, "quality-groups").select(F.col("lang").alias("l"), F.col("source").alias("s"), "level", "feeds", "g")
    return rows.join(plan, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of x* from the columns m* (mean) and a* (inverse covariance)."""
    y = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        inner = F.col(f"a{i}_{i}") * y[i]
        for j in range(i):
            inner = inner + 2 * F.col(f"a{i}_{j}") * y[j]
        total = total + y[i] * inner
    return F.greatest(total, F.lit(0.0))


def _measured(rows: DataFrame, fit: DataFrame, d: int) -> DataFrame:
    return rows.join(fit, "g").select("g", "start", *[f"x{i}" for i in range(d)], _distance(d).alias("d2"))


def _quantile(rows: DataFrame, value: Column, extra: int, name: str) -> DataFrame:
    """Per group g of n rows and start: the upper end of the logarithmic bin that holds the (n + extra) / 2 th value."""
    key = ["g", "start"]
    bins = rows.select(*key, F.floor(F.ln(value + 1e-6) * BINS).cast("long").alias("bin")).groupBy(*key, "bin").agg(F.count("*").alias("n"))
    summed = bins.withColumn("below", F.sum("n").over(_by(*key).orderBy("bin"))).withColumn("all", F.sum("n").over(_by(*key)))
    return summed.where(F.col("below") >= F.least((F.col("all") + extra) / 2, F.col("all"))).groupBy(*key).agg(F.exp((F.min("bin") + 1) / BINS).alias(name))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _moments(rows: DataFrame, d: int) -> DataFrame:
    """Per group and start: mean and inverse covariance, its diagonal raised by the floors; sums are exact decimals."""
    exact = lambda c: F.sum(c.cast("decimal(19,0)"))
    pairs = list(combinations_with_replacement(range(d), 2))
    sums = rows.groupBy("g", "start").agg(F.count("*").alias("n"), *[exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(d)], *[exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    n = F.col("n").cast("double")
    fit = sums.select("g", "start", n.alias("n"), *[(F.col(f"s{i}").cast("double") / n / UNIT).alias(f"m{i}") for i in range(d)], *[(F.col(f"p{i}_{j}").cast("double") / n / UNIT / UNIT).alias(f"p{i}_{j}") for i, j in pairs])
    floors = list(FEATURES.values())
    return _cholesky(fit, d, floors)


def _cholesky(fit: DataFrame, d: int, floors: list[float]) -> DataFrame:
    """Log determinant, means and the inverse covariance, by the Cholesky factor and its inverse written out; fit has a row per group."""
    def rest(i: int, j: int) -> Column:
        v = F.col(f"p{j}_{i}") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        return v

    def inverse(i: int, j: int) -> Column:
        v = F.lit(1.0) if i == j else F.lit(0.0)
        for k in range(j, i):
            v = v - F.col(f"l{i}_{k}") * F.col(f"r{k}_{j}")
        return v / F.col(f"l{i}_{i}")

    for j in range(d):
        fit = fit.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1e-9))))
        fit = fit.withColumns({f"l{i}_{j}": rest(i, j) / F.col(f"l{j}_{j}") for i in range(j + 1, d)})
    fit = materialize(fit, "quality-factor")  # else the planner walks forty nested projections
    for i in range(d):
        fit = fit.withColumns({f"r{i}_{j}": inverse(i, j) for j in range(i + 1)})
    square = lambda i, j: sum((F.col(f"r{k}_{i}") * F.col(f"r{k}_{j}") for k in range(i + 1, d)), F.col(f"r{i}_{i}") * F.col(f"r{i}_{j}"))
    log_det = sum((F.ln(F.col(f"l{i}_{i}")) for i in range(1, d)), F.ln("l0_0"))
    return fit.select("g", "start", (2 * log_det).alias("log_det"), *[f"m{i}" for i in range(d)], *[square(i, j).alias(f"a{i}_{j}") for i in range(d) for j in range(i + 1)])


def _start(rows: DataFrame, d: int) -> DataFrame:
    """Medians and floored median deviations of each coordinate, from histograms of the fixed-point values."""
    long = rows.select("g", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(d)])).alias("k", "x"))
    step = UNIT // 64
    bins = long.groupBy("g", "k", F.floor(F.col("x") / step).alias("bin")).agg(F.count("*").alias("n"))
    bins = materialize(bins, "quality-bins")
    def middle(t: DataFrame, out: str) -> DataFrame:
        w = _by("g", "k")
        t = t.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        return t.where(F.col("below") * 2 >= F.col("all")).groupBy("g", "k").agg(F.min("bin").alias(out))
    med = middle(bins, "med")
    off = bins.join(med, ["g", "k"]).select("g", "k", "med", "n", F.abs(F.col("bin") - F.col("med")).alias("bin")).groupBy("g", "k", "med", "bin").agg(F.sum("n").alias("n"))
    mad = middle(off, "mad").join(med, ["g", "k"])
    floors = F.array(*[F.lit(v) for v in FEATURES.values()])
    one = mad.select("g", "k", ((F.col("med") + 0.5) / 64).alias("m"), F.greatest(1.4826 * (F.col("mad") + 0.5) / 64, F.get(floors, F.col("k"))).alias("s"))
    cell = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = one.groupBy("g").agg(*[cell("m", k).alias(f"m{k}") for k in range(d)], *[cell("s", k).alias(f"l{k}_{k}") for k in range(d)])
    wide = materialize(wide, "quality-medians")
    diagonal = [(1 / F.pow(F.col(f"l{i}_{i}"), 2) if i == j else F.lit(0.0)).alias(f"a{i}_{j}") for i in range(d) for j in range(i + 1)]
    medians = wide.select("g", F.lit(0).alias("start"), F.lit(float("inf")).alias("log_det"), *[f"m{i}" for i in range(d)], *diagonal)
    boxed = rows.join(wide, "g")
    for i in range(d):
        boxed = boxed.where(F.abs(F.col(f"x{i}") / UNIT - F.col(f"m{i}")) <= BOX * F.col(f"l{i}_{i}"))
    boxed = boxed.select("g", F.lit(2).alias("start"), *[f"x{i}" for i in range(d)])
    return medians.union(_moments(rows.withColumn("start", F.lit(1)).unionByName(boxed), d))


def _step(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Moments of the (n + d + 1) / 2 rows that are nearest by the estimate, for each group and start."""
    d = len(FEATURES)
    measured = _measured(rows, fit, d)
    cut = _quantile(measured, F.col("d2"), d + 1, "cut")
    return materialize(_moments(measured.join(cut, ["g", "start"]).where(F.col("d2") <= F.col("cut")), d), "quality-fit")


def estimate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per group g: location, inverse covariance and the scale that brings the median distance to that of a chi-square.

    Each group has three starts: medians and deviations, the moments of all rows, and those of the rows in a box about the
    medians. After two steps the one with the least determinant goes on until the determinants settle.
    """
    d = len(FEATURES)
    fit = materialize(_start(rows, d), "quality-fit")
    for _ in range(2):
        fit = _step(rows, fit)
    fit = fit.groupBy("g").agg(F.min_by(F.struct(*[c for c in fit.columns if c != "g"]), F.struct("log_det", "start")).alias("best")).select("g", "best.*")
    fit = materialize(fit, "quality-fit")
    for _ in range(steps):
        before, fit = fit, _step(rows, fit)
        moved = fit.join(before.select("g", F.col("log_det").alias("before")), "g").where(F.abs(F.col("log_det") - F.col("before")) > SETTLED)
        if moved.isEmpty():
            break
    scale = _quantile(_measured(rows, fit, d), F.col("d2"), 0, "middle")
    return materialize(fit.join(scale, ["g", "start"]), "quality-fit")


def judge_rows(stats: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of statistics() with d2 (null if the base rule rejects them or there is no group) and kept."""
    passed = _grouped(stats.where(~F.col("base_failed")), min_group)
    core = materialize(passed.select(F.explode("feeds").alias("g"), *[f"x{k}" for k in range(len(FEATURES))]), "quality-vectors")
    fit = estimate(core)
    scaled = _distance(len(FEATURES)) * MEDIAN / F.greatest(F.col("middle"), F.lit(MEDIAN / 2))
    near = passed.join(fit, "g", "left").select(*stats.columns, scaled.alias("d2")).select("*", F.coalesce(F.col("d2") <= cutoff, F.lit(True)).alias("kept"))
    failed = stats.where("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    names = [*stats.columns, "d2", "kept"]
    return near.select(*names).unionByName(failed.select(*names))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed, kept and d2 for each row."""
    stats = materialize(statistics(docs.select("doc_id", "text", "lang", "source")), "quality-stats")
    return judge_rows(stats).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    stats = statistics(packed.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source")), [F.col("row")])
    return judge_rows(materialize(stats, "quality-stats", TEXT_GROUP)).where("kept").select("row.*")
