"""URL filter: listed rules first, then naive Bayes over segmented host words and path words.

Names in a host are split into words by a unigram Viterbi search. Its words and their counts come from a lexicon, the words that
two public tokenizers' vocabularies share with counts by Zipf's rule from their rank, and from the table: the parts of names that
a hyphen or digit divides, counted once for each such name, and the words of paths, counted once for each host whose names
don't have them. A part is judged without its own name's count, so a name that nothing divides is no evidence for itself.

There are no labels for pages. Multinomial naive Bayes starts from the labelled example urls below and takes one step of
expectation maximisation over the table: each host, with its words and the different words of its paths, counts for both classes
by its posterior under the examples. No word decides alone; a verdict is the sign of the summed log odds. All words, features
and their odds are kept in tables and joined; only the ``HOT`` commonest keys go to every task, so that no frequent key is shuffled.

Defined results: a null url, or one without "://", has empty host and path, no rule, and is allowed; rows that repeat are judged
each, and a host counts once in learning, however many rows it has; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import cache
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.text import shipped
from vexel.plans.storage import materialize

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Labelled example urls (host words, then path words), a parameter of the learner. They are written from what block lists are for (adult, gambling, drugs, ads,
#: spam, loans, theft), not from any table: words that harmless names have as well stand in both classes.
BLOCKED = (
    "adult dating / singles xxx", "adult video / porn free", "hot adult chat / sex cam", "porn tube / xxx free", "escort girls / adult sex",
    "casino royal / slots bonus", "online casino / jackpot spin", "poker room / casino bonus", "betting tips / odds jackpot", "sport bets / bonus wager", "lottery winner / claim prize", "lucky slots / win jackpot",
    "diet pills / buy viagra", "discount pharma / pills order", "cheap viagra / buy now", "weight loss pills / order now", "replica watches / cheap buy", "replica bags / discount deals",
    "ads network / click banner", "ad tracker / pixel click", "ads server / banner pixel", "click ads / popup banner", "spam mailer / bulk seo", "seo links / spam backlinks", "spam mail / bulk send",
    "payday loans / fast cash", "cash loan / instant approve", "get rich / money fast", "free prize / claim winner", "warez crack / keygen serial", "cracked software / free warez", "promo deals / discount coupon",
    "vegas casino / roulette blackjack", "viagra shop / pills pharmacy", "herbal viagra / order bonus", "spam blaster / mail bulk", "malware load / keygen crack", "gambling games / casino wager",
)
ALLOWED = (
    "city library / books catalog", "public school / students news", "garden notes / plants soil", "open science / papers review", "daily news / article politics", "weather report / forecast rain", "music lessons / piano scales",
    "history museum / exhibits visit", "travel guide / city walks", "family recipes / bread soup", "health clinic / doctors visit", "university press / books journal", "river hikers / trail map", "football club / match report",
    "local council / services tax", "software docs / guide install", "code blog / tutorial python", "photo journal / mountains lake", "car repair / manual engine", "bird watch / species list", "film review / actors cinema",
    "chess club / games openings", "law office / family contract", "house design / kitchen windows", "bank help / account card", "train times / station map", "art gallery / painting artists", "math forum / algebra proof",
    "farm market / milk apples", "free software / source license", "race track / timing results", "wildlife trust / forest project",
    "cheap flights / city tickets", "sheep farm / wool cheese", "win at chess / endgame study", "free library / public books", "price tracker / chart history",
)
#: Share of hosts to block before any evidence, pseudo-count of a feature, and the most that a table's unlabelled hosts weigh against the labelled examples: without
#: such a bound, expectation maximisation from few labels follows the largest groups of the unlabelled (Nigam et al. 2000, who weigh these down likewise).
PRIOR, ALPHA, MOST_WEIGHT = 0.2, 0.2, 4.0
#: The longest word looked up, as a part of a name has at most 63 octets in the domain name system.
HOT, LONGEST = 20_000, 63
#: Steps to a unit of log odds or of a posterior, so that sums are exact.
UNIT = 10**9


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "(?s)^[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule whose host is the url's or above it and whose path begins the url's, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=len):
        at, _, under = r.partition("/")
        fits = ((host_ == at) | F.endswith(host_, F.lit(f".{at}"))) & F.startswith(path_, F.lit(f"/{under}"))
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


def split_words(name: str, cost: dict[str, float], total: float) -> list[str]:
    """The likeliest split of a name into words; an unknown run of n letters costs as a rare word, more for each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(name) + 1):
        best.append(min((best[s][0] + cost.get(name[s:e], total + 2.5 * (e - s)), s) for s in range(max(0, e - LONGEST), e)))
    words, e = [], len(name)
    while e:
        words.append(name[best[e][1] : e])
        e = best[e][1]
    return words[::-1]


def parts(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")


@cache
def lexicon(longest_first: int = 1_000_000) -> dict[str, int]:
    """Words that are both a beginning in one public vocabulary and an ending in another, and so whole; counts fall as one over the rank."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as b:
        begins, ends = (json.load(f)["model"]["vocab"] for f in (a, b))
    whole = sorted((i, w[:-4]) for w, i in ends.items() if w.endswith("</w>") and "\u0120" + w[:-4] in begins)
    rank = count(1)
    return {w: longest_first // next(rank) for _, w in whole if len(w) > 1 and w.isascii() and w.isalpha()}


class Judge:
    """Costs of words by their counts."""

    def __init__(self, counts: dict[str, int]):
        self.total = math.log(sum(counts.values()) + len(counts))
        self.cost = {w: self.total - math.log(c + 1) for w, c in counts.items()}


def examples() -> dict[str, tuple[float, float]]:
    """How often each feature occurs in the blocked and the allowed examples, each class weighed by its share, so that words of both are no evidence."""
    seen = [Counter(f for e in kind for side, part in zip("hp", e.split(" / "), strict=True) for f in (f"{side}:{w}" for w in part.split())) for kind in (BLOCKED, ALLOWED)]
    return {f: (2 * PRIOR * seen[0][f], 2 * (1 - PRIOR) * seen[1][f]) for f in seen[0] | seen[1]}


def _names(hosts: DataFrame) -> DataFrame:
    """host, label (its part between dots), name (a run of letters in it) and own: whether the label has more than one."""
    labels = hosts.select("host", F.explode(F.split("host", "\\.")).alias("label")).select("host", "label", parts(F.col("label")).alias("w"))
    return labels.select("host", "label", (F.size("w") > 1).alias("own"), F.explode("w").alias("name"))


def words(named: DataFrame, paths: DataFrame, known: dict[str, int] | None = None) -> DataFrame:
    """w and c of all words: the lexicon's, those of divided names, and those of paths, given as host and w."""
    divided = named.where("own").select("label", F.col("name").alias("w")).distinct().select("w")
    other = paths.distinct().join(named.select("host", F.col("name").alias("w")).distinct(), ["host", "w"], "left_anti").select("w")
    each = divided.union(other).where(F.length("w").between(2, LONGEST)).groupBy("w").agg(F.count("*").alias("c"))
    listed = named.sparkSession.createDataFrame(list((lexicon() if known is None else known).items()), "w string, c long")
    return materialize(each.union(listed).groupBy("w").agg(F.sum("c").alias("c")), "url-words")


def segments(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, own, n and words: the likeliest split of each distinct name."""
    total = math.log(known.agg(F.sum("c") + F.count("*")).first()[0])

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, own: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for n, o, pairs in zip(name, own, found, strict=True):
            counts = {x["w"]: x["c"] - int(o and x["w"] == n) for x in pairs}
            out.append(split_words(n, {w: total - math.log(c + 1) for w, c in counts.items() if c}, total))
        return pd.Series(out, dtype=object)

    starts = F.sequence(F.lit(1), F.length("name"))
    each = names.select("*", F.explode(starts).alias("at")).select("name", "own", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))).alias("len"))
    each = each.select("name", "own", "n", F.substring("name", F.col("at"), F.col("len")).alias("w")).distinct()
    short = known.where(F.length("w") <= 3)  # 18,252 words at most, and in most names
    one = each.where(F.length("w") <= 3).join(F.broadcast(short), "w", "left")
    two = each.where(F.length("w") > 3).join(known.where(F.length("w") > 3), "w")
    both = one.select("name", "own", "n", "w", "c").union(two.select("name", "own", "n", "w", "c"))
    found = both.groupBy("name", "own", "n").agg(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("w", "c"))).alias("found"))
    return materialize(shipped(found).select("name", "own", "n", split("name", "own", "found").alias("words")), "url-segments")


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The columns of rows and the value of table, which has all keys once; its HOT rows of most n go to each task, the others are joined."""
    hot = materialize(table.orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, value), "url-hot")
    most = materialize(rows.join(F.broadcast(hot), keys, "left"), "url-rows")
    rest = most.where(F.col(value).isNull()).drop(value).join(table.select(*keys, value), keys)
    return most.where(F.col(value).isNotNull()).unionByName(rest)


def _odds(seen: DataFrame, bad: str, good: str) -> DataFrame:
    """f, n and odds (fixed-point) from the weights of each feature in both classes."""
    b, g, size = seen.agg(F.coalesce(F.sum(bad), F.lit(0.0)), F.coalesce(F.sum(good), F.lit(0.0)), F.count("*")).first()
    a, z = ALPHA * PRIOR, ALPHA * (1 - PRIOR)
    odds = F.ln((F.col(bad) + a) / (b + a * size)) - F.ln((F.col(good) + z) / (g + z * size))
    return seen.select("f", "n", F.round(odds * UNIT).cast("long").alias("odds"))


def learn(found: DataFrame) -> DataFrame:
    """f, n (hosts) and odds (fixed-point log odds of blocking) of all features, from host and f, each pair once."""
    listed = found.sparkSession.createDataFrame([(f, 0, *both) for f, both in examples().items()], "f string, n long, bad double, good double")
    first = F.broadcast(_odds(listed, "bad", "good"))  # no more rows than the examples have words
    sums = found.join(first.select("f", "odds"), "f", "left").groupBy("host").agg(F.coalesce(F.sum("odds"), F.lit(0)).alias("odds"))
    posterior = 1 / (1 + F.exp(-(F.col("odds") / UNIT + math.log(PRIOR / (1 - PRIOR)))))
    believed = materialize(sums.select("host", F.round(posterior * UNIT).cast("long").alias("bad")), "url-posteriors")
    soft = found.join(believed, "host").groupBy("f").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum(F.lit(UNIT) - F.col("bad")).alias("good"))
    soft = materialize(soft, "url-soft")
    mass = soft.agg(F.sum("n")).first()[0] or 1
    weight = min(1.0, MOST_WEIGHT * sum(b + g for b, g in examples().values()) / mass) / UNIT
    both = soft.select("f", "n", (F.col("bad") * weight).alias("bad"), (F.col("good") * weight).alias("good")).union(listed)
    seen = materialize(both.groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url-seen")
    return materialize(_odds(seen, "bad", "good"), "url-odds")


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, score (log odds of blocking) and verdict for each row."""
    base = materialize(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), "urls")
    usable = base.where("host <> ''")
    hosts = materialize(usable.groupBy("host").agg(F.count("*").alias("n")), "url-hosts")
    named = materialize(_names(hosts), "url-names")
    paths = materialize(usable.select("row", "host", F.explode(parts(F.col("path"))).alias("w")), "url-paths")
    split = segments(named.groupBy("name", "own").agg(F.count("*").alias("n")), words(named, paths.select("host", "w")))
    of_hosts = materialize(_looked_up(named, split, ["name", "own"], "words").select("host", F.explode("words").alias("w")).select("host", F.concat(F.lit("h:"), "w").alias("f")), "url-features")
    of_paths = paths.select("row", "host", F.concat(F.lit("p:"), "w").alias("f"))
    odds = learn(of_hosts.union(of_paths.select("host", "f")).distinct())
    total = F.coalesce(F.sum("odds"), F.lit(0))
    by_host = hosts.join(_looked_up(of_hosts, odds, ["f"], "odds").groupBy("host").agg(total.alias("odds")), "host", "left")
    by_host = materialize(by_host.select("host", "n", F.coalesce("odds", F.lit(0)).alias("host_odds")), "url-hosts")
    by_path = _looked_up(of_paths.select("row", "f"), odds, ["f"], "odds").groupBy("row").agg(total.alias("path_odds"))
    each = _looked_up(usable, by_host, ["host"], "host_odds").join(by_path, "row", "left")
    score = F.lit(math.log(PRIOR / (1 - PRIOR))) + (F.col("host_odds") + F.coalesce(F.col("path_odds"), F.lit(0))) / UNIT
    scored = each.select("page_id", "host", "path", score.alias("score")).unionByName(base.where("host = ''").select("page_id", "host", "path", F.lit(-1.0).alias("score")))
    by_rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    ruled = scored.select("page_id", "host", "path", rule(F.col("host"), F.col("path")).alias("rule"), "score")
    return ruled.select("*", F.coalesce(F.element_at(by_rule, F.col("rule")), F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))
