"""Distances and vector arithmetic as Column expressions. L2 is squared, Lp has no root; a similarity sorts descending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITIES = {"ip", "jaccard", "cosine"}
#: Metrics that are sums over coordinates, and the summand.
SUMS = {"ip": lambda x, y: x * y, "l2": lambda x, y: (x - y) * (x - y), "l1": lambda x, y: F.abs(x - y)}


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _sum(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def ip(a: Column, b: Column) -> Column:
    return _sum(a, b, SUMS["ip"])


def l2(a: Column, b: Column) -> Column:
    return _sum(a, b, SUMS["l2"])


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, SUMS["l1"])


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def lp(a: Column, b: Column, p: float = 3.0) -> Column:
    return _sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))


def canberra(a: Column, b: Column) -> Column:
    """A coordinate that is zero in both counts as zero."""
    return _sum(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))


def bray_curtis(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y)) / _sum(a, b, lambda x, y: F.abs(x + y))


def jensen_shannon(a: Column, b: Column) -> Column:
    """For positive coordinates."""
    return _sum(a, b, lambda x, y: -0.5 * (x * F.ln((x + y) / 2 / x) + y * F.ln((x + y) / 2 / y)))


def jaccard(a: Column, b: Column) -> Column:
    return _sum(a, b, F.least) / _sum(a, b, F.greatest)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the normalised vectors; zero if either is zero."""
    return F.coalesce(ip(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


METRICS = {"ip": ip, "l2": l2, "l1": l1, "linf": linf, "lp": lp, "canberra": canberra, "braycurtis": bray_curtis, "jensenshannon": jensen_shannon, "jaccard": jaccard, "cosine": cosine}


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two words, or of two arrays of words."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def generalized_hamming(a: Column, b: Column) -> Column:
    """Differing elements of two arrays of sub-codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(ip(a, a))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sign_bits(a: Column) -> Column:
    """Up to 64 coordinates as the bits of a long, the first lowest; x >= 0 gives one."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))


def bits_to_reals(word: Column, d: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.call_function("shiftright", word, i).bitwiseAND(1) == 1, 1.0).otherwise(-1.0))
