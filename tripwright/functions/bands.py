"""Buckets and bands that stand for counts and rates in published aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 10


def count_bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n < K, "<10").otherwise("10+")


def rate_band(numerator: Column, denominator: Column, empty: str = "<10/suppressed") -> Column:
    """Six bands; small numerators and denominators are suppressed, an empty denominator reads ``empty``."""
    r = numerator / F.nullif(denominator, F.lit(0))
    return (
        F.when(denominator == 0, empty).when((denominator < K) | ((numerator > 0) & (numerator < K)), "<10/suppressed")
        .when(r < 0.10, "0-<10%").when(r < 0.25, "10-<25%").when(r < 0.50, "25-<50%").when(r < 0.75, "50-<75%").when(r < 0.90, "75-<90%").otherwise("90-100%")
    )


def degree_band(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").when(n <= 49, "10-49").otherwise("50+")


def support_band(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise("10+")


def choice_size_band(n: Column) -> Column:
    """Of how many candidates there are."""
    return F.when(n < 1, "0").when(n < 10, "1-9").when(n < 50, "10-49").when(n < 100, "50-99").when(n < 500, "100-499").otherwise("500+")


def density_band(positives: Column, candidates: Column) -> Column:
    r = positives / F.nullif(candidates, F.lit(0))
    return F.when(candidates <= 0, "not_applicable").when(r == 0, "0%").when(r < 0.01, "0-<1%").when(r < 0.10, "1-<10%").when(r < 0.25, "10-<25%").otherwise("25%+")


def positive_band(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise("10+")


SMALL = "<10/suppressed"


def size_band(n: Column) -> Column:
    """Bytes in powers of ten MiB."""
    mib = 1 << 20
    return F.when(n.isNull() | (n < 0), "suppressed").when(n == 0, "0").when(n < mib, "<1MiB").when(n < 10 * mib, "1-<10MiB").when(n < 100 * mib, "10-<100MiB").otherwise("100MiB+")


def length_band(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n < 10, "1-9").when(n.isNotNull(), "10+")


def decade_band(text: Column) -> Column:
    """The decade of a text that starts with a year."""
    year = F.regexp_extract(text, "^([0-9]{4})", 1)
    return F.when(year != "", F.concat(F.substring(year, 1, 3), F.lit("0s"))).when(text.rlike("^[0-9]+s$"), text).when(text.isNotNull(), "suppressed")


def combined_counts(buckets: Column) -> Column:
    """The bucket of a sum of counts of which only the buckets are known."""
    small = F.size(F.filter(buckets, lambda x: x == "<10"))
    has = lambda b: F.exists(buckets, lambda x: x == b)
    return F.when(has("10+"), "10+").when(has("suppressed"), "suppressed").when(small == 0, "0").when(small == 1, "<10").otherwise("suppressed")


def combined_rates(bands: Column) -> Column:
    """The band of several rates: their own if it is one, else ``mixed``."""
    kinds = F.array_distinct(F.filter(bands, lambda x: x.isNotNull()))
    return F.when(F.size(kinds) == 0, "suppressed").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(F.exists(kinds, lambda x: x.isin(SMALL, "suppressed")), SMALL).otherwise("mixed")


def combined_sizes(bands: Column) -> Column:
    """The least band that a sum of sizes in these bands can be in."""
    has = lambda b: F.exists(bands, lambda x: x == b)
    return F.when(F.forall(bands, lambda x: x == "0"), "0").when(has("100MiB+"), "100MiB+").when(has("10-<100MiB"), "10MiB+").when(has("1-<10MiB"), "1MiB+").otherwise("suppressed")


def both_sides(numerator: Column, denominator: Column, value: Column) -> Column:
    """``value`` as text, unless the numerator or what is left of the denominator is a small cell."""
    rest = denominator - numerator
    small = (denominator < K) | ((numerator > 0) & (numerator < K)) | ((rest > 0) & (rest < K))
    return F.when(small, SMALL).otherwise(value.cast("string"))


def counted(n: Column, exact: bool = False) -> Column:
    """The bucket of a count, or the count itself where a run has opted in to exact aggregates."""
    return n.cast("string") if exact else count_bucket(n)
