"""Text columns: cleaning by the Unicode white space that the reference data model trims, and name keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space code points (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def clean(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.btrim(c, F.lit(WHITE_SPACE)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    """The text as it is; blank becomes null."""
    return F.when(clean(c).isNotNull(), c)


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed: Spark has none of these for all of Unicode."""
    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC with white space collapsed and case kept."""
    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


@F.pandas_udf(StringType())
def compact(texts: pd.Series) -> pd.Series:
    """NFKC without white space, case-folded: a key for codes and names; a missing text is empty."""
    return texts.map(lambda x: "".join(unicodedata.normalize("NFKC", x or "").split()).casefold())


def squeeze(c: Column | str) -> Column:
    """Lower case without white space: a key for names that are in NFKC."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def ascii_fold(c: Column) -> Column:
    """``fold`` for text that is known to be ASCII, without leaving the JVM."""
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))


def without_punctuation(folded: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(folded, r"\p{P}", " "), r"\s+", " "))


def label(c: Column, limit: int = 60) -> Column:
    """Control characters to spaces, and the first ``limit`` characters."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), 1, limit)


def bigrams(c: Column) -> Column:
    """The set of two-character substrings."""
    places = F.when(F.length(c) >= 2, F.sequence(F.lit(1), F.length(c) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(c, i, F.lit(2))))
