"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _nfkc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; null stays null. Spark SQL has no built-in form of it."""
    for s in parts:
        yield s.map(_nfkc)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda texts: None if texts is None else [_nfkc(x) for x in texts])


def collapse_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one blank; the ends are trimmed."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def _beyond_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))


def compatible(text: Column) -> Column:
    """NFKC. ASCII texts, which it leaves alone, aren't sent to Python: they are null there."""
    return F.coalesce(nfkc(F.when(_beyond_ascii(text), text)), text)


def normalized(text: Column) -> Column:
    """NFKC, then collapsed white space; null stays null."""
    return collapse_whitespace(compatible(text))


def normalized_all(texts: Column) -> Column:
    """normalized() of every element of an array."""
    other = F.coalesce(F.exists(texts, _beyond_ascii), F.lit(False))
    return F.transform(F.coalesce(nfkc_all(F.when(other, texts)), texts), collapse_whitespace)


def is_blank(text: Column) -> Column:
    return F.coalesce(collapse_whitespace(text) == "", F.lit(True))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
