"""First-wins removal of exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the smallest order value.

    min_by combines on the map side, so a key that holds a third of all rows
    reaches its reducer as one row per task. Rows with a null key are one group.
    """
    row = F.min_by(F.struct(*[c for c in df.columns if c != key]), F.col(order))
    return df.groupBy(key).agg(row.alias("_row")).select(key, "_row.*").select(*df.columns)


def mark_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row with the order value of its group's first row, as first_of."""
    firsts = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("first_of"))
    return df.join(firsts, df[key].eqNullSafe(firsts["_key"]), "left").drop("_key")


def digest(text: Column) -> Column:
    """SHA-256 of the compact JSON identity object of a text."""
    return F.sha2(F.to_json(F.struct(text.alias("text"))), 256)
