"""What the operators share: tables, the shared folder, the held-out split and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.shared import drop, forget, new_path, shared_dir, written

__all__ = ["drop", "forget", "new_path", "shared_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, of at most about 200 bytes each, up to which a table is broadcast.
BROADCAST_ROWS = 200_000


#: The same for a table of one long each.
BROADCAST_KEYS = 1_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is proven small; else Spark's shuffled joins are used."""
    return F.broadcast(df) if is_small(df, rows) else df


class Keys:
    """A table of one long each: as a sorted array that workers hold if it is proven small, else for a shuffled join."""

    def __init__(self, keys: DataFrame, rows: int = BROADCAST_KEYS):
        self.column, self.table = keys.columns[0], keys
        self.few = is_small(keys, rows)
        self.held = keys.sparkSession.sparkContext.broadcast(np.sort(keys.toPandas()[self.column].to_numpy(np.int64))) if self.few else None

    def test(self):
        """For workers: which of an array's longs are among the keys; all, if the join has yet to tell."""
        held = self.held

        def among(values: np.ndarray) -> np.ndarray:
            if held is None:
                return np.ones(len(values), bool)
            at = np.searchsorted(held.value, values)
            return (at < len(held.value)) & (np.append(held.value, 0)[at] == values)

        return among

    def only(self, rows: DataFrame) -> DataFrame:
        """rows that passed the test, or the join."""
        return rows if self.few else rows.join(self.table, self.column, "left_semi")


def free_prefix(docs: DataFrame) -> str:
    """What no column of docs begins with, so that an operator's own columns can't clash with them."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def own_columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs in order, whatever their names, with some replaced."""
    return [changed[c].alias(c) if c in changed else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.encode(id_text(doc_id), "UTF-8")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of at most `bound` labelled rows outside the held-out fifth, the smallest by a hash of the id.

    Null or non-binary labels and null ids take no part; of several labels for
    an id the largest counts. The ids are chosen before any text is read, and
    at most `bound` ids are broadcast.
    """
    ok = F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))
    ids = labels.where(ok).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")
