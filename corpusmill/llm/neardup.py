"""MinHash near-dedup by min-max hashing.

Each permutation is evaluated once and gives two signature values, its least
and its largest hash, so PERMUTATIONS evaluations fill twice as many values.
Bands of ROWS values propose pairs: at the similarity of 0.8 a pair is missed
with probability (1 - 0.8**5)**40, or 1.3e-7. Links are confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common, similar

PERMUTATIONS, ROWS, SEED = 100, 5, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = "doc_id long, version long, n long, key binary, signature binary"
SETS = "digest binary, members binary"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words: A-Z lower-cased, parted by blank, tab, newline, \\v, \\f and \\r."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_sets(column: pa.ListArray, size: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes: `size` words each, or all words if there are fewer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint64)

    def mixed(part: np.ndarray, k: int) -> np.ndarray:
        n = max(len(part) - k + 1, 0)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = (h ^ part[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    whole = mixed(words, size)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(whole[a : b - size + 1]) if b - a >= size else mixed(words[a:b], int(b - a)) if b > a else words[:0]


def _key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def _same(a: DataFrame, b: DataFrame, doc_id: str, version: str) -> Column:
    return a["doc_id"].eqNullSafe(b[doc_id]) & (a["version"] == b[version])


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, version (a hash of the text), n (size of the shingle set), key (128-bit digest of the set), signature. Empty sets have a null key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = similar.signature_tables(PERMUTATIONS, SEED)
        for batch in batches:
            n, key, signature = [], [], []
            for s in shingle_sets(batch.column(2), size):
                n.append(len(s))
                if len(s):
                    values = similar.short_form(similar.extremes(s, a, b, largest=True))
                    key.append(_key(s))
                    signature.append(values.tobytes())
                else:
                    key.append(None), signature.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(signature, pa.binary())],
                names=["doc_id", "version", "n", "key", "signature"],
            )

    return _named(docs).select("doc_id", "version", word_hashes(F.col("text")).alias("w")).mapInArrow(rows, FEATURES)


def groups(docs: DataFrame, size: int = 5, percent: int = 80, slack: float | None = similar.SLACK) -> DataFrame:
    """(doc_id, version, key, n_shingles, component_id, stays) for every row of docs.

    stays: of the texts that links reach it is the first by doc_id, then by the
    hash of the text; null ids come last.
    component_id: the smallest doc_id that links reach. Documents with equal
    shingle sets are one class, by their set's 128-bit digest, and only classes
    are compared. Empty sets are linked with nothing.
    """
    made = common.written(features(docs, size), "features")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    classes = made.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(place).alias("first"))
    classes = common.written(classes.select("key", "first", F.col("first.doc_id").alias("_id"), F.col("first.version").alias("_version")), "classes")
    same = _same(made, classes, "_id", "_version") & (made["key"] == classes["key"])
    items = made.join(classes, same, "left_semi").select("key", "signature").dropDuplicates(["key"])
    items = common.written(items.withColumnRenamed("key", "digest").withColumn("key", F.monotonically_increasing_id()), "items")
    made = made.drop("signature")

    def sets(needed: DataFrame) -> DataFrame:
        wanted = items.join(common.small(needed, common.BROADCAST_KEYS), "key", "left_semi").select("key", "digest")
        wanted = common.written(wanted.join(classes.withColumnRenamed("key", "digest"), "digest").select("key", "digest", "_id", "_version"), "wanted")
        rows = _named(docs)
        ids = common.small(wanted.select("_id", "_version").distinct())
        rows = rows.join(ids, _same(rows, ids, "_id", "_version"), "left_semi")

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [s for s in shingle_sets(batch.column(0), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["digest", "members"])

        found = rows.select(word_hashes(F.col("text")).alias("w")).mapInArrow(collect, SETS)
        return common.written(found.join(wanted.select("key", "digest"), "digest").dropDuplicates(["key"]), "sets")

    _, found = similar.components(similar.packed(items), sets, percent, 2 * PERMUTATIONS, ROWS, slack=slack)
    digests = items.select("key", "digest")
    found = found.join(digests, found["node"] == digests["key"]).select(F.col("digest").alias("key"), "component")
    placed = classes.join(found, "key", "left").withColumn("component", F.coalesce(F.col("component").cast("string").cast("binary"), "key"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    placed = placed.join(least, "component").select("key", "least")
    out = made.select("doc_id", "version", "key", F.col("n").alias("n_shingles")).join(placed, "key", "left")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("version") == F.col("least.version"))
    out = out.withColumn("component_id", F.coalesce("least.doc_id", "doc_id")).withColumn("stays", F.col("least").isNull() | first)
    return out.drop("least")


def report(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Null and empty texts have an empty set and are their own component. Rows
    that repeat doc_id and text give one row; different texts under one id give
    one row each. Rows with a null id have no id to report and are left out.
    Extra columns are ignored; an empty table gives an empty result.
    """
    found = groups(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), size, percent)
    found = found.dropDuplicates(["doc_id", "key"]) if _repeats(found) else found
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _repeats(found: DataFrame) -> bool:
    return not found.groupBy("doc_id").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their own columns, whatever their names, that are the first of their group.

    Rows are told apart by doc_id and text: another text of the same id stays
    or goes by its own group, of rows that repeat both one stays, and rows with
    a null id are in the groups too, after those with an id. Null and empty
    texts are in no group; an empty table gives an empty result.
    """
    p = common.free_prefix(docs)
    found = groups(docs.select("doc_id", "text"), size, percent).select(F.col("doc_id").alias(p + "id"), F.col("version").alias(p + "version"), "stays")
    found = common.written(found, "stays")
    rows = docs.withColumn(p + "own", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(p + "id")) & (F.col(p + "own") == F.col(p + "version"))
    rows = rows.join(found.where(~F.col("stays")).drop("stays"), same, "left_anti")
    again = found.where("stays").groupBy(p + "id", p + "version").count().where("count > 1").drop("count")
    again = common.written(again, "repeats")
    if not again.isEmpty():
        again = common.small(again)
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", p + "own"]))
    return rows.select(*common.own_columns(docs))
