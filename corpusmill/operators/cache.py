"""Token caches: tokenised documents as a table with a manifest that tells whether it is stale."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.strict_json import canonical
from corpusmill.operators.sequences import chunks, numbered_examples
from corpusmill.sources.release import put

LABEL, VERSION = "corpusmill cache 1", 1


def fingerprint(tokens: Column) -> Column:
    """SHA-256 of a text's ids as little-endian unsigned 32-bit numbers; of null as of none."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda ids: hashlib.sha256(np.asarray([] if ids is None else ids, "<u4").tobytes()).hexdigest())

    return of(tokens)


def ordered_identity(rows: DataFrame, order: str, *values: str) -> str:
    """SHA-256 over the count of rows and their own digests, in order: of digests, so that the driver reads 32 bytes a row, one after the other (P10)."""
    digest = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    rows = rows.select(order, digest.alias("digest"))
    out = hashlib.sha256(f"{LABEL} {rows.count()}\n".encode())
    for r in rows.orderBy(order).toLocalIterator(prefetchPartitions=True):
        out.update(bytes.fromhex(r["digest"]))
    return out.hexdigest()


def receipt(docs: DataFrame, settings: dict) -> str:
    """What a tokenizer was learned from: its settings and the digests of the texts, whatever their order; equal receipts allow its reuse."""
    n = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = n.select(F.col("h").alias("digest"), "n")
    return canonical({"settings": settings, "documents": ordered_identity(rows, "digest", "digest", "n")})


def sources_of(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes, sha256) of the texts."""
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def write(docs: DataFrame, path: str, options: dict) -> dict:
    """Writes docs (doc_id, text, partition, tokens) as a new cache and returns its manifest.

    The texts are read again and compared before the marker is written, so a
    source that changes meanwhile leaves no complete cache.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "partition", "tokens", F.size("tokens").cast("long").alias("token_count"), fingerprint(F.col("tokens")).alias("token_sha256"))
    rows.write.mode("error").partitionBy("partition").parquet(f"{path}/tokens")
    sources_of(docs).write.mode("error").parquet(f"{path}/sources")
    if stale(spark, path, docs):
        raise ValueError("a source changed while the cache was written")
    kept = spark.read.parquet(f"{path}/tokens")
    identities = {p: ordered_identity(kept.where(F.col("partition") == p), "doc_id", "doc_id", "token_sha256") for p in ("train", "validation")}
    totals = kept.agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens")).first()
    manifest = canonical({"schema_version": VERSION, "options": options, "documents": totals["documents"], "tokens": totals["tokens"] or 0, "identities": identities}, indent=1)
    put(spark, f"{path}/manifest.json", manifest)
    put(spark, f"{path}/COMPLETE", f"{LABEL}\n{hashlib.sha256(manifest.encode()).hexdigest()}\n")
    return json.loads(manifest)


def stale(spark: SparkSession, path: str, docs: DataFrame) -> list[str]:
    """Some of the doc_ids that the cache has and the documents haven't, or the other way round, or whose text differs."""
    old, new = spark.read.parquet(f"{path}/sources"), sources_of(docs)
    return [str(r["doc_id"]) for r in old.exceptAll(new).unionAll(new.exceptAll(old)).select("doc_id").distinct().orderBy("doc_id").limit(5).collect()]


def verify(spark: SparkSession, path: str, docs: DataFrame, options: dict) -> dict:
    """The manifest of a complete cache of these documents and options, whose tokens are what was written; else an error."""
    read = lambda name: spark.read.text(f"{path}/{name}", wholetext=True).first()[0]
    manifest = read("manifest.json")
    if read("COMPLETE").split("\n")[:2] != [LABEL, hashlib.sha256(manifest.encode()).hexdigest()]:
        raise ValueError("the manifest isn't the one that was written")
    manifest = json.loads(manifest)
    if manifest["options"] != json.loads(canonical(options)):
        raise ValueError(f"the cache was written with {manifest['options']}")
    if found := stale(spark, path, docs):
        raise ValueError(f"stale for documents {', '.join(found)}")
    kept = spark.read.parquet(f"{path}/tokens")
    if bad := kept.where((fingerprint(F.col("tokens")) != F.col("token_sha256")) | (F.size("tokens") != F.col("token_count"))).select("doc_id").limit(3).collect():
        raise ValueError(f"tokens changed of documents {[r['doc_id'] for r in bad]}")
    for p, identity in manifest["identities"].items():
        if ordered_identity(kept.where(F.col("partition") == p), "doc_id", "doc_id", "token_sha256") != identity:
            raise ValueError(f"documents of {p} changed")
    return manifest


def examples(spark: SparkSession, path: str, partition: str, context: int, start: int = 0) -> DataFrame:
    """(doc_id, chunk_no, example_index, ids) of a partition from example `start` on; its files alone are read."""
    docs = spark.read.parquet(f"{path}/tokens").where(F.col("partition") == partition).select("doc_id", "tokens")
    return numbered_examples(docs, context).where(F.col("example_index") >= start)


def example(spark: SparkSession, path: str, partition: str, context: int, index: int) -> list[int]:
    """The ids of one example: its document is found from counts, and its text alone is cut."""
    from corpusmill.operators.sequences import example_ranges

    docs = spark.read.parquet(f"{path}/tokens").where(F.col("partition") == partition)
    at = example_ranges(docs.select("doc_id", F.col("token_count").cast("int").alias("n_tokens")), context).where(F.lit(index).between(F.col("first"), F.col("last"))).first()
    if at is None:
        raise IndexError(index)
    row = docs.where(F.col("doc_id") == F.lit(at["doc_id"])).select(F.get(chunks(F.col("tokens"), context), F.lit(index - at["first"])).alias("ids")).first()
    return row["ids"]
