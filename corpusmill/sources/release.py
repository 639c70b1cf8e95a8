"""Releases: six partitions of payload lines, a membership table, a manifest, and a marker that comes last (K1-K5)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES, PARTITIONS, LABEL = ("base", "chat"), ("train", "validation", "test"), "corpusmill release 1"


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, name: str, text: str) -> None:
    p, fs = _path(spark, name)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def hashes(spark: SparkSession, path: str) -> dict[str, list]:
    """Per partition: payload files' SHA-256 digests in order of their names, and lines that aren't blank."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").option("recursiveFileLookup", True).load(f"{path}/data")
    lines = F.size(F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: x != ""))
    rows = rows.select(F.regexp_extract("path", r"stage=(\w+)/partition=(\w+)/", 1).alias("s"), F.regexp_extract("path", r"stage=(\w+)/partition=(\w+)/", 2).alias("p"), F.regexp_extract("path", r"part-(\d+)", 1).alias("n"), F.sha2("content", 256).alias("h"), lines.alias("lines"))
    out = {f"{s}/{p}": [[], 0] for s in STAGES for p in PARTITIONS}
    for r in rows.orderBy("s", "p", "n", "h").collect():  # a row for each file
        out[f"{r['s']}/{r['p']}"][0].append(r["h"])
        out[f"{r['s']}/{r['p']}"][1] += r["lines"]
    return out


def membership_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of the membership table's files, in order of their names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/membership").select("path", F.sha2("content", 256).alias("h"))
    return hashlib.sha256("".join(r["h"] for r in rows.orderBy("path").collect()).encode()).hexdigest()  # a row for each file


def publish(records: DataFrame, path: str, seed: int, facts: dict | None = None) -> dict:
    """Writes records (stage, partition, position, payload, node, duplicate) as a new release, in order of position.

    The path must be new. Retained payloads go to data/, every record to
    membership/; the manifest holds counts, digests and the facts given;
    COMPLETE, with the manifest's digest, is written when all else has
    succeeded.
    """
    spark = records.sparkSession
    kept = records.where("not duplicate").repartitionByRange("stage", "partition", "position").sortWithinPartitions("stage", "partition", "position")
    kept.select("stage", "partition", F.col("payload").alias("value")).write.mode("error").partitionBy("stage", "partition").text(f"{path}/data")
    records.drop("payload").write.mode("error").parquet(f"{path}/membership")
    found, members = hashes(spark, path), membership_digest(spark, path)
    manifest = json.dumps({**(facts or {}), "schema_version": 1, "seed": seed, "files": found, "membership_sha256": members}, sort_keys=True, indent=1)
    put(spark, f"{path}/manifest.json", manifest)
    put(spark, f"{path}/COMPLETE", f"{LABEL}\n{hashlib.sha256(manifest.encode()).hexdigest()}\n")
    return json.loads(manifest)


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest of a complete release whose payloads are what it says; else an error."""
    p, fs = _path(spark, f"{path}/COMPLETE")
    if not fs.exists(p):
        raise ValueError(f"{path} isn't complete")
    read = lambda name: spark.read.text(f"{path}/{name}", wholetext=True).first()[0]
    manifest, marker = read("manifest.json"), read("COMPLETE").split("\n")
    if marker[:2] != [LABEL, hashlib.sha256(manifest.encode()).hexdigest()]:
        raise ValueError(f"the manifest of {path} isn't the one that was published")
    known = json.loads(manifest)
    if known["files"] != hashes(spark, path) or known["membership_sha256"] != membership_digest(spark, path):
        raise ValueError(f"payloads of {path} have changed")
    return json.loads(manifest)


def partition(spark: SparkSession, path: str, stage: str, part: str) -> DataFrame:
    """One partition's payload lines; the others aren't read."""
    verify(spark, path)
    return spark.read.text(f"{path}/data/stage={stage}/partition={part}")
