"""A training-corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage works on all its predecessor kept, takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, common, decontam, linededup, neardup, quality
from corpusmill.ship import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more; it is fitted on labelled rows of docs outside the held-out fifth."""
    ship(spark)
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, nearly, an earlier document's line; those left without a line go."""
    ship(spark)
    return linededup.clean(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles, Jaccard 0.8."""
    ship(spark)
    return neardup.keep_one(docs, size=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages."""
    ship(spark)
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the bytes decoded from them."""
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("lines", fresh_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("tokens", tokens),
]

#: Trained rules and fuzzy lines have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents; each stage's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
