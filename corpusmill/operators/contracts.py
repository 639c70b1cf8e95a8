"""Checks of whole tables, one aggregate each: they raise with the first places that break a contract."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.metrics import not_finite


class ContractError(ValueError):
    """A table that breaks its contract; nothing is cut, dropped or coerced."""


def require(df: DataFrame, rules: Mapping[str, Column], *at: str, shown: int = 3) -> DataFrame:
    """df, if no row breaks a rule (true: broken; null counts as broken). One pass; the error names rules, counts and the first places by `at`."""
    place = F.struct(*at)
    found = df.agg(*[F.struct(F.count_if(F.coalesce(bad, F.lit(True))).alias("n"), F.min(F.when(F.coalesce(bad, F.lit(True)), place)).alias("first")).alias(f"r{i}") for i, bad in enumerate(rules.values())]).first()
    broken = [f"{name}: {r['n']} rows, first {tuple(r['first'])}" for name, r in zip(rules, found, strict=True) if r["n"]]
    if broken:
        raise ContractError("; ".join(broken[:shown]))
    return df


def documents(df: DataFrame, vocabulary: int) -> DataFrame:
    """(doc_id, tokens): two ids or more each, all in the vocabulary."""
    return require(df, {"fewer than two tokens": F.size("tokens") < 2, "ids outside the vocabulary": _outside("tokens", vocabulary)}, "doc_id")


def _outside(ids: str, vocabulary: int) -> Column:
    return F.exists(ids, lambda x: x.isNull() | (x < 0) | (x >= vocabulary))


def examples(df: DataFrame, vocabulary: int, context: int) -> DataFrame:
    """(example_index, ids, and mask if there is one): 2 to context + 1 ids in the vocabulary; a mask a value short of them, with one true at least, for all rows or for none."""
    rules = {"length": ~F.size("ids").between(2, context + 1), "ids outside the vocabulary": _outside("ids", vocabulary)}
    if "mask" in df.columns:
        masks = df.agg(F.count("mask").alias("some"), F.count("*").alias("all")).first()
        if 0 < masks["some"] < masks["all"]:
            raise ContractError(f"{masks['some']} of {masks['all']} examples have a mask")
        if masks["some"]:
            rules |= {"mask length": F.size("mask") != F.size("ids") - 1, "no target in the mask": ~F.exists("mask", lambda x: x)}
    return require(df, rules, "example_index")


def batches(df: DataFrame, batch_size: int, max_tokens: int, vocabulary: int, context: int, pad_id: int) -> DataFrame:
    """(batch_id, draw_pos, ids): at most so many rows, and so many positions when padded to the longest; nothing is cut to fit."""
    if not 0 <= pad_id < vocabulary:
        raise ContractError(f"the padding id {pad_id} is outside the vocabulary")
    require(df, {"length": ~F.size("ids").between(2, context + 1), "ids outside the vocabulary": _outside("ids", vocabulary)}, "draw_pos")
    sizes = df.groupBy("batch_id").agg(F.count("*").alias("rows"), F.max(F.size("ids") - 1).alias("longest"))
    require(sizes, {"rows in a batch": F.col("rows") > batch_size, "positions in a batch": F.col("rows") * F.col("longest") > max_tokens}, "batch_id")
    return df


def vocabulary(df: DataFrame) -> int:
    """The size of a vocabulary (token, id): its ids are 0 to size - 1, each once."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("token").alias("tokens"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if not row["n"] or row["ids"] != row["n"] or row["tokens"] != row["n"] or row["low"] != 0 or row["high"] != row["n"] - 1:
        raise ContractError(f"ids of a vocabulary must be dense: {row.asDict()}")
    return row["n"]


def finite(df: DataFrame, columns: list[str], *at: str) -> DataFrame:
    return require(df, {f"{c} isn't finite": not_finite(F.col(c).cast("double")) for c in columns}, *at)


@dataclass(frozen=True)
class Limits:
    """What a build may take in; a breach is an error, never a cut. Defaults are fixed values."""

    max_file_bytes: int = 268_435_456
    max_record_bytes: int = 1_048_576
    max_records: int = 100_000
    max_normalized_bytes: int = 536_870_912
    max_files: int = 100

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if type(value) is not int or value <= 0:
                raise ContractError(f"{f.name} must be a positive whole number")

    def check(self, records: DataFrame) -> DataFrame:
        """records (id, payload): counts and sizes in one aggregate."""
        size = F.octet_length("payload")
        row = records.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("total"), F.max(F.struct(size.alias("size"), "id")).alias("largest")).first()
        if row["n"] > self.max_records:
            raise ContractError(f"{row['n']} records exceed max_records {self.max_records}")
        if row["n"] and row["largest"]["size"] > self.max_record_bytes:
            raise ContractError(f"{row['largest']['id']} has {row['largest']['size']} bytes, max_record_bytes is {self.max_record_bytes}")
        if (row["total"] or 0) > self.max_normalized_bytes:
            raise ContractError(f"{row['total']} bytes exceed max_normalized_bytes {self.max_normalized_bytes}")
        return records

    def check_files(self, files: list[tuple[str, int]]) -> None:
        """(path, bytes) of each file."""
        if len(files) > self.max_files:
            raise ContractError(f"{len(files)} files exceed max_files {self.max_files}")
        for path, size in files:
            if size > self.max_file_bytes:
                raise ContractError(f"{path} has {size} bytes, max_file_bytes is {self.max_file_bytes}")
