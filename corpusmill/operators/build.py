"""A corpus from recipe to release: sources, mapping, families, split, publication.

The recipe is a small driver object. Rows of all sources are one DataFrame
with their places in the recipe (source, file, row), so every "first" is the
first in recipe order however the rows are dealt.
"""

from __future__ import annotations

import json
import math
import re
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.names import matching, safe_glob, safe_relative
from corpusmill.functions.text import is_blank, normalized
from corpusmill.operators import chat, components, dedup, split
from corpusmill.operators.contracts import ContractError, Limits, require
from corpusmill.shared import written
from corpusmill.sources import release, scans

FORMATS, PARTITIONS, STAGES = ("jsonl", "json", "parquet"), release.PARTITIONS, release.STAGES
#: What a mapping of each kind must and may say.
MAPPINGS = {"text": ({"column"}, set()), "messages": ({"column"}, {"role_field", "content_field", "user_role", "assistant_role", "system_role"}), "instruction": ({"prompt_column", "response_column"}, {"input_column", "system"})}


class RecipeError(ValueError):
    """A recipe that can't be meant."""


def _say(ok: bool, problem: str) -> None:
    if not ok:
        raise RecipeError(problem)


@dataclass(frozen=True)
class Source:
    """Files of one folder, how to read them, and what of a row becomes a record."""

    id: str
    files: tuple[str, ...]
    format: str
    mapping: Mapping[str, str]
    language: str
    permitted_use: str
    repo: str = "."
    partition: str | None = None
    group: str | None = None
    group_column: str | None = None
    group_namespace: str | None = None

    def __post_init__(self):
        _say(bool(re.fullmatch(r"[A-Za-z0-9_-]+", self.id)), f"source id {self.id!r} needs letters, digits, - or _")
        safe_relative(self.id)
        if self.repo != ".":
            safe_relative(self.repo)
        _say(bool(self.files), f"{self.id}: no files")
        for g in self.files:
            safe_glob(g)
        _say(self.format in FORMATS, f"{self.id}: format {self.format!r} isn't one of {', '.join(FORMATS)}")
        _say(self.partition in (None, *PARTITIONS), f"{self.id}: partition {self.partition!r}")
        _say(bool(self.language.strip() and self.permitted_use.strip()), f"{self.id}: language and permitted_use must be told")
        _say(self.group is None or self.group_column is None, f"{self.id}: group and group_column exclude each other")
        _say(all(x is None or x.strip() for x in (self.group, self.group_column, self.group_namespace)), f"{self.id}: a blank group setting")
        kind = self.mapping.get("kind")
        _say(kind in MAPPINGS, f"{self.id}: mapping kind {kind!r}")
        must, may = MAPPINGS[kind]
        given = set(self.mapping) - {"kind"}
        _say(must <= given <= must | may, f"{self.id}: a {kind} mapping takes {sorted(must)}, perhaps {sorted(may)}")
        _say(all(isinstance(v, str) and v for v in self.mapping.values()), f"{self.id}: empty mapping fields")
        _say(kind != "instruction" or bool(self.mapping.get("system", "x").strip()), f"{self.id}: a blank system text")
        if kind == "messages":
            _say(len({self.mapping.get(f"{r}_role", r) for r in chat.ROLES}) == 3, f"{self.id}: role names must differ")


@dataclass(frozen=True)
class Recipe:
    """Sources in order, the split, and what the build may take in."""

    output: str
    sources: tuple[Source, ...]
    seed: int = 0
    ratios: tuple[float, float, float] = (0.9, 0.05, 0.05)
    limits: Limits = field(default_factory=Limits)
    schema_version: int = 1

    def __post_init__(self):
        _say(self.schema_version == 1, "schema_version must be 1")
        _say("/" not in safe_relative(self.output), "output must be one new folder")
        _say(0 <= self.seed < 2**64, "seed must fit 64 bits")
        _say(len(self.ratios) == 3 and all(math.isfinite(r) and 0 <= r <= 1 for r in self.ratios) and abs(sum(self.ratios) - 1) < 1e-10, "ratios must be finite, not negative, and sum to 1")
        _say(self.ratios[0] > 0, "some rows must go to train")
        _say(bool(self.sources), "no sources")
        ids = [s.id.lower() for s in self.sources]
        _say(len(set(ids)) == len(ids), "source ids must differ, whatever their case")

    @classmethod
    def read(cls, text: str) -> Recipe:
        """From TOML; unknown fields are errors."""
        try:
            raw = tomllib.loads(text)
            parts = raw.pop("split", {})
            ratios = tuple(float(parts.pop(p, d)) for p, d in zip(PARTITIONS, (0.9, 0.05, 0.05), strict=True))
            _say(not parts, f"unknown split fields {sorted(parts)}")
            sources = tuple(Source(**{**s, "files": tuple(s.get("files", ()))}) for s in raw.pop("sources", ()))
            return cls(sources=sources, ratios=ratios, limits=Limits(**raw.pop("limits", {})), **raw)
        except (TypeError, tomllib.TOMLDecodeError) as e:
            raise RecipeError(str(e)) from e

    def locked(self, files: Mapping[str, list[str]]) -> str:
        """The recipe as JSON with the files that were found in place of globs, so that it can be run again."""
        out = asdict(self)
        for s in out["sources"]:
            s["files"] = files[s["id"]]
        return json.dumps(out, sort_keys=True, indent=1)


def listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path below root, bytes) of each file; a local folder, or any that Hadoop's file systems know, in a hub's place."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(base)
    found, out = fs.listFiles(base, True), []
    while found.hasNext():
        f = found.next()
        path = f.getPath().toUri().getPath()[len(base.toUri().getPath()) :].lstrip("/")
        if not any(p.startswith((".", "_")) for p in path.split("/")):
            out.append((path, int(f.getLen())))
    return sorted(out)


def rows_of(spark: SparkSession, root: str, source: Source, files: list[str]) -> DataFrame:
    """(file, row_no, and the mapped columns) of a source's files."""
    m = source.mapping
    wanted = {m[k] for k in ("column", "prompt_column", "response_column", "input_column") if k in m} | ({source.group_column} - {None})
    columns, path = sorted(wanted), f"{root.rstrip('/')}/{source.repo}".removesuffix("/.")

    def short(rows: DataFrame) -> DataFrame:
        tail = F.col("file")
        for f in files:
            tail = F.when(F.col("file").endswith("/" + f), f).otherwise(tail)
        return rows.withColumn("file", tail)

    parts = []
    for f in files:
        at = f"{path}/{f}"
        if source.format == "parquet":
            parts.append(scans.parquet(spark, at, columns))
        elif m["kind"] == "messages":
            parts.append(_json_messages(spark, at, source, columns))
        else:
            optional = {m["input_column"]} if "input_column" in m else set()
            parts.append((scans.jsonl if source.format == "jsonl" else scans.json_array)(spark, at, columns, optional=optional))
    return short(reduce(DataFrame.unionByName, parts))


def _json_messages(spark: SparkSession, path: str, source: Source, columns: list[str]) -> DataFrame:
    role, content = source.mapping.get("role_field", "role"), source.mapping.get("content_field", "content")
    rows = scans.lines(spark, path).select("file", "row_no", F.try_parse_json("line").alias("value")) if source.format == "jsonl" else scans.array_items(spark, path)
    shape = f"array<struct<`{role}`:string,`{content}`:string>>"
    fields = [F.try_variant_get("value", f"$.{c}", shape if c == source.mapping["column"] else "string").alias(c) for c in columns]
    out = rows.select("file", "row_no", *fields)
    return require(out, {f"{source.id}: {c} is missing": F.col(c).isNull() for c in columns}, "file", "row_no")


def mapped(rows: DataFrame, source: Source, ordinal: int) -> DataFrame:
    """(id, place, stage, payload, digest, keys, group): a source's rows as records; blank texts have a null payload."""
    m, stage = source.mapping, "base" if source.mapping["kind"] == "text" else "chat"
    rows = rows.select("*", F.concat(F.lit(source.id + "/"), "file", F.lit("#row-"), F.col("row_no").cast("string")).alias("id"))
    if stage == "base":
        norm = normalized(F.col(m["column"]))
        rows = rows.withColumn("_norm", norm)
        usable = ~is_blank(F.col("_norm"))
        payload, digest, texts = F.to_json(F.struct(F.col(m["column"]).alias("text"))), dedup.digest(F.col("_norm")), F.array(F.sha2("_norm", 256))
    else:
        rows = rows.withColumn("_messages", _messages(source))
        usable = F.lit(True)
        require(rows, {f"{source.id}: not a conversation of known roles": ~chat.is_valid(F.col("_messages"))}, "id")
        payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.transform("_messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
        digest, texts = chat.identity(F.col("_messages")), chat.overlap_hashes(F.col("_messages"))
    space = source.group_namespace or source.repo
    group = F.lit(None).cast("string")
    if source.group_column or source.group:
        group = F.to_json(F.array(F.lit(space), F.concat(F.lit("string:"), F.col(source.group_column) if source.group_column else F.lit(source.group))))
    place = F.struct(F.lit(ordinal).alias("source"), "file", F.col("row_no").cast("long").alias("row"))
    rows = rows.select("id", place.alias("place"), F.lit(stage).alias("stage"), F.when(usable, payload).alias("payload"), digest.alias("digest"), texts.alias("texts"), group.alias("group"), F.lit(source.partition).cast("string").alias("fixed"))
    keys = F.concat(F.array(F.concat(F.lit("record:"), "digest")), F.transform("texts", lambda t: F.concat(F.lit("text:"), t)), F.when(F.col("group").isNotNull(), F.array(F.concat(F.lit("group:"), "group"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("keys", keys).drop("texts")


def _messages(source: Source) -> Column:
    m = source.mapping
    if m["kind"] == "instruction":
        return chat.instruction(F.col(m["prompt_column"]), F.col(m["response_column"]), F.col(m["input_column"]) if "input_column" in m else None, m.get("system"))

    def role(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in chat.ROLES:
            out = F.when(x == m.get(f"{name}_role", name), name).otherwise(out)
        return out

    return F.transform(m["column"], lambda x: F.struct(role(x[m.get("role_field", "role")]).alias("role"), x[m.get("content_field", "content")].alias("content")))


def assign(records: DataFrame, seed: int, ratios: tuple[float, float, float]) -> DataFrame:
    """records (as of mapped(), blank ones left out) with component, anchor, partition, duplicate_of and output_row.

    Records that share a key are a family, and a family stays in one
    partition: a fixed one, or the one that its least digest draws. Of equal
    records of a stage the first in recipe order is kept.
    """
    keys = written(records.select(F.col("id").alias("node"), F.explode("keys").alias("key")), "keys")
    labels = components.components(components.star_edges(keys))
    found = written(records.join(labels, records["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node", "keys"), "families")
    families = found.groupBy("component").agg(F.min("digest").alias("anchor"), F.min("fixed").alias("fixed"), F.max("fixed").alias("other"))
    if bad := families.where("fixed != other").select("component", "fixed", "other").limit(3).collect():
        raise ContractError(f"fixed partition conflict in families {[tuple(r) for r in bad]}")
    families = families.select("component", "anchor", F.coalesce("fixed", split.partition_of(F.col("anchor"), seed, ratios[0], ratios[1])).alias("partition"))
    first = found.groupBy("stage", "digest").agg(F.min(F.struct("place", "id")).alias("first"))
    found = found.drop("fixed").join(families, "component").join(first, ["stage", "digest"])
    found = found.withColumn("duplicate_of", F.when(F.col("first.id") != F.col("id"), F.col("first.id"))).drop("first")
    return numbered(written(found, "assigned"))


def numbered(found: DataFrame) -> DataFrame:
    """With output_row: the place among the kept records of a stage and partition, from 1; null for duplicates."""
    from corpusmill.operators.sequences import running_total

    order = F.struct("stage", "partition", "place")
    kept = running_total(found.where("duplicate_of is null").select(order.alias("at"), F.lit(1).alias("one")), "at", "one").select("at.*", "before")
    start = kept.groupBy("stage", "partition").agg(F.min("before").alias("start"))
    kept = kept.join(F.broadcast(start), ["stage", "partition"]).select(F.col("place").alias("_place"), (F.col("before") - F.col("start") + 1).alias("output_row"))
    return found.join(kept, found["place"] == kept["_place"], "left").drop("_place")


def counters(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """(records_seen, blank_records, duplicates_removed, retained) (A2)."""
    seen = records.agg(F.count("*").alias("records_seen"), F.count_if(F.col("payload").isNull()).alias("blank_records"))
    gone = assigned.agg(F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates_removed"), F.count_if(F.col("duplicate_of").isNull()).alias("retained"))
    return seen.join(gone)  # a row each


def partition_counts(assigned: DataFrame) -> dict[str, int]:
    """Kept records by stage and partition, zeros too (A1)."""
    n = {(r["stage"], r["partition"]): r["count"] for r in assigned.where("duplicate_of is null").groupBy("stage", "partition").count().collect()}
    return {f"{s}/{p}": n.get((s, p), 0) for s in STAGES for p in PARTITIONS}


def require_filled(counts: Mapping[str, int], ratios: tuple[float, float, float]) -> None:
    """Each stage that has records has some in every partition that is to get any (A5); families aren't broken up for it."""
    for s in STAGES:
        if any(counts[f"{s}/{p}"] for p in PARTITIONS):
            for p, ratio in zip(PARTITIONS, ratios, strict=True):
                if ratio > 0 and not counts[f"{s}/{p}"]:
                    raise ContractError(f"{s}/{p} is empty: add independent groups, fix partitions, or change ratios or seed")


def build(spark: SparkSession, root: str, recipe: Recipe, target: str) -> dict:
    """Builds and publishes a release below target; returns its manifest. A failed build leaves no marker."""
    files, parts, sizes = {}, [], []
    for i, source in enumerate(recipe.sources):
        where = f"{root.rstrip('/')}/{source.repo}".removesuffix("/.")
        there = dict(listed(spark, where))
        files[source.id] = matching(there, source.files)
        sizes += [(f"{source.id}/{f}", there[f]) for f in files[source.id]]
        parts.append(mapped(rows_of(spark, root, source, files[source.id]), source, i))
    recipe.limits.check_files(sizes)
    records = written(reduce(DataFrame.unionByName, parts), "records")
    usable = recipe.limits.check(records).where("payload is not null")
    if usable.isEmpty():
        raise ContractError("no record that isn't blank")
    assigned = written(assign(usable, recipe.seed, recipe.ratios), "assigned")
    require_filled(partition_counts(assigned), recipe.ratios)
    out = assigned.select("stage", "partition", F.col("place").alias("position"), "payload", F.col("id").alias("node"), F.col("duplicate_of").isNotNull().alias("duplicate"), F.col("group").alias("source_group"), F.col("anchor").alias("connected_group"), F.col("digest").alias("normalized_sha256"), F.sha2("payload", 256).alias("payload_sha256"), "duplicate_of", "output_row")
    facts = {"lock": json.loads(recipe.locked(files)), **counters(records, assigned).first().asDict()}
    return release.publish(out, f"{target.rstrip('/')}/{recipe.output}", recipe.seed, facts)
