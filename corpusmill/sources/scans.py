"""Scans of text and chat sources with strict types and physical line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"^\s*$"


class SourceError(ValueError):
    """A source that breaks its contract; nothing is cut short or coerced."""


def _file() -> Column:
    """The file of a row, as it is named: Spark gives a URL."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of each row, with file and row_no (from 1)."""
    rows = spark.read.parquet(path)
    return rows.select(*columns, _file().alias("file"), (F.col("_metadata.row_index") + 1).alias("row_no"))


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(_file().alias("file"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str, pattern: str = "*.jsonl*", max_bytes: int = 1 << 20) -> DataFrame:
    """(file, row_no, line): the lines that aren't blank, by physical number; .gz files are expanded.

    A line of over max_bytes is an error. Files are read whole, so they must
    fit a task; the caller bounds them.
    """
    parts = F.posexplode(F.split("content", "\n")).alias("at", "line")
    rows = _whole(spark, path, pattern).select("file", parts).select("file", (F.col("at") + 1).alias("row_no"), F.regexp_replace("line", r"\r$", "").alias("line"))
    if long := rows.where(F.octet_length("line") > max_bytes).select("file", "row_no").limit(3).collect():
        raise SourceError("; ".join(f"{r['file']} line {r['row_no']}: over {max_bytes} bytes" for r in long))
    return rows.where(~F.col("line").rlike(BLANK))


def below(file: str, root: str) -> Column:
    """A file's path below root, which is found in it as plain text."""
    base = root.rstrip("/").removeprefix("file://") + "/"
    return F.expr(f"substring({file}, locate({_quoted(base)}, {file}) + {len(base)})")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _string_field(value: Column, name: str) -> Column:
    """A field that must be a JSON string: null for any other type."""
    whole = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(whole) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def _objects(rows: DataFrame, columns: list[str], optional: set[str] = frozenset()) -> DataFrame:
    """rows (file, row_no, value as variant) to string columns, or an error that names the first bad places. Optional ones may be null."""
    fields = [_string_field(F.col("value"), c).alias(c) for c in columns]
    out = rows.select("file", "row_no", *fields, F.col("value").isNull().alias("_broken"))
    missing = [F.col(c).isNull().cast("int") for c in columns if c not in optional]
    bad = out.where(F.col("_broken") | F.greatest(*missing, F.lit(0), F.lit(0)).cast("boolean"))
    if first := bad.select("file", "row_no").orderBy("file", "row_no").limit(3).collect():
        raise SourceError("; ".join(f"{r['file']} line {r['row_no']}: not an object with the strings {', '.join(columns)}" for r in first))
    return out.drop("_broken")


def jsonl(spark: SparkSession, path: str, columns: list[str], optional: set[str] = frozenset()) -> DataFrame:
    """String columns of JSON objects, one on each line that isn't blank. Numbers aren't taken for strings; other fields are ignored."""
    return _objects(lines(spark, path).select("file", "row_no", F.try_parse_json("line").alias("value")), columns, optional)


def json_array(spark: SparkSession, path: str, columns: list[str], optional: set[str] = frozenset()) -> DataFrame:
    """The same of files that are one array of objects each; row_no counts its elements from 1."""
    return _objects(array_items(spark, path), columns, optional)


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, value as variant) of such files."""
    rows = _whole(spark, path, "*.json*").select("file", F.try_parse_json("content").alias("content"))
    if first := rows.where(F.col("content").isNull() | ~F.schema_of_variant("content").startswith("ARRAY")).select("file").limit(3).collect():
        raise SourceError("; ".join(f"{r['file']}: not an array" for r in first))
    rows = rows.lateralJoin(spark.tvf.variant_explode(F.col("content").outer()))
    return rows.select("file", (F.col("pos") + 1).alias("row_no"), "value")


def text_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text): each *.txt file below root that isn't blank, by its path below root."""
    rows = _whole(spark, root, "*.txt").where(~F.col("content").rlike(r"\A\s*\z"))
    return rows.select(below("file", root).alias("doc_id"), F.col("content").alias("text"))


CHAT = "schema_version int, messages array<struct<role:string,content:string>>"


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, messages) of chat lines: exactly a schema_version of 1 and messages, which hold exactly role and content."""
    rows = lines(spark, path).select("file", "row_no", "line", F.from_json("line", CHAT).alias("c"))
    keys = F.coalesce(F.array_sort(F.json_object_keys("line")), F.array().cast("array<string>"))
    inner = F.from_json(F.get_json_object("line", "$.messages"), "array<map<string,string>>")
    exact = F.coalesce(F.forall(inner, lambda m: F.array_sort(F.map_keys(m)) == F.array(F.lit("content"), F.lit("role"))), F.lit(False))
    ok = (keys == F.array(F.lit("messages"), F.lit("schema_version"))) & F.coalesce(F.col("c.schema_version") == 1, F.lit(False)) & exact
    if first := rows.where(~ok).select("file", "row_no").orderBy("file", "row_no").limit(3).collect():
        raise SourceError("; ".join(f"{r['file']} line {r['row_no']}: not a conversation" for r in first))
    return rows.select("file", "row_no", "c.messages")
