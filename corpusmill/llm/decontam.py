"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every WINDOW consecutive words a document keeps the k-gram with the least
hash (winnowing). Two texts that share WINDOW words share the k-gram kept
there, so no shared span of that length is missed. Kept k-grams are joined
with the benchmark's; each hit is extended to its whole window, whose words
are compared with the benchmark's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common

WINDOW, GRAM = 13, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def _grams(words: Column) -> Column:
    """Hashes of the k-grams at every position; empty if there are fewer words."""
    n = F.size(words) - (GRAM - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, GRAM)))).otherwise(F.array().cast("array<bigint>"))


def _kept(start: Column) -> Column:
    """Winnowing: the least k-gram hash of the window of WINDOW words at `start`; null where there is no such window."""
    span = WINDOW - GRAM + 1
    inside = (start >= 0) & (start <= F.size("_grams") - span)
    return F.when(inside, F.least(*[F.get("_grams", start + k) for k in range(span)]))


def _starts(first: int) -> Column:
    """Starts of a text's windows, from `first`; -1 stands for the text itself."""
    return F.sequence(F.lit(first), F.greatest(F.size("_grams") - (WINDOW - GRAM + 1), F.lit(first)))


def _text(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, F.lit(n) if isinstance(n, int) else n), " ")


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, window): all windows of an item, of WINDOW words each, or one of all its words if it has fewer.

    Null and wordless items have none; a null item_id counts as "".
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    n = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    rows = items.where(F.size("words") > 0).select("item_id", "words", n.alias("n"), F.explode(starts).alias("start"))
    return rows.select("item_id", "n", _text(F.col("words"), F.col("start"), F.col("n")).alias("window")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, _version (hash of the text), n_words, n_hit, items (sorted array of item ids).

    Documents are read once, and once more if some item has fewer words than a window.
    """
    pairs = common.written(windows_of(benchmark).withColumn("wid", F.md5("window")), "windows")
    texts = pairs.select("n", "window", "wid").distinct()
    words = docs.select("doc_id", F.xxhash64("text").alias("_version"), words_of(F.col("text")).alias("words"))

    # Full windows. Each text also has the row -1, which carries its number of words.
    full = texts.where(F.col("n") == WINDOW)
    kept = full.select(F.split("window", " ").alias("words")).withColumn("_grams", _grams(F.col("words")))
    kept = kept.select(_kept(F.lit(0)).alias("_kept")).distinct().withColumn("_near", F.lit(True))
    each = words.withColumn("_grams", _grams(F.col("words"))).select("doc_id", "_version", F.size("words").alias("n_words"), "words", "_grams")
    if common.is_small(kept):
        each = each.withColumn("_start", F.explode(_starts(-1))).withColumn("_kept", _kept(F.col("_start")))
        each = each.join(F.broadcast(kept), "_kept", "left").where((F.col("_start") < 0) | F.col("_near"))
    else:  # the kept hashes alone are shuffled; then each text gets those that it shares
        own = each.select("doc_id", "_version", F.explode(F.array_distinct(F.transform(_starts(0), _kept))).alias("_kept"))
        own = own.join(kept, "_kept", "left_semi").groupBy("doc_id", "_version").agg(F.collect_set("_kept").alias("_shared"))
        own = own.withColumnsRenamed({"doc_id": "_id", "_version": "_v"})
        each = each.join(own, each["doc_id"].eqNullSafe(own["_id"]) & each["_version"].eqNullSafe(own["_v"]), "left")
        each = each.withColumn("_start", F.explode(_starts(-1)))
        each = each.where((F.col("_start") < 0) | F.array_contains("_shared", _kept(F.col("_start"))))
    # No window equals what stands in for one in the row -1: each text's own, so that they aren't one hot key of the join below.
    own = F.concat(F.lit("\0"), F.hex(F.xxhash64("doc_id", "_version")))
    window = F.when(F.col("_start") >= 0, _text(F.col("words"), F.col("_start"), WINDOW)).otherwise(own)
    rows = each.select("doc_id", "_version", "n_words", "_start", F.lit(WINDOW).alias("n"), window.alias("window"))

    # Items of fewer words, by their first word and then all of them.
    short = texts.where(F.col("n") < WINDOW)
    if not short.isEmpty():
        first = short.select(F.xxhash64(F.substring_index("window", " ", 1)).alias("_first"), "n").distinct()
        each = words.select("doc_id", "_version", "words", F.posexplode("words").alias("_start", "_word"))
        each = each.withColumn("_first", F.xxhash64("_word")).join(common.small(first), "_first").where(F.col("_start") + F.col("n") <= F.size("words"))
        window = _text(F.col("words"), F.col("_start"), F.col("n"))
        rows = rows.unionByName(each.select("doc_id", "_version", F.size("words").alias("n_words"), "_start", "n", window.alias("window")))

    rows = rows.join(common.small(texts), ["n", "window"], "left").where((F.col("_start") < 0) | F.col("wid").isNotNull())
    hit = F.when(F.col("wid").isNotNull(), F.struct("_start", (F.col("_start") + F.col("n")).alias("end"), "wid"))
    found = rows.groupBy("doc_id", "_version").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"))
    found = common.written(found, "matches")

    # Hit words: the union of the windows' ranges, in order of their starts.
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(
        "hits",
        zero,
        lambda acc, r: F.struct(F.greatest(acc["to"], r["end"]).alias("to"), (acc["n"] + F.greatest(r["end"] - F.greatest(acc["to"], r["_start"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    wids = found.where(F.size("hits") > 0).select("doc_id", "_version", F.explode(F.array_distinct(F.col("hits.wid"))).alias("wid"))
    listed = wids.join(common.small(pairs.select("wid", "item_id")), "wid").groupBy(F.col("doc_id").alias("_id"), F.col("_version").alias("_v"))
    listed = listed.agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = found["doc_id"].eqNullSafe(listed["_id"]) & found["_version"].eqNullSafe(listed["_v"])
    items = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return found.join(listed, same, "left").select("doc_id", "_version", "n_words", union.alias("n_hit"), items)


def contaminated() -> Column:
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean. Rows that repeat both
    doc_id and text give one row; different texts under one id give one each.
    Null ids are kept. An empty benchmark leaves all documents clean; an empty
    documents table gives an empty result. Extra columns are ignored.
    """
    found = matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, whatever their names, that aren't contaminated.

    Null and empty texts stay; rows that repeat stay or go together; texts of
    one id are judged one by one. An empty table gives an empty result.
    """
    found = matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    p = common.free_prefix(docs)
    bad = found.where(contaminated()).select(F.col("doc_id").alias(p + "id"), F.col("_version").alias(p + "bad"))
    same = F.col("doc_id").eqNullSafe(F.col(p + "id")) & F.col(p + "own").eqNullSafe(F.col(p + "bad"))
    return docs.withColumn(p + "own", F.xxhash64("text")).join(bad, same, "left_anti").select(*common.own_columns(docs))
