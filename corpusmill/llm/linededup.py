"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard, union-find over lines.

Lines that are equal after trimming, lower-casing and collapsing blanks are one
class, by a 128-bit hash, whose halves are key and check. Each class has SHINGLE-character
shingles (a shorter line is one shingle); links of at least 0.8 Jaccard
similarity between classes are proposed by BANDS bands of ROWS MinHash values
(a pair at 0.8 is missed with probability (1 - 0.8**4)**30, or 1.4e-7) and
confirmed on whole sets. Of each component of links one line stays: the first
by doc_id, then position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common, similar

SHINGLE, BANDS, ROWS, SEED = 7, 30, 4, 31  # shingles() makes sevens
#: Letters of the lines that are read together, and of those that are hashed together, which stay in the cache.
LETTERS, HASHED = 1 << 19, 1 << 16
#: What counts as a blank beside it.
ODD = "\t\r\x0b\f"


def normal(text: str) -> list[str]:
    """The lines of a text, lower-cased and trimmed, their inner blanks and tabs collapsed; by position, so with the blank ones."""
    text = text.lower()
    for c in ODD:
        if c in text:
            text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    if " \n" in text or "\n " in text:
        text = text.replace(" \n", "\n").replace("\n ", "\n")
    return text.strip(" ").split("\n")


def hashes(lines: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each line, key and check, as columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[str]]]:
    """Of batches (..., text) the lines that aren't blank, some LETTERS at a time: the batch, their rows in it, positions and normal forms."""
    for batch in batches:
        rows, at, lines, letters = [], [], [], 0
        for r, text in enumerate(batch.column(batch.num_columns - 1)):
            text = text.as_py()
            if not text:
                continue
            own = normal(text)
            if len(text) < LETTERS and all(own):
                rows += [r] * len(own)
                at += range(len(own))
                lines += own
                letters += len(text)
                if letters >= LETTERS:
                    yield batch, rows, at, lines
                    rows, at, lines, letters = [], [], [], 0
                continue
            for i, line in enumerate(own):
                if line:
                    rows.append(r), at.append(i), lines.append(line)
                    letters += len(line)
                    if letters >= LETTERS:
                        yield batch, rows, at, lines
                        rows, at, lines, letters = [], [], [], 0
        if lines:
            yield batch, rows, at, lines


FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(FACTORS[2])
    h ^= h >> np.uint64(29)
    return h


def _sevens(x: np.ndarray) -> np.ndarray:
    """A hash of the seven letters from each place on: of two, then of four, then of four, two and one."""
    two = x[:-1] * np.uint64(FACTORS[0])
    two += x[1:]
    h = two[:-2] * np.uint64(FACTORS[1])
    h += two[2:]
    h = h[: len(x) - 6] * np.uint64(FACTORS[2])
    h += two[4 : len(x) - 2]
    h *= np.uint64(FACTORS[0])
    h += x[6:]
    return _finished(h)


def _short(letters: np.ndarray) -> np.ndarray:
    """A hash of each column of letters, of which there are fewer than seven."""
    h = np.full(letters.shape[1], len(letters), np.uint64)
    for row in letters:
        h *= np.uint64(FACTORS[0])
        h += row
    return _finished(h)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' shingles, in order and with repeats, one line after the other, and how many each has. No line is empty."""
    joined = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(x) for x in lines], np.int64)
    starts, inside = np.cumsum(n) - n, np.ones(len(joined), bool)
    values, most = np.zeros(len(joined), np.uint64), len(joined) - SHINGLE + 1
    if most > 0:
        values[:most] = _sevens(joined)
    for j in range(1, SHINGLE):  # what begins in a line's last few letters runs into the next line
        inside[(starts + n - j)[n >= j]] = False
    for k in range(1, SHINGLE):
        at = starts[n == k]
        if len(at):
            values[at] = _short(joined[at[None, :] + np.arange(k)[:, None]])
            inside[at] = True
    return values[inside], np.maximum(n - SHINGLE + 1, 1)


def signatures(lines: list[str]) -> np.ndarray:
    """A row of 16-bit values for each line."""
    a, _ = similar.signature_tables(BANDS * ROWS, SEED)
    ends, at, out = np.cumsum([len(x) for x in lines]), 0, []
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHED, side="right")))
        out.append(similar.short_form(similar.many_minima(*shingles(lines[at:to]), a)))
        at = to
    return np.concatenate(out) if out else np.zeros((0, BANDS * ROWS), np.uint16)


def line_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return shingles([x.decode() for x in lines])


def _places(docs: DataFrame) -> DataFrame:
    """(key, check, doc_id, version, at): the lines of docs; version: a hash of the text. The first of each block that is read also has keys and values, the block's distinct lines and their signatures, so that one scan gives both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, at, lines in _blocks(batches):
            digest, of = hashes([x.encode("utf-8", "surrogatepass") for x in lines]), pa.array(row)
            key, first = np.unique(digest[:, 0], return_index=True)
            none = [None] * (len(lines) - 1)
            columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32())]
            columns += [pa.array([x, *none], pa.binary()) for x in (key.astype("<i8").tobytes(), signatures([lines[i] for i in first]).tobytes())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "check", "doc_id", "version", "at", "keys", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(rows, f"key long, check long, doc_id {kind}, version long, at int, keys binary, values binary")


def _lines(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, check, members): the normal forms of the lines whose keys are needed. Of two lines with one key, should there be any, one is taken."""
    wanted = common.Keys(needed)
    test = wanted.test()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, lines in _blocks(batches):
            texts = [x.encode("utf-8", "surrogatepass") for x in lines]
            digest = hashes(texts)
            key, first = np.unique(digest[:, 0], return_index=True)
            hit = test(key)
            first = first[hit]
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(digest[first, 1]), pa.array([texts[i] for i in first], pa.binary())], names=["key", "check", "members"])

    found = wanted.only(docs.select("text").mapInArrow(rows, "key long, check long, members binary"))
    found = found.groupBy("key").agg(F.min(F.struct("check", "members")).alias("line"))
    return common.written(found.select("key", "line.check", "line.members"), "lines")


def duplicate_lines(docs: DataFrame, percent: int = 80, slack: float | None = similar.SLACK) -> DataFrame:
    """(doc_id, version, gone): positions of the lines that go, a set, per distinct text with its id that has any. slack: of similar.components()."""
    places = common.written(_places(docs), "places")
    chosen: list[DataFrame] = []

    def sets(needed: DataFrame) -> DataFrame:  # as text, which is an eighth of the size of its hashed set
        chosen.append(_lines(docs, needed))
        return chosen[0]

    _, found = similar.components(places.where("keys is not null").select("keys", "values"), sets, percent, BANDS * ROWS, ROWS, line_sets, slack)
    found = common.written(found.select(F.col("node").alias("key"), "component").join(chosen[0].select("key", "check"), "key"), "found")
    common.forget(chosen[0])

    # Lines that occur once and have no link stay, and aren't looked at again.
    counts = places.groupBy("key", "check").agg(F.count("*").alias("n")).join(found, ["key", "check"], "left").where("n > 1 or component is not null")
    group = F.struct(F.coalesce("component", "key").alias("component"), F.when(F.col("component").isNull(), F.col("check")).alias("alone"))
    touched = common.written(counts.select("key", "check", group.alias("group")), "touched")
    rows = places.select("key", "check", F.struct("doc_id", "version", "at").alias("place")).join(common.small(touched), ["key", "check"])
    rows = common.written(rows.select("group", "place"), "touched-places")
    best = rows.groupBy("group").agg(F.min("place").alias("stays"))  # combined on the map side, so hot lines cost a row a task
    gone = rows.join(common.small(best), "group").where("place != stays").select("place.*")
    out = common.written(gone.groupBy("doc_id", "version").agg(F.collect_set("at").alias("gone")), "gone-lines")
    common.forget(places)
    return out


def _without(text: Column, gone: Column) -> Column:
    parts = F.split(text, "\n")
    return F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone, i)), "\n")


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _rewritten(docs: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """docs, and text, n_lines and n_kept as they are without its duplicate lines, under a prefix."""
    found, p = duplicate_lines(docs.select("doc_id", "text"), percent), common.free_prefix(docs)
    few = common.is_small(found.select(F.explode("gone")), common.BROADCAST_KEYS)  # its size is that of the lists
    found = found.select(F.col("doc_id").alias(p + "id"), F.col("version").alias(p + "version"), F.col("gone").alias(p + "gone"))
    lines = F.size(F.filter(_parts(F.col("text")), lambda x: F.ltrim(x, F.lit(" " + ODD)) != ""))
    rows = docs.withColumns({p + "own": F.xxhash64("text"), p + "lines": lines.cast("long")})
    rows = rows.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col(p + "id")) & (F.col(p + "own") == F.col(p + "version")), "left")
    gone = F.when(F.col(p + "gone").isNull(), F.lit(0)).otherwise(F.size(p + "gone"))
    text = F.when(gone > 0, _without(F.col("text"), F.col(p + "gone"))).otherwise(F.col("text"))
    return rows.withColumns({p + "text": text, p + "n_lines": F.col(p + "lines"), p + "n_kept": F.col(p + "lines") - gone}), p


def without_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with text, n_lines and n_kept (lines that aren't blank), its duplicate lines taken out.

    Texts without duplicates are unchanged, byte for byte; blank lines stay.
    Null and empty texts have no lines. Rows that repeat doc_id and text are
    one document and keep the same lines; a null id sorts first. Other columns
    stay as they are, but columns named n_lines and n_kept are replaced; an
    empty table gives an empty result.
    """
    extra = ["n_lines", "n_kept"]
    out, p = _rewritten(docs, percent)
    own = [c for c, name in zip(common.own_columns(docs, text=F.col(p + "text")), docs.columns, strict=True) if name not in extra]
    return out.select(*own, *[F.col(p + c).alias(c) for c in extra])


def clean(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The columns of docs, whatever their names, with new text and n_chars; documents whose lines are all repeats of kept ones go.

    Texts without a line, null and empty ones too, stay; rows that repeat stay
    or go together, and an empty table gives an empty result.
    """
    out, p = _rewritten(docs, percent)
    changed = {"text": F.col(p + "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(p + "text").cast(docs.schema["n_chars"].dataType)
    return out.where((F.col(p + "n_lines") == 0) | (F.col(p + "n_kept") > 0)).select(*common.own_columns(docs, **changed))


def report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_kept (lines that aren't blank) and text_sha256 of what stays (of "" for null).

    Repeated rows give repeated results, null and empty texts have no lines,
    extra columns are ignored, and an empty table gives an empty result.
    """
    out = without_duplicates(docs.select("doc_id", "text"), percent)
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
