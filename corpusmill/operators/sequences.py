"""Training sequences: overlapping chunks, example numbers, padding, sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def chunks(tokens: Column, context: int) -> Column:
    """Windows of context + 1 tokens, `context` apart, so each adjacent pair is in one of them; a text of under two has none."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.ceil((n - 1) / context).cast("int") - 1)
    many = F.transform(starts, lambda i: F.slice(tokens, i * context + 1, context + 1))
    return F.when(n >= 2, many).otherwise(F.array().cast("array<array<int>>"))


def numbered_examples(docs: DataFrame, context: int) -> DataFrame:
    """(doc_id, chunk_no, example_index, ids) of docs (doc_id, tokens), numbered in order of doc_id.

    Numbers come from a range sort of the documents' counts and the totals of
    its partitions, not from one window over all rows.
    """
    counted = docs.select("doc_id", "tokens", F.greatest(F.ceil((F.size("tokens") - 1) / context), F.lit(0)).cast("long").alias("n"))
    starts = running_total(counted.select("doc_id", "n"), "doc_id", "n").select(F.col("doc_id").alias("_id"), "before")
    rows = counted.join(starts, F.col("doc_id") == F.col("_id")).select("doc_id", "before", F.posexplode(chunks(F.col("tokens"), context)).alias("chunk_no", "ids"))
    return rows.select("doc_id", "chunk_no", (F.col("before") + F.col("chunk_no")).alias("example_index"), "ids")


def numbered_lengths(docs: DataFrame, context: int) -> DataFrame:
    """(doc_id, chunk_no, example_index, n): the examples' numbers and lengths of docs (doc_id, n_tokens), without their ids."""
    counted = docs.select("doc_id", "n_tokens", _n_chunks(F.col("n_tokens"), context).alias("n"))
    starts = running_total(counted.select("doc_id", "n"), "doc_id", "n").select(F.col("doc_id").alias("_id"), "before")
    rows = counted.where("n > 0").join(starts, F.col("doc_id") == F.col("_id")).select("doc_id", "n_tokens", "before", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    length = F.least(F.lit(context + 1), F.col("n_tokens") - F.col("chunk_no") * context)
    return rows.select("doc_id", "chunk_no", (F.col("before") + F.col("chunk_no")).alias("example_index"), length.alias("n"))


def example_ranges(docs: DataFrame, context: int) -> DataFrame:
    """(doc_id, first, last, targets): per text of docs (doc_id, n_tokens) with examples their first and last number, from counts alone."""
    counted = docs.select("doc_id", "n_tokens", _n_chunks(F.col("n_tokens"), context).alias("n"))
    starts = running_total(counted.select("doc_id", "n"), "doc_id", "n").select(F.col("doc_id").alias("_id"), "before")
    rows = counted.where("n > 0").join(starts, F.col("doc_id") == F.col("_id"))
    return rows.select("doc_id", F.col("before").alias("first"), (F.col("before") + F.col("n") - 1).alias("last"), (F.col("n_tokens") - 1).cast("long").alias("targets"))


def _n_chunks(n_tokens: Column, context: int) -> Column:
    return F.greatest(F.ceil((n_tokens - 1) / context), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with before: the sum of value over rows with a smaller order. order is unique."""
    block = df.select(F.col(order), F.col(value)).repartitionByRange(order).sortWithinPartitions(order)
    block = block.withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = block.groupBy("_part").agg(F.sum(value).alias("_total"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_offset"))
    out = block.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(offsets), "_part")
    return out.select(order, value, (F.col("_offset") + F.col("_inside")).alias("before"))


def collate(examples: DataFrame, batch_size: int, pad_id: int) -> DataFrame:
    """(batch_id, row_in_batch, inputs, targets, valid) of (draw_pos, ids): right-padded to the batch's longest input."""
    rows = examples.withColumn("batch_id", F.floor(F.col("draw_pos") / batch_size)).withColumn("row_in_batch", F.col("draw_pos") % batch_size)
    n = F.size("ids") - 1
    width = F.max(n).over(Window.partitionBy("batch_id"))  # a batch's rows
    rows = rows.withColumn("width", width).withColumn("n", n)

    def padded(first: int, value: int) -> Column:
        return F.concat(F.slice("ids", F.lit(first), F.col("n")), F.array_repeat(F.lit(value), F.col("width") - F.col("n")))

    valid = F.concat(F.array_repeat(F.lit(True), F.col("n")), F.array_repeat(F.lit(False), F.col("width") - F.col("n")))
    return rows.select("batch_id", "row_in_batch", padded(1, pad_id).alias("inputs"), padded(2, pad_id).alias("targets"), valid.alias("valid"))


# FNV-1a's start and prime, SplitMix64's step and multipliers, and the labels of seed and epoch.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
STEP, FIRST_FACTOR, SECOND_FACTOR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SEED_LABEL, EPOCH_LABEL = 0xD1B54A32D192ED03, 0x94D049BB133111EB


def mix(z):
    """SplitMix64's finaliser of a uint64, or of an array of them."""
    with np.errstate(over="ignore"):
        z = np.uint64(z) if isinstance(z, int) else z
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST_FACTOR)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND_FACTOR)
        return z ^ (z >> np.uint64(31))


def epoch_state(seed: int, epoch: int) -> int:
    return int(mix((seed & MASK) ^ SEED_LABEL) ^ mix(epoch ^ EPOCH_LABEL))


def stream(state: int, steps: np.ndarray) -> np.ndarray:
    """The generator's values after so many steps (from 1): any of them without those before."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(state) + steps.astype(np.uint64) * np.uint64(STEP))


class SplitMix:
    """The public SplitMix64 generator, one value after the other."""

    def __init__(self, state: int):
        self.state = state & MASK

    def next(self) -> int:
        self.state = (self.state + STEP) & MASK
        return int(mix(self.state))

    def below(self, n: int) -> int:
        """Uniform in range(n), without bias: values in the first, incomplete stretch are drawn again."""
        while (x := self.next()) < 2**64 % n:
            pass
        return x % n


def hashed_ranks(doc_ids: Sequence[str], seed: int) -> np.ndarray:
    """64-bit ranks: FNV-1a over the path's parts, a slash after each, mixed with the seed."""
    paths = [x.encode() + b"/" for x in doc_ids]
    size = np.array([len(x) for x in paths])
    letters = np.array(paths, dtype=bytes)
    letters = letters.view(np.uint8).reshape(len(paths), -1) if len(paths) else np.zeros((0, 0), np.uint8)
    h = np.full(len(paths), FNV_START, np.uint64)
    for i in range(letters.shape[1]):  # a column of letters at a time
        h = np.where(i < size, (h ^ letters[:, i]) * np.uint64(FNV_PRIME), h)
    return mix((h ^ np.uint64(seed & MASK)) + np.uint64(STEP))


def hashed_rank(doc_id: str, seed: int) -> int:
    return int(hashed_ranks([doc_id], seed)[0])


def ranked(docs: DataFrame, seed: int) -> DataFrame:
    """docs with rank: 16 hexadecimal digits, which sort as the unsigned number does. A null id counts as empty."""

    @F.pandas_udf("string")
    def rank(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([f"{x:016x}" for x in hashed_ranks(list(s), seed)], dtype=object)

    return docs.withColumn("rank", rank(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def validation_split(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """docs with partition: the n of the smallest rank, by a distributed top-n, are validation."""
    r = ranked(docs.select("doc_id"), seed).orderBy("rank", "doc_id").limit(n).select(F.col("doc_id").alias("_id"), F.lit("validation").alias("partition"))
    return docs.join(r, docs["doc_id"] == r["_id"], "left").drop("_id").withColumn("partition", F.coalesce("partition", F.lit("train")))


def validation_count(n: int, ratio: float | None = None, count: int | None = None) -> int:
    """Documents of the validation part; an empty part on either side is an error."""
    k = count if count is not None else int(n * (ratio or 0.0))
    if (ratio is not None or count is not None) and not 0 < k < n:
        raise ValueError(f"{k} of {n} documents can't be held out")
    return k


def epoch_order(n: int, epoch: int, seed: int) -> np.ndarray:
    """A Fisher-Yates permutation of range(n) for an epoch, on the driver; scalable_order() is its distributed stand-in."""
    rng, out = SplitMix(epoch_state(seed, epoch)), np.arange(n)
    for i in range(n - 1, 0, -1):
        j = rng.below(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def scalable_order(examples: DataFrame, epoch: int, seed: int, by: str = "example_index") -> DataFrame:
    """examples with draw_pos: their place in the order of the generator's value for their number, which no two share."""
    state = epoch_state(seed, epoch)

    @F.pandas_udf("string")
    def value(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([f"{x:016x}" for x in stream(state, s.to_numpy(np.int64) + 1)], dtype=object)

    rows = examples.withColumn("_key", value(F.col(by)))
    places = running_total(rows.select("_key", F.lit(1).alias("one")), "_key", "one").select(F.col("_key").alias("_k"), F.col("before").alias("draw_pos"))
    return rows.join(places, F.col("_key") == F.col("_k")).drop("_key", "_k")


def check_groups(groups: Sequence[tuple[Sequence[int], int]], n_examples: int | None = None) -> int:
    """The sum of the weights of groups (members, weight): they need members of their own and positive weights, and cover all examples if their number is given."""
    members = [m for g, _ in groups for m in g]
    if not groups or any(w <= 0 or not g for g, w in groups) or len(set(members)) != len(members):
        raise ValueError("groups need members of their own and positive weights")
    if n_examples is not None and set(members) != set(range(n_examples)):
        raise ValueError(f"groups must hold each of {n_examples} examples once")
    total = sum(w for _, w in groups)
    if total > MASK:
        raise ValueError("weights exceed 64 bits")
    return total


def weighted_draws(spark, groups: Sequence[tuple[Sequence[int], int]], n: int, epoch: int, seed: int) -> DataFrame:
    """(draw_pos, example_index): n draws with replacement, a group by weight and then a member.

    Each draw takes two steps of the generator, whose state after any number
    of steps is known, so draws run over range(n) in parallel. Where a value is
    rejected, which has a chance of about n * weights / 2**64, all later draws
    move; then, and only then, they are made in turn by the driver.
    """
    total, state = check_groups(groups), epoch_state(seed, epoch)
    ends = np.cumsum([w for _, w in groups], dtype=np.uint64)
    sizes = np.array([len(g) for g, _ in groups], np.uint64)
    starts, flat = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), np.array([m for g, _ in groups for m in g], np.int64)
    worst = max(2**64 % total, *(2**64 % len(g) for g, _ in groups))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            at = 2 * b["id"].to_numpy(np.int64)
            which, member = stream(state, at + 1), stream(state, at + 2)
            g = np.searchsorted(ends, which % np.uint64(total), side="right")
            out = flat[starts[g] + (member % sizes[g]).astype(np.int64)]
            yield pd.DataFrame({"draw_pos": b["id"], "example_index": out, "again": np.minimum(which, member) < np.uint64(worst)})

    draws = spark.range(n).mapInPandas(draw, "draw_pos long, example_index long, again boolean")
    if draws.where("again").isEmpty():
        return draws.drop("again")
    rng, out = SplitMix(state), []
    for i in range(n):
        g = int(np.searchsorted(ends, np.uint64(rng.below(total)), side="right"))
        out.append((i, int(flat[starts[g] + rng.below(int(sizes[g]))])))
    return spark.createDataFrame(out, "draw_pos long, example_index long")


def drawn(draws: DataFrame, examples: DataFrame) -> DataFrame:
    """examples (example_index, ...) in the order of draws (draw_pos, example_index); an example may be drawn often."""
    return draws.join(examples, "example_index")
