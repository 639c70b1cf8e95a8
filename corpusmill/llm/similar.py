"""Links between sets of at least a given Jaccard similarity, and their components.

Both near-duplicate operators use this: items are shingle sets with a long key
and a MinHash signature. Equal bands of signatures propose pairs, exact Jaccard
similarity on whole sets confirms them.

Buckets. A band of an item gives an entry of two longs. Tasks sort their
entries and send them on in blocks, a block for each range of bucket hashes;
a reducer merges the blocks of its range and keeps buckets of two or more. So a
shuffled entry costs 16 bytes, and bands go through in rounds, whose shuffle
files are gone before the next. A bucket that is large in one task or in its
reducer isn't listed there; its members are found by another scan.

Links. In a bucket each item is first held against one pivot. Only pairs that
are still in different components are looked at further: all of them, inside
cells of bounded size, by an estimate from the signatures and then on whole
sets. A cell gives back only links that join something. So a large group of
copies costs a pair for each member, pairs are never listed, and no link
between different components is lost for the size of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.operators.components import components as connected

#: Entries that a task sorts at a time; entries of a reducer's range on average; bands of a round.
SORTED, REDUCED, ROUND = 1 << 18, 1 << 19, 15
#: Members of a bucket in one task's sort, and in a reducer, beyond which the bucket is large.
HOT, LARGE = 64, 4096
#: Members of a block of a large bucket; of a pack of other buckets, on average; pairs compared at a time.
BLOCK, PACK, AT_ONCE = 512, 4096, 1 << 14
#: Pairs that a cell confirms at a time; elements of sets, and bytes of them as stored, that are compared at a time.
SOME, ELEMENTS, BYTES = 4096, 1 << 18, 1 << 19
#: Standard errors that an estimate may lie under the threshold.
SLACK = 6.0

#: Sets as stored to their numbers, one set after the other, and sizes; numbers may repeat and be in any order.
Unpack = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
BUCKETS = "bucket long, band int, n int, pivot long, last long, mixed long, members array<long>"


def signature_tables(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of x -> a * x + b modulo 2**32."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, permutations, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 2**32, permutations, dtype=np.uint32)


def folded(values: np.ndarray) -> np.ndarray:
    return (values ^ (values >> np.uint64(32))).astype(np.uint32)


def extremes(values: np.ndarray, a: np.ndarray, b: np.ndarray, *, largest: bool, chunk: int = 4096) -> np.ndarray:
    """The least (and, if asked, after them the largest) hash of a set under each permutation."""
    x = folded(values)
    low, high = np.full(len(a), 2**32 - 1, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), chunk):
        h = a[:, None] * x[None, i : i + chunk] + b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        if largest:
            np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high]) if largest else low


def many_minima(values: np.ndarray, sizes: np.ndarray, a: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
    """Least hashes of many sets that aren't empty, one after the other in values: a row for each.

    The permutations are x -> a * x: of values that are hashes themselves, an
    offset would change nothing but the place of the least.
    """
    x, ends = folded(values), np.cumsum(sizes)
    starts, out, hashed, i = ends - sizes, np.empty((len(a), len(sizes)), np.uint32), np.empty(chunk, np.uint32), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, side="right")))
        if ends[j - 1] - starts[i] > chunk:  # one that is very long
            out[:, i] = extremes(values[starts[i] : ends[i]], a, np.zeros_like(a), largest=False)
        else:
            part, at = x[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
            h = hashed[: len(part)]
            for k in range(len(a)):  # a permutation of some sets at a time, which stay in the cache
                np.multiply(part, a[k], out=h)
                np.minimum.reduceat(h, at, out=out[k, i:j])
        i = j
    return np.ascontiguousarray(out.T)


def many_band_keys(signatures: np.ndarray, rows: int, first: int = 0) -> np.ndarray:
    """A 64-bit key for each band of `rows` 16-bit values of each signature; the band's number, counted from `first`, is its low six bits."""
    number = np.arange(first, first + signatures.shape[1] // rows, dtype=np.uint64)
    seed = (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    if rows == 4:  # a band is one number as it stands
        parts = [np.ascontiguousarray(signatures).view(np.uint64)]
    else:
        bands = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
        parts = [bands[:, :, j] for j in range(rows)]
    key = np.broadcast_to(seed, (len(signatures), len(number)))
    for part in parts:
        key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    key = key * np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(32)
    return (key & ~np.uint64(63)) | number


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    return many_band_keys(signature[None, :], rows)[0]


def short_form(signature: np.ndarray) -> np.ndarray:
    """16 bits of each value; bands and estimates both use these."""
    return (signature ^ (signature >> np.uint32(16))).astype(np.uint16)


# Comparing whole sets


def packed_sets(members: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sizes of sets that were stored as their 64-bit numbers."""
    return np.frombuffer(b"".join(members), "<u8"), np.array([len(x) // 8 for x in members], np.int64)


class Sets:
    """Some sets side by side: the numbers of a set follow each other, sorted and distinct.

    Of a 64-bit number the bits that are left beside the set's own place are
    used, 44 at least, so that a sort of plain numbers does all the work.
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        bits = max(12, int(len(sizes)).bit_length())
        self.most, self.low = 1 << bits, np.uint64(64 - bits)
        codes = np.repeat(np.arange(len(sizes), dtype=np.uint64) << self.low, sizes)
        codes |= values >> np.uint64(bits)
        codes.sort()
        codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
        self.sizes = np.bincount((codes >> self.low).astype(np.int64), minlength=len(sizes))
        self.starts, self.numbers = np.cumsum(self.sizes) - self.sizes, codes & np.uint64((1 << int(self.low)) - 1)

    def _coded(self, rows: np.ndarray) -> np.ndarray:
        """The sets of the rows, one after the other, each number with its set's place among them."""
        n = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.numbers[at] | np.repeat(np.arange(len(rows), dtype=np.uint64) << self.low, n)

    def similar(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows reach the similarity."""
        out, total = np.zeros(len(i), bool), self.sizes[i] + self.sizes[j]
        near = np.flatnonzero(100 * np.minimum(self.sizes[i], self.sizes[j]) >= percent * np.maximum(self.sizes[i], self.sizes[j]))
        ends, at = np.cumsum(total[near]), 0
        while at < len(near):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ELEMENTS, side="right")))
            part = near[at : min(to, at + self.most)]
            codes = np.concatenate([self._coded(i[part]), self._coded(j[part])])
            codes.sort(kind="stable")  # both halves are sorted, so this merges them
            both = np.bincount((codes[1:][codes[1:] == codes[:-1]] >> self.low).astype(np.int64), minlength=len(part))
            out[part] = 100 * both >= percent * (total[part] - both)
            at += len(part)
        return out


def _confirmed(stars: DataFrame, members: DataFrame, unpack: Unpack, percent: int) -> DataFrame:
    """The pairs (a, b) of stars (a, b, n: at most so many have this a) whose whole sets reach the similarity. members: (key, members).

    Pairs of one pivot are dealt over tasks, each of which gets the pivot's set.
    """
    salted = stars.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)))
    left = salted.select("a", "salt").distinct().join(members.select(F.col("key").alias("a"), F.col("members").alias("left")), "a")
    right = members.select(F.col("key").alias("b"), F.col("members").alias("right"))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            stored = [*t["left"], *t["right"]]
            keys = np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()])
            ends, at = np.cumsum([len(x) + len(y) for x, y in zip(t["left"], t["right"], strict=True)]), 0
            while at < len(t):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")))
                rows = np.concatenate([np.arange(at, to), np.arange(at, to) + len(t)])
                _, first, inverse = np.unique(keys[rows], return_index=True, return_inverse=True)
                ok = Sets(*unpack([stored[r] for r in rows[first]])).similar(inverse[: to - at], inverse[to - at :], percent)
                yield t.iloc[at:to].loc[ok, ["a", "b"]]
                at = to

    pairs = salted.select("a", "b", "salt").join(left, ["a", "salt"]).join(right, "b")
    return common.written(pairs.mapInPandas(similar, "a long, b long"), "links")


# Buckets


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _ascending(values: np.ndarray) -> np.ndarray:
    """The order that sorts values. Their high bits with their places below are sorted as plain numbers, which is cheaper; if low bits matter, the values themselves."""
    places = np.uint64(max(1, len(values)).bit_length())
    codes = values >> places << places
    codes |= np.arange(len(values), dtype=np.uint64)
    codes.sort()
    codes &= (np.uint64(1) << places) - np.uint64(1)
    order = codes.view(np.int64)
    found = values[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(values)


def packed(signatures: DataFrame) -> DataFrame:
    """Blocks (keys, values) of signatures (key, signature): rows of many, which cost less to hand on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield block(batch.column(0).to_numpy(), batch.column(1).to_pylist())

    return signatures.select("key", "signature").mapInArrow(rows, "keys binary, values binary")


def block(keys: np.ndarray, signatures: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys.astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(signatures)], pa.binary())], names=["keys", "values"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and signatures of blocks."""
    for batch in batches:
        for keys, values in zip(batch.column(0), batch.column(1), strict=True):
            keys = np.frombuffer(keys.as_buffer(), "<i8")
            yield keys, np.frombuffer(values.as_buffer(), np.uint16).reshape(len(keys), -1)


def _entries(keys: np.ndarray, signatures: np.ndarray, width: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and keys of the bands from first to last - 1."""
    buckets = many_band_keys(signatures[:, first * width : last * width], width, first)
    return buckets.reshape(-1), np.repeat(keys.view(np.uint64), last - first)


def _round(blocks: DataFrame, width: int, first: int, last: int, ranges: int) -> DataFrame:
    """BUCKETS rows of the buckets with two or more members in some bands; large ones with n = 0 and without members."""
    shift = np.uint64(64 - int(ranges).bit_length() + 1)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            bucket, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = _ascending(bucket)
            bucket, key = bucket[order], key[order]
            starts, sizes = _runs(bucket)
            hot = np.repeat(sizes > HOT, sizes)
            large, pivot = bucket[starts[sizes > HOT]], np.array([key[i : i + n].min() for i, n in zip(starts[sizes > HOT], sizes[sizes > HOT], strict=True)], np.uint64)
            bucket, key = bucket[~hot], key[~hot]
            part = np.arange(ranges + 1, dtype=np.uint64) << shift if ranges > 1 else np.zeros(1, np.uint64)
            at, large_at = (np.append(np.searchsorted(x, part[:ranges]), len(x)) for x in (bucket, large))
            cut = [[x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)] for x, ends in ((bucket, at), (key, at), (large, large_at), (pivot, large_at))]
            full = [r for r in range(ranges) if cut[0][r] or cut[2][r]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([c[r] for r in full], pa.binary()) for c in cut)], names=["range", "buckets", "keys", "large", "pivots"])

        n = 0
        for keys, values in _blocks(batches):
            held.append(_entries(keys, values, width, first, last))
            n += len(held[-1][0])
            if n >= SORTED:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    def merge(t: pa.Table) -> pa.Table:
        bucket, key, large, pivot = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64) for c in ("buckets", "keys", "large", "pivots"))
        order = _ascending(bucket)
        ordered = bucket[order]
        same = ordered[1:] == ordered[:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        bucket, key = bucket[order], key[order]
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]) if len(bucket) else np.zeros(0, bool)
        new &= ~np.isin(bucket, large)  # those are listed by another scan
        bucket, key = bucket[new], key[new]
        starts, sizes = _runs(bucket)
        many = sizes > LARGE
        large, pivot = np.concatenate([large, bucket[starts[many]]]), np.concatenate([pivot, key[starts[many]]])
        large, first_of = np.unique(large, return_index=True)
        keep = (sizes > 1) & ~many
        member = np.repeat(keep, sizes)
        bucket, key = bucket[member], key[member]
        starts, sizes = _runs(bucket)
        mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
        zeros = np.zeros(len(large), np.uint64)
        columns = {
            "bucket": np.concatenate([bucket[starts], large]),
            "band": np.concatenate([bucket[starts], large]) & np.uint64(63),
            "n": np.concatenate([sizes, zeros]),
            "pivot": np.concatenate([key[starts], pivot[first_of]]),
            "last": np.concatenate([key[starts + sizes - 1] if len(starts) else key[:0], zeros]),
            "mixed": np.concatenate([sums, zeros]),
        }
        small = {"band": np.int32, "n": np.int32}
        arrays = {c: pa.array(v.astype(small[c]) if c in small else v.astype(np.uint64).view(np.int64)) for c, v in columns.items()}
        ends = np.concatenate([[0], np.cumsum(sizes), np.full(len(large), len(key))]).astype(np.int32)
        return pa.table(arrays | {"members": pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))})

    parts = blocks.mapInArrow(sort, "range int, buckets binary, keys binary, large binary, pivots binary")
    return common.written(parts.groupBy("range").applyInArrow(merge, BUCKETS), "buckets")


def _large_members(blocks: DataFrame, large: DataFrame, width: int, bands: int) -> DataFrame:
    """(bucket, key) of the buckets `large` (bucket)."""
    wanted = common.Keys(large)
    test = wanted.test()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _blocks(batches):
            bucket, key = (x.view(np.int64) for x in _entries(keys, values, width, 0, bands))
            hit = test(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[hit]), pa.array(key[hit])], names=["bucket", "key"])

    return common.written(wanted.only(blocks.mapInArrow(rows, "bucket long, key long")).distinct(), "large")


def _signatures_of(blocks: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, signature) of the keys needed, a row for each."""
    wanted = common.Keys(needed)
    test = wanted.test()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _blocks(batches):
            at = np.flatnonzero(test(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array([values[i].tobytes() for i in at], pa.binary())], names=["key", "signature"])

    found = wanted.only(blocks.mapInArrow(rows, "key long, signature binary"))
    return found.groupBy("key").agg(F.any_value("signature").alias("signature"))


def buckets(blocks: DataFrame, values: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Buckets of two or more keys of blocks (keys, values), which may repeat a key.

    Of buckets with the same members the one of the earliest band is kept.
    Returns those of two as (pivot, last), others as (bucket, band, pivot, n,
    members), and of large ones a row for each member: (bucket, band, pivot, n,
    key), or None if there are none.
    """
    bands = values // width
    n = blocks.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    ranges = 1 << max(3, math.ceil(math.log2(max(1, n * min(ROUND, bands) / REDUCED))))
    rounds = [_round(blocks, width, i, min(i + ROUND, bands), ranges) for i in range(0, bands, ROUND)]
    found = rounds[0]
    for r in rounds[1:]:
        found = found.unionByName(r)
    pairs = common.written(found.where("n = 2").select("pivot", "last").distinct(), "pairs")
    small = found.where("n > 2").groupBy("n", "mixed", "pivot", "last").agg(F.min(F.struct("band", "bucket")).alias("at"), F.any_value("members").alias("members"))
    small = common.written(small.select("at.*", "pivot", "n", "members"), "buckets")
    large = common.written(found.where("n = 0").select("bucket").distinct(), "large-buckets")
    for r in rounds:
        common.forget(r)
    if large.isEmpty():
        return pairs, small, None
    members = _large_members(blocks, large, width, bands)
    named = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("pivot"), F.max("key").alias("last"), F.bit_xor(F.xxhash64("key")).alias("mixed"))
    named = named.withColumn("band", F.col("bucket").bitwiseAND(F.lit(63)).cast("int")).where("n > 1")
    named = named.groupBy("n", "mixed", "pivot", "last").agg(F.min(F.struct("band", "bucket")).alias("at")).select("at.*", "pivot", "n")
    return pairs, small, common.written(members.join(common.small(named), "bucket"), "large")


# Pairs between components


def _pairs(t: pd.DataFrame, floor: float | None, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j of a cell that make pairs to be looked at, some at a time.

    Those are of one bucket and of different components, pass the estimate and
    meet in no earlier band; in a cell of two blocks i is of the first.
    """
    t_side, bucket = t["side"].to_numpy(), t["bucket"].to_numpy()
    component, key, band = pd.factorize(t["component"])[0], t["key"].to_numpy(), t["band"].to_numpy()
    signature = np.frombuffer(b"".join(t["signature"]), np.uint16).reshape(len(t), -1)
    if t_side[0] < 0:  # a pack: each row with those after it in its bucket
        _, sizes = _runs(bucket)
        low = np.arange(1, len(t) + 1)
        high = np.repeat(np.cumsum(sizes), sizes)
        rows = np.arange(len(t))
    else:  # sides come sorted
        rows = np.flatnonzero(t_side == 0)
        low, high = np.full(len(t), len(rows)), np.full(len(t), len(t))
    counts = np.maximum(high[rows] - low[rows], 0)
    ends, at = np.cumsum(counts), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        part, n = rows[at:to], counts[at:to]
        i = np.repeat(part, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
        at = to
        ok = (component[i] != component[j]) & (key[i] != key[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        same = signature[i] == signature[j]
        if floor is not None:
            ok = np.bitwise_count(np.packbits(same, axis=1)).sum(axis=1, dtype=np.int32) >= floor * same.shape[1]
            i, j, same = i[ok], j[ok], same[ok]
        if len(i):
            ok = same.reshape(len(i), -1, width).all(axis=2).argmax(axis=1) == band[i]
            yield i[ok], j[ok]


def _cells(small: DataFrame, large: DataFrame | None, found: DataFrame) -> DataFrame:
    """(cell, first, second, side, bucket, band, key, component): members of buckets that hold several components.

    Buckets are packed whole into cells. Of a large one those that aren't of
    its commonest component, in blocks, meet all, in blocks.
    """
    of = found.withColumnRenamed("node", "key")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))

    rows = placed(small.select("bucket", "band", F.explode("members").alias("key")))
    several = rows.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("bucket")
    rows = common.written(rows.join(several, "bucket", "left_semi"), "mixed")
    packs = max(1, math.ceil(rows.count() / PACK))
    columns = ["cell", "first", "second", "side", "bucket", "band", "key", "component"]
    out = rows.withColumn("cell", F.pmod(F.xxhash64("bucket"), F.lit(packs))).withColumn("first", F.lit(0)).withColumn("second", F.lit(0)).withColumn("side", F.lit(-1)).select(columns)
    if large is None:
        return out
    rows = common.written(placed(large.select("bucket", "band", "key")), "large-placed")
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("common"))
    sizes = sizes.where("common.n < n").select("bucket", F.col("common.component").alias("common"), F.ceil((F.col("n") - F.col("common.n")) / BLOCK).cast("int").alias("firsts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("seconds"))
    rows = rows.join(common.small(sizes), "bucket")
    mixed = F.xxhash64("key", F.lit(1))
    one = rows.where("component != common").withColumn("first", F.pmod(mixed, "firsts").cast("int")).withColumn("second", F.explode(F.sequence(F.lit(0), F.col("seconds") - 1))).withColumn("side", F.lit(0))
    other = rows.withColumn("second", F.pmod(mixed, "seconds").cast("int")).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("firsts") - 1))).withColumn("side", F.lit(1))
    return out.unionByName(one.unionByName(other).withColumn("cell", F.col("bucket")).select(columns))


def _within_cells(cells: DataFrame, blocks: DataFrame, members: DataFrame, unpack: Unpack, floor: float | None, percent: int, width: int) -> DataFrame:
    """Confirmed links between different components, over all pairs of every bucket, as far as they join something.

    First the signatures alone tell which members have a pair to be looked at;
    then only those meet again, with their whole sets, each once for its cell
    and not once for each pair.
    """
    cell = ["cell", "first", "second"]
    needed = common.written(cells.select("key").distinct(), "needed")
    cells = cells.join(_signatures_of(blocks, needed), "key")

    def ordered(t: pd.DataFrame) -> pd.DataFrame:
        return t.sort_values(["side", "bucket", "key"], kind="stable", ignore_index=True)

    def likely(t: pd.DataFrame) -> pd.DataFrame:
        t, at = ordered(t), np.zeros(len(t), bool)
        for i, j in _pairs(t, floor, width):
            at[i] = at[j] = True
        return t[at]

    found = common.written(cells.groupBy(*cell).applyInPandas(likely, cells.schema), "likely")
    found = found.join(members, "key")

    def confirm(t: pd.DataFrame) -> pd.DataFrame:
        t, out = ordered(t), []
        if not len(t):
            return pd.DataFrame(out, columns=["a", "b"])
        keys, component = t["key"].to_numpy(), pd.factorize(t["component"])[0]
        whole, top = Sets(*unpack(list(t["members"]))), np.arange(len(t))

        def roots(x: np.ndarray) -> np.ndarray:
            while (top[x] != x).any():
                x = top[x]
            return x

        for i, j in _pairs(t, floor, width):
            at = 0
            while at < len(i):
                to = at + SOME
                x, y = i[at:to], j[at:to]
                apart = roots(component[x]) != roots(component[y])  # what is joined by now needs no further link
                x, y, at = x[apart], y[apart], to
                same = whole.similar(x, y, percent)
                for r, q in zip(x[same].tolist(), y[same].tolist(), strict=True):
                    a, b = (int(roots(component[[z]])[0]) for z in (r, q))
                    if a != b:
                        top[max(a, b)] = min(a, b)
                        out.append((keys[r], keys[q]))
        return pd.DataFrame(out, columns=["a", "b"])

    return common.written(found.groupBy(*cell).applyInPandas(confirm, "a long, b long"), "links")


def _estimate_floor(values: int, percent: int, slack: float | None) -> float | None:
    p = percent / 100
    return None if slack is None else p - slack * math.sqrt(p * (1 - p) / values)


def components(blocks: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, values: int, width: int, unpack: Unpack = packed_sets, slack: float | None = SLACK) -> tuple[DataFrame, DataFrame]:
    """Links of at least `percent` Jaccard similarity, and components.

    blocks: keys (longs) and values (`values` 16-bit numbers for each of them,
    `width` to a band), see packed(); a key may be repeated.
    sets: (key) rows to a written table (key, members: binary, ...), a row for
    each. unpack: members to the numbers of the sets; by default they are
    64-bit ones as they stand. slack: standard errors that an estimate may lie
    under the threshold; None leaves estimates out, so that every pair of a
    bucket that could join something is confirmed on whole sets.
    Returns the links found (a, b; enough of them for the components) and
    (node, component) for keys that have a link.
    """
    pairs, small, large = buckets(blocks, values, width)
    stars = small.select("n", F.col("pivot").alias("a"), F.explode("members").alias("b"))
    stars = stars.unionByName(pairs.select(F.lit(2).alias("n"), F.col("pivot").alias("a"), F.col("last").alias("b")))
    if large is not None:
        stars = stars.unionByName(large.select("n", F.col("pivot").alias("a"), F.col("key").alias("b")))
    stars = common.written(stars.where("a != b").groupBy("a", "b").agg(F.max("n").alias("n")), "stars")
    needed = stars.select(F.col("a").alias("key")).unionByName(stars.select(F.col("b").alias("key"))).distinct()
    members = sets(common.written(needed, "needed")).select("key", "members")
    links = _confirmed(stars, members, unpack, percent)
    found = common.written(connected(links), "components")
    cells = common.written(_cells(small, large, found), "cells")
    if cells.isEmpty():
        return links, found
    more = _within_cells(cells, blocks, members, unpack, _estimate_floor(values, percent, slack), percent, width)
    if more.isEmpty():
        return links, found
    links = common.written(links.unionByName(more), "links")
    return links, common.written(connected(links), "components")
