"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts that keep
neighbours together, and a small classifier learns to tell a vector's part.
Every distinct vector is indexed in its likeliest part; a query is reranked
exactly against the vectors of its several likeliest parts. The number of
parts probed is the least with which the sample's queries find RECALL of their
neighbours.

Equal vectors are one class; a class lists its smallest ids, as many as any
query can need, so a vector that a third of the rows share costs a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

#: Vectors that the fit reads at most, sample neighbours in the graph, and the share of them that probes must find.
SAMPLE, NEIGHBOURS, RECALL = 8_000, 10, 0.97
#: Vectors for each part on average, parts at most and, of a few hundred vectors, at least; candidates and queries of a reranking task.
PART, PARTS, FEWEST, CANDIDATES, QUERIES = 1_500, 256, 8, 20_000, 4_000


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components, that aren't zero, empty or null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def neighbours(x: np.ndarray, queries: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """For each query index the k others of largest inner product, in no order."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), block):
        q = queries[i : i + block]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        out[i : i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A part for each node: neighbours together, no part over 1.1 times the mean.

    Starts from balanced k-means; then nodes move, those with most to gain
    first, to the part that holds most of their neighbours, while there is room.
    """
    n = len(x)
    room = -(-11 * n // (10 * parts))
    centres = x[rng.choice(n, parts, replace=False)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def place(score: np.ndarray) -> np.ndarray:
        part, free = np.full(n, -1), np.full(parts, room)
        best = np.sort(score, axis=1)
        for i in np.argsort(best[:, -2] - best[:, -1] if parts > 1 else best[:, -1], kind="stable"):
            for p in np.argsort(-score[i], kind="stable"):
                if free[p]:
                    part[i], free[p] = p, free[p] - 1
                    break
        return part

    for _ in range(4):
        part = place(unit @ (centres / (np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9)).T)
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
    rows = np.repeat(np.arange(n), near.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (rows, part[near.reshape(-1)]), 1)
        np.add.at(votes, (near.reshape(-1), part[rows]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        load, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if load[to] < room:
                load[part[i]] -= 1
                load[to] += 1
                part[i], moved = to, moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer, and the number of parts to probe."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0)
        return _softmax(h @ self.w2 + self.b2)

    def likeliest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")[:, :n]


def train_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 25) -> Router:
    """Adam on cross entropy."""
    r = Router(x.mean(axis=0), 1 / (x.std() + 1e-9), *(rng.normal(0, 1, s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for s in ((x.shape[1], hidden), (hidden,), (hidden, parts), (parts,))))
    names, z = ("w1", "b1", "w2", "b2"), (x - x.mean(axis=0)) / (x.std() + 1e-9)
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            b = order[i : i + 128]
            h = np.maximum(z[b] @ r.w1 + r.b1, 0)
            d = _softmax(h @ r.w2 + r.b2)
            d[np.arange(len(b)), part[b]] -= 1
            d /= len(b)
            back = (d @ r.w2.T) * (h > 0)
            step += 1
            for k, g in zip(names, (z[b].T @ back, back.sum(0), h.T @ d, d.sum(0)), strict=True):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                setattr(r, k, getattr(r, k) - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return r


def fit(sample: np.ndarray, n: int, k: int, recall: float = RECALL, seed: int = 11) -> Router | None:
    """A router for an index of n vectors, or None if there are too few of them for parts (under 40 in the sample)."""
    parts = min(PARTS, max(FEWEST, round(n / PART)), len(sample) // 20)
    if parts < 2:
        return None
    rng = np.random.default_rng(seed)
    part = balanced_parts(sample, neighbours(sample, np.arange(len(sample)), min(NEIGHBOURS, len(sample) - 1)), parts, rng)
    router = train_router(sample, part, parts, rng)
    own = router.likeliest(sample, 1)[:, 0]
    queries = rng.choice(len(sample), min(1000, len(sample)), replace=False)
    order = np.argsort(np.argsort(-router.probabilities(sample[queries]), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(order, own[neighbours(sample, queries, min(k, len(sample) - 1))], axis=1)  # the probe that finds each neighbour
    router.probes = next((p for p in range(1, parts) if (at < p).mean() >= recall), parts)
    return router


def _sequential(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of the components."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows by inner product, of those probed.

    vectors: vec_id, embedding. Rows whose vector is null, zero, of another
    length than most, or holds null or non-finite components take no part, nor
    do null ids. Equal vectors tie, to smaller ids; repeated rows count once;
    an id with several vectors counts by the best of them. Queries with fewer
    than k candidates get all of them. Extra columns are ignored; an empty
    table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    vectors = vectors.where(F.size("embedding") == (lengths["n"] if lengths else 0))
    key = F.concat(F.hex(F.xxhash64("embedding")), F.hex(F.hash("embedding")))
    vectors = common.written(vectors.withColumn("key", key), "vectors")

    # A class's k + 1 smallest ids serve any query; the window keeps as many of a key in each task before the shuffle.
    first = Window.partitionBy("key").orderBy("vec_id")
    classes = vectors.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= k + 1)
    classes = classes.groupBy("key").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    classes = common.written(classes.withColumn("low", F.element_at("ids", 1)), "classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("embedding").collect()  # at most SAMPLE vectors
    router = fit(np.array([r[0] for r in sample]), n, k, recall) if sample else None
    parts = len(router.b2) if router else 1

    def routed(width: int):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["embedding"].to_numpy())
                to = router.likeliest(x, width) if router else np.zeros((len(x), 1), np.int64)
                yield b.assign(part=list(to.astype(np.int32)))

        return rows

    wanted = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "key").distinct()
    queries = classes.join(wanted.select("key").distinct(), "key", "left_semi").select("key", "embedding")
    queries = queries.mapInPandas(routed(router.probes if router else 1), "key string, embedding array<double>, part array<int>")
    queries = common.written(queries.withColumn("part", F.explode("part")), "queries")
    indexed = classes.select("key", "low", "embedding").mapInPandas(routed(1), "key string, low long, embedding array<double>, part array<int>")
    indexed = common.written(indexed.withColumn("part", F.explode("part")), "index")

    # Cells: a block of a part's queries against a block of its vectors.
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("blocks"))
    sizes = sizes.join(queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "part")
    sizes = F.broadcast(sizes)  # a row for each part, PARTS at most
    block, group = F.pmod(F.hash("key"), F.col("blocks")), F.pmod(F.hash("key"), F.col("groups"))
    left = queries.join(sizes, "part").withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = indexed.join(sizes, "part").withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def rerank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """A row for each query of the cell, with its nearest there as arrays."""
        out: dict[str, list] = {"query": [], "part": [], "keys": [], "lows": [], "scores": []}
        if not len(q) or not len(c):
            return pd.DataFrame(out)
        a, b = np.stack(q["embedding"].to_numpy()), np.stack(c["embedding"].to_numpy())
        low, key, most = c["low"].to_numpy(), c["key"].to_numpy(), min(k + 1, len(c))
        for i in range(0, len(a), 512):
            s = a[i : i + 512] @ b.T
            edge = -np.partition(-s, most - 1, axis=1)[:, most - 1]
            rows, columns = np.nonzero(s >= (edge - 1e-12 * np.abs(edge))[:, None])
            exact = _sequential(a[i + rows], b[columns])
            order = np.lexsort((low[columns], -exact, rows))
            rows, columns, exact = rows[order], columns[order], exact[order]
            first = np.searchsorted(rows, np.arange(len(s)))
            for n, at in enumerate(first):
                out["query"].append(q["key"].iloc[i + n])
                out["part"].append(q["part"].iloc[0])
                out["keys"].append(key[columns[at : at + most]])
                out["lows"].append(low[columns[at : at + most]])
                out["scores"].append(exact[at : at + most])
        return pd.DataFrame(out)

    cells = ["part", "block", "group"]
    found = left.select("key", "embedding", *cells).groupBy(*cells).cogroup(right.select("key", "low", "embedding", *cells).groupBy(*cells))
    found = found.applyInPandas(rerank, "query string, part int, keys array<string>, lows array<long>, scores array<double>")
    hits = F.transform(F.arrays_zip("scores", "lows", "keys"), lambda h: F.struct((-h["scores"]).alias("minus"), h["lows"].alias("low"), h["keys"].alias("key")))
    found = found.select("query", "part", hits.alias("hits"))

    def nearest(by: list[str]) -> DataFrame:
        return found.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))

    found = nearest(["query", "part"])  # the blocks of a part first, so that no list grows with the corpus
    found = nearest(["query"]).select("query", F.inline("hits")).select("query", "key", (-F.col("minus")).alias("score"))

    # Classes to rows: k + 1 classes hold more than k other ids, so a query's list stays short.
    listed = found.join(classes.select("key", "ids"), "key")
    listed = listed.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id")))))).alias("hits"))
    listed = listed.withColumn("hits", F.slice("hits", 1, 2 * (k + 1)))
    out = wanted.join(listed, wanted["key"] == listed["query"]).withColumn("hits", F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")))
    out = out.select("query_id", F.inline("hits")).groupBy("query_id", "vec_id").agg(F.min("minus").alias("minus"))
    mine = Window.partitionBy("query_id").orderBy("minus", "vec_id")
    out = out.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))
