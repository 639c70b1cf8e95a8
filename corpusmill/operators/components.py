"""Families of records: connected components over shared keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import drop, written


#: Edges of a task that ties them together on its own, before the rounds over all.
BLOCK = 250_000


def star_edges(keys: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Edges (a, b) that tie each node to the least node with the same key: one for each row, not one for each pair."""
    least = keys.groupBy(key).agg(F.min(node).alias("b"))
    return keys.join(least, key).select(F.col(node).alias("a"), "b").where("a != b")


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are tied to the least node that it sees."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")
    return low.select("a", F.col("low").alias("b")).unionByName(small).distinct()


def _done(edges: DataFrame) -> bool:
    """True if every node has one edge, to a node without one of its own."""
    many = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return many.unionByName(chained).isEmpty()


def _forest(edges: DataFrame) -> DataFrame:
    """Blocks of edges, each tied together by one task: the edges (node, least node of its tree in the block)."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}

        def root(x):
            while (up := top.setdefault(x, x)) != x:
                top[x] = top[up]
                x = up
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    top[max(a, b)] = min(a, b)
        if schema is not None:
            nodes = [x for x in top if root(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(1).type)], schema=schema)

    return edges.repartition(max(1, math.ceil(edges.count() / BLOCK))).mapInArrow(tie, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b of one orderable type) to (node, component): the least node that can be reached.

    Nodes without an edge to another node are left out. Loops and repeated edges
    do no harm; edges with a null end are ignored. Rounds alternate the two star
    operations and halve the depth of chains, so they grow with the logarithm
    of the longest one; each round is a table in the shared folder. Before them
    tasks tie blocks of edges together, which takes most chains away.
    """
    spark, high = edges.sparkSession, F.greatest("a", "b")
    edges = edges.where("a != b").select(high.alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(_forest(written(edges, "edges")), "edges")
    while not _done(edges):
        path = edges.inputFiles()[0].rsplit("/", 1)[0]
        edges = written(_stars(edges), "edges")
        drop(spark, path)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def fixed_conflicts(families: DataFrame, fixed: DataFrame) -> DataFrame:
    """(component, partitions): families (node, component) that hold nodes fixed to different partitions; fixed: (node, partition), nulls are free."""
    rows = families.join(fixed.where("partition is not null"), "node").groupBy("component").agg(F.array_sort(F.collect_set("partition")).alias("partitions"))
    return rows.where("size(partitions) > 1")
