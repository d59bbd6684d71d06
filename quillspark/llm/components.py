"""Connected components of a graph of links, by alternating large and small stars.

Each turn sends the larger neighbours of a node to its smallest neighbour (large star), then the smaller ones (small
star), until every node hangs on the smallest node of its component. A first union-find within partitions shortens
long chains. All steps are groupBys and joins; turns are written to the shared folder, and only a count and a checksum
come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, materialize

SCHEMA = "node long, root long"


def union_find(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Smallest node of each node's component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(edges):
        found = [(x, r) for x, r in union_find(edges).items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], ["node", "root"])

    for batch in batches:
        yield one(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))


def _sum(df: DataFrame):
    return df.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (node, root) with root < node, distinct."""
    if large:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).withColumn("m", F.least("m", "node"))
        return both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
    least = edges.groupBy("node").agg(F.min("root").alias("m"))
    joined = edges.join(least, "node")
    return joined.where("root > m").select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(least.withColumnRenamed("m", "root")).distinct()


def components(links: DataFrame, turns: int = 100, whole: bool = True) -> DataFrame:
    """(node, root) of every node that hangs on a smaller one; `links` has two columns of node ids.

    The number of turns grows with the logarithm of the longest path; with `whole` an error is raised where `turns` don't
    do. Without, components may be left in several parts, but what isn't linked is never joined.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    edges = materialize(arrow_map(edges, _contract, SCHEMA).distinct(), "links")
    state = _sum(edges)
    for _ in range(turns):
        edges = materialize(_star(_star(edges, True), False), "stars")
        before, state = state, _sum(edges)
        if state == before:
            return edges
    if whole:
        raise RuntimeError(f"components are not whole after {turns} turns")
    return edges
