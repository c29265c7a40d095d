"""Connected components of an undirected graph as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spokeflow.plans.lineage import written


HUB = 1_000_000  # edges from which a node may have enough neighbours for its rows to be worth splitting


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hub: int = HUB) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Alternates large-star and small-star steps, which shorten paths geometrically, until a round changes nothing. A step is
    one minimum per node (combined before the shuffle) and one equi-join, so no neighbour list is ever
    gathered. Each round is written to the shared folder; its count and checksum are taken while it is written. While
    there are over `hub` edges the minima are written too: both sides of the joins are then shuffled for them, and
    adaptive execution can split a node's rows. No side is broadcast, so nothing of the graph passes the driver. Null ends and self-loops are ignored. Returns (node, component).
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e, before = _round(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        own = written if before[0] > hub else lambda df: df
        both = _both_ways(e)
        low = own(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = own(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e, now = _round(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        # a star forest has one parent per node, and no parent has a parent
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


FEW = 1_000_000  # links that one task takes, 16 MB


def few_or_many_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = FEW) -> DataFrame:
    """The same as `connected_components`. Up to `few` links, which are counted first, are joined in one task without rounds."""
    if edges.count() > few:
        return connected_components(edges, src, dst)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := lead.setdefault(x, x)) != x:
                lead[x] = lead[up]
                x = lead[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                lead[max(a, b)] = min(a, b)
        nodes = list(lead)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])

    pairs = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    return pairs.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v"), F.col("u")))


def _round(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, their number and a checksum of them."""
    seen = Observation()
    check = F.xxhash64("u", "v").cast("decimal(38,0)")
    table = written(e.observe(seen, F.count("*").alias("n"), F.sum(check).alias("x")))
    return table, (seen.get["n"], seen.get["x"])
