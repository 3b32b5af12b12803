"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to the least node it sees. Small star:
    each node links its smaller neighbours, and itself, to the least of them. The least node is
    found by a map-side combined minimum, never by gathering a node's neighbours."""
    down = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))  # u > v
    if large:
        near = down.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        near = down
    least = near.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    moved = near.join(least, "n")
    if large:
        out = moved.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = moved.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(
            least.select(F.col("n").alias("u"), F.col("low").alias("v"))
        )
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame):
    """A checksum of an edge set: equal sets have equal marks."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s"),
    ).first()
    return (row["n"], row["x"], row["s"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns u and v. Returns (node, root), root being the least node of the
    component, for each node of an edge between different nodes; null ends are left out.

    The number of steps grows with the logarithm of the longest chain. Every step is a written
    table in the shared checkpoint folder, so lost executors cost one step at most."""
    edges = stage(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        edges = stage(_star(_star(edges, True), False), "star")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
