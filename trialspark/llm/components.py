"""Connected components of an edge table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.shared import gather


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node of the edges ``a, b``.

    Each round hangs larger neighbours, then smaller ones, below the smallest neighbour; both are one
    aggregation and one join on the node, whose hot keys AQE may split. Rounds end when the edge
    set stays as it is; only its count and checksum reach the driver. Edges from a node to itself
    make it a node of its own; NULL ends are ignored.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null")
    loops = edges.filter("u = v").select("u").distinct()
    edges = gather(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        edges = gather(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == state:
            break
        state = after
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = hung.select(F.col("root").alias("node"), "root").distinct()
    found = hung.unionByName(roots)
    lone = loops.select(F.col("u").alias("node"), F.col("u").alias("root")).join(found.select("node"), "node", "left_anti")
    return found.unionByName(lone)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
