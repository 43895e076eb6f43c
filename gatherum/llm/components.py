"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import discard, join_facts, materialise


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_facts(both, least, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_facts(edges, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node that can be reached.

    ``links`` has columns src and dst, in any direction, repeats allowed. Every step is a distributed aggregate and join
    whose result is written to the shared folder, in place of the one before; only a count and a hash of the links reach the
    driver. Rows of a node with very many links stay where they are.
    """
    edges = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "components")
    state = _state(edges)
    while state[0]:
        stars = materialise(_large_star(edges, state[0]).distinct(), "components-stars")
        fresh = materialise(_small_star(stars, stars.count()).distinct(), "components")
        discard(edges, stars)
        edges, before, state = fresh, state, _state(fresh)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
