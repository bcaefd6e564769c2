"""Connected components of an edge table, by alternating large and small stars.

Each round is joins and minima over the edges; edges and minima of a round are
written to the shared folder, so nothing is recomputed and nothing goes to the
driver but one count and one checksum.  A node with very many edges is an
aggregation key, combined before the shuffle.  Where minima are joined to edges
only nodes with a smaller neighbour take part, and the written minima let Spark
broadcast them where they are few and split the edges of a hot node where they
are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import release, settle


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from larger neighbours to each node's least neighbour or itself, and the written minima."""
    # edges are (greater, less): the node's own value is its minimum unless it has a smaller neighbour
    least = settle(edges.groupBy("a").agg(F.min("b").alias("least")), "minima", few=True)
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a", "left")
    return up.select(F.col("b").alias("a"), F.coalesce("least", "a").alias("b")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from each node and its smaller neighbours to the least of them, and the written minima."""
    least = settle(edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")), "minima", few=True)
    # a node with one smaller neighbour keeps that edge as it is
    to_least = edges.join(least.where("n > 1"), "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return to_least.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), least


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node that has an edge.

    ``edges`` has two columns of ids; loops and repeats do no harm.
    """
    a, b = edges.columns
    pairs = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few=True)
    before = None
    for _ in range(rounds):
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        large, first = _large_star(pairs)
        starred = settle(large, "edges", few=True)
        small, second = _small_star(starred)
        settled = settle(small, "edges", few=True)
        release(pairs, first, starred, second)
        pairs = settled
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
