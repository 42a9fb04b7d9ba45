"""Connected components by star contraction, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.operators.groups import with_group
from waraq.session import cut

MAX_ROUNDS = 60


def _toward(edges: DataFrame) -> DataFrame:
    """(a, b, m): each edge with the smallest of the nodes around a, and a itself; a hub's edges are spread by salt."""
    return with_group(edges, "a", "b", F.min("b").alias("_m")).withColumn("m", F.least("a", "_m")).drop("_m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) edges; the root is the smallest node of the component.

    A large star hangs a node's larger neighbours on the smallest of its neighbourhood, a small star the
    others; both keep what is connected. The rounds grow with the logarithm of the number of nodes, until every component is
    a star, and no node, hub or root, brings its edges to one task. Raises if the rounds don't suffice
    rather than stopping short.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    state = _state(pairs)
    for _ in range(MAX_ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = _toward(large)
        small = near.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        pairs = cut(small.distinct())
        new = _state(pairs)
        if new == state:
            # every node is now the end of one edge to its root
            return nodes.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        state = new
    raise RuntimeError("components did not settle")


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s")).first()
    return row["n"], row["x"], row["s"]
