"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _link(around: DataFrame, keep) -> DataFrame:
    """Each neighbour v of u that ``keep`` admits is linked to the least node of u's neighbourhood."""
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return around.where(keep).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs -> (node, root): the least node that each node of an edge can reach.

    Large-star and small-star steps alternate until the edges form stars, which takes a number of
    rounds logarithmic in the size of a component. A hub is never gathered: its least neighbour is
    an aggregate with map-side combining, and the join back to its edges is an ordinary shuffle
    join that adaptive execution can split. Each round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    while True:
        large = _link(_both_ways(now), F.col("v") > F.col("u")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: u links all its smaller neighbours, and itself, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = now, materialize(small.where("u <> v").distinct(), "edges")
        discard(before)
        was, sign = sign, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
