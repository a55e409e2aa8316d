"""Connected components by alternating large-star and small-star, with lineage cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import discard, materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), component being the smallest node that can be reached.

    Null ends and self-links say nothing and are left out; nodes without a link don't appear.
    Every round groups by node with partial minima and joins these back to the links; the links of a node
    with many are split by Spark's handling of skewed joins (adaptive execution has to be on). A graph that
    has not settled after MAX_ROUNDS rounds raises; rounds grow with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, count = materialize(e), None
    for _ in range(MAX_ROUNDS):
        large = _star(now, both=True)
        small = _star(large, both=False)
        after = materialize(small)
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if (seen["n"], seen["h"]) == count:
            break
        count = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(e: DataFrame, both: bool) -> DataFrame:
    """Large star links each node's larger neighbours to its smallest; small star its smaller ones and itself."""
    if both:
        n = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        n = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = n.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
    j = n.join(least, "x")
    if both:
        out = j.filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()
