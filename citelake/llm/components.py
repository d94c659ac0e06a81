"""Connected components of a distributed edge table by alternating large-star and small-star steps.

Every step replaces the edges by edges to smaller nodes; both use a minimum that is combined before the
shuffle and an equi-join that adaptive execution splits at hot nodes.  Edges are staged in the shared folder
after each round, nothing but two numbers comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import stage, unstage


def _to_least(edges: DataFrame, keep: str) -> DataFrame:
    """Edges from the neighbours that ``keep`` names (of u, among v) to the least of u and its neighbours there."""
    near = edges if keep == "v < u" else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    out = near.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep == "v < u":
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v longs) and the least node that it reaches."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges, before = stage(edges), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark["n"], mark["x"]) == before:
            break
        before, last = (mark["n"], mark["x"]), edges
        edges = stage(_to_least(_to_least(edges, "v > u"), "v < u"))
        unstage(last)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out.staged_paths = edges.staged_paths
    return out
