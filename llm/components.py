"""Connected components of an edge table by alternating stars.

Large-star and small-star steps (each a grouped minimum joined back to its
edges) shorten every path to its smallest node in a logarithmic number of
rounds; no component, edge list or node list ever leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, materialize


def _star(edges: DataFrame, large: bool, total: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with each neighbour hung below its centre's minimum,
    and the table of minima. Centres of many of the ``total`` edges meet their
    minimum by broadcast."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "cc-low")
    met = hot_join(both, low, "u", "n", 2 * total)
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct(), low


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long); the
    component is its smallest node. Each round's table replaces the last one's."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "cc")
    before = None
    while (state := mark(now)) != before and state[0]:
        before = state
        for large in (True, False):
            out, low = _star(now, large, state[0])
            after = materialize(out, "cc")
            discard(now)
            discard(low)
            now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
