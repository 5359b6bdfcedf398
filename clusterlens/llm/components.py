"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.staging import stage


def _with_min(pairs: DataFrame) -> DataFrame:
    """``u, v`` and ``m``: the smallest of ``u`` and all its ``v``."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_min(down).select("u", "v", "m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u, v``) that is not its component's smallest.

    Each round hangs neighbours below smaller nodes until only stars are left; the rounds grow with
    the logarithm of the longest chain.  Every round's links are written to the shared folder.
    """
    now = stage(links.select("u", "v").where("u <> v").distinct(), "links")
    last = None
    while True:
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1L))")).first())
        if state == last or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = state
        now = stage(_small(_large(now)), "links")
