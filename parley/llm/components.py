"""Connected components of a table of links, without collecting links or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _state(edges: DataFrame) -> tuple:
    """Count and two digests: equal before and after a round only if nothing moved."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that a link names, root being the smallest node reachable.

    Large-star and small-star rounds by turns: each hangs nodes on smaller ones, until
    every node hangs on its component's smallest. A round's table is written to the
    shared folder, and a node's many links are only ever aggregated or joined, which
    splits hot nodes. Empty links give an empty table.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    edges = staged(links.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where("hi <> lo").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
        new = staged(small.select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo")).where("hi <> lo").distinct(), "small-star")
        drop_staged(large)
        drop_staged(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(edges.select("lo", "lo").distinct())
