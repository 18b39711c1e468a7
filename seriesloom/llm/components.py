"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage


def _joined_to_smallest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of u and all its v as ``m``; a hub's rows are split by the adaptive join.

    The adaptive join splits only where both sides are shuffled for it. So the key of the
    aggregate is made a new value, which hides that its rows are dealt by u already.
    """
    key = F.col("u").bitwiseXOR(F.lit(0).cast("bigint"))
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select(key.alias("s"), F.least("u", "m").alias("m"))
    return edges.join(smallest, F.col("u") == F.col("s")).select("u", "v", "m")


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links``: the smallest node of its component.

    Each round halves the depth of the trees that the links form, so the number of rounds
    grows with the logarithm of the longest chain. Rounds are written as tables; only their
    row count and a checksum come to the driver. Links with a null end are left out.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_to_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _joined_to_smallest(down)
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut_lineage(edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
