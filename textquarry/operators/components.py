"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node named by a link with the smallest node of its component.

    Large-star and small-star steps connect each node's neighbours to its smallest one until nothing
    changes; both aggregate a minimum before the shuffle, and hubs are only joined by key, never gathered.
    Links that are null on either side or loops are ignored; an empty table gives an empty one.
    """
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "links")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.where("m < u").select("u", F.col("m").alias("v"))
        large = large.where("u <> v").unionByName(kept).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "links")
        if _same(edges, new):
            break
        edges = new
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _same(old: DataFrame, new: DataFrame) -> bool:
    """Whether two edge tables are equal, by count and two sums of hashes."""
    def sums(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003))), F.bit_xor(F.xxhash64("v", "u"))).first()

    return tuple(sums(old)) == tuple(sums(new))
