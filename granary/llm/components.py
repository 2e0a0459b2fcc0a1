"""Connected components of a table of links by alternating large and small stars.

Each round points every node's neighbours at the smallest node it knows, first the
larger neighbours, then the smaller ones, until every link is a leaf's link to the
smallest node of its component. Nothing but two counts of a round reaches the driver.
Hubs are pre-aggregated to their smallest neighbour, and the join that hands it back is
one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(links: DataFrame) -> DataFrame:
    """Links of each node's larger neighbours to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links, each from the larger node (u) to the smaller (v), to the smallest such neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for each node that has a link (u, v), itself excluded."""
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = common.settle(now, "links"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = common.settle(_small(_large(now)), "links")
