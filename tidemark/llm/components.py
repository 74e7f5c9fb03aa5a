"""Connected components of a link table by alternating large-star and small-star contraction.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and
Beyond (2014). Links live in tables; the driver sees only counts. Each round's table is
written to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Past this many rounds something is wrong: rounds grow as log2 of the links.
MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour is linked to the smallest node around its centre."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour and the centre are linked to the smallest of them; links point down (u > v)."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it can reach."""
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = stored(down, "links")
    # Stars only, so that no node is on both sides: then each node's one neighbour is its root.
    for _ in range(MOST_ROUNDS):
        inner = down.select(F.col("v").alias("u")).join(down.select("u"), "u", "left_semi").limit(1).count()
        several = 0 if inner else down.groupBy("u").count().where("count > 1").limit(1).count()
        if not inner and not several:
            return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        down = stored(_small_star(_large_star(down)), "links")
    raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
