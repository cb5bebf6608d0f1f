"""Connected components of a table of links, by alternating large and small stars.

Each step is one aggregation (combined before the shuffle) and one join that
Spark can split, so a node with very many links is no task of its own. Links
stay in tables in the shared folder; nothing is collected but two numbers a
round, which show whether anything still changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxigraph.llm.common import through_files


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest in its neighbourhood."""
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return own.unionByName(rest).distinct()


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long, u <> v, either order). Returns u, v: every linked node but its component's smallest, and that smallest."""
    now = through_files(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        after = through_files(_small_star(_large_star(now)), "links")
        new = _state(after)
        if new == state:
            return after
        now, state = after, new
    return now
