"""Connected components of a link table, by alternating large and small stars.

Each round is two groupings by node.  A node with a third of all links is
combined on the map side for its least neighbour, and the join that hands the
least neighbour back splits skewed partitions, so no task gathers a node's links.
Nothing is collected: the driver sees one count and one checksum per round.

Defined results: a link with a null end or from a node to itself is none; repeated links
count once; no links give an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.llm.storage import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v). Large: u's larger neighbours go to the least of u and all its neighbours. Small: its smaller ones do."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, label): label is the least node reachable; nodes without links are absent."""
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    seen = before = None
    for _ in range(rounds):
        now = scratch.write(_star(_star(now, True), False))
        if before is not None:
            scratch.remove(before)
        before = now
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return scratch.stands_for(now.select(F.col("u").alias("node"), F.col("v").alias("label")), now)
