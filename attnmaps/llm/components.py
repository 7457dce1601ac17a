"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import settle


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is its component's least node.

    Each round points every node to the least node it knows of, as aggregated minima
    and equi-joins only; the rounds are logarithmic in the number of nodes. Each round is
    written to the shared folder; the driver sees a count and a checksum.
    """
    at = settle(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(at)
    while before[0]:
        both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = settle(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(at)
        if now == before:
            break
        before = now
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
