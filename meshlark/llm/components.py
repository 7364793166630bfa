"""Connected components of a distributed list of links, by alternating large and small stars.

Each round is two joins on the links alone; a star's centre is found with partial minima, so a centre with very many
neighbours costs no task more than its share. Links are written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshlark.llm.common import forget, written


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links(u, v) to (node, component), component being the least node that can be reached; only nodes with links."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    links = written(ordered)
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both).withColumn("m", F.least("u", "m")), "u").filter("v > u AND v != m")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_nearest(large), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = written(small.select("x.u", "x.v").filter("u > v").distinct())
        forget(links)
        links = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
