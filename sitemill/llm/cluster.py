"""Session helpers shared by the operators: lineage cuts and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node of the links with the smallest node it reaches: columns node, root.

    Alternating star contraction: every node hooks its larger neighbours, then its smaller ones, to its
    smallest neighbour, so that paths shrink by a factor a round. A round holds no more rows than there are
    links, minima are combined before each shuffle, and each round is written to the checkpoint folder.
    Null ends and self links are dropped; an empty input gives an empty result."""
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    )
    links = cut_lineage(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = cut_lineage(small.select("e.*").where("u <> v").distinct())
        # settled once every node has one link and no root has one of its own
        state = small.groupBy("u").count().join(small.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(True)), "u", "left")
        unsettled = not state.where("count > 1 OR root").isEmpty()
        links = small
        if not unsettled:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
