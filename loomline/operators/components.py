"""Connected components of a graph held as a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.shared import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Links every node to the least node next to each of its smaller neighbours."""
    both = links.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(links.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
    least = both.groupBy("node").agg(F.min("near").alias("near")).select(F.col("node").alias("lo"), F.least("node", "near").alias("least"))
    return links.join(least, "lo").select("hi", F.col("least").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links every node and all its smaller neighbours to the least of these."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = links.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of a component of two or more, with the least node of the component as root.

    ``links`` has one row per undirected link; order, repeats and loops don't matter, and a null end makes no link.
    Each round is a few joins on node ids and ends with a checkpoint. The rounds needed grow with the logarithm of
    the longest chain. Only two numbers of each round reach the driver.
    """
    links = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    links = cut(links)
    before = None
    for _ in range(max_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, links = state, cut(_small_star(_large_star(links)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
