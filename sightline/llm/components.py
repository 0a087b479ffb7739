"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is two shuffles of the links; a node with very many links costs one combined row per task
where the minimum is taken, and is split as a skewed partition where links are rewritten. The
link table is written to the shared folder after each round, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, release, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node of its neighbourhood."""
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(merged(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them."""
    near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    moved = near.join(merged(least), "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
    return moved.select("e.*").where("a < b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b), the label being the least node of its component.

    Ends when a round changes nothing, which needs a number of rounds in the order of the logarithm
    of the number of nodes.
    """
    now = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before, now = now, stored(_small_star(_large_star(now)), "links")
        release(before)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Count and hash sum of a link table, equal for equal tables."""
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
