"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, settle


def connected(links: DataFrame, rounds: int = 50, hub: int = 1000) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node it reaches.

    Large star, then small star, until the set of links stands still; an error if ``rounds`` do not suffice.
    Nodes of more than ``hub`` links (and one link in 10,000) do not gather them in one task.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(links)
    for _ in range(rounds):
        if not before[0]:
            break
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
        large = join_hot(both, low, "a", "c", before[0], least=hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        star = join_hot(large, small, "a", "c", before[0], least=hub).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        links = settle(star.where("a <> b").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"links did not come to rest in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
