"""Union-find as Spark jobs: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Alternations of the two star steps; they settle in a few, for chains in about log2 of the length.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(each node's larger neighbours hung on its smallest one, the table of smallest ones).

    The smallest neighbours are written first, so that both sides of the join
    are dealt out for it and a hub's rows can be split among tasks."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that an edge (u, v) of longs names; component is the smallest id reachable.

    Loops and repeated edges count for nothing; ids without an edge to another
    id have no row. Each round writes its edge table, so a lost executor costs
    one round at most, and neither links nor labels pass through the driver but
    for the count of edges that are not yet those of stars, which tells the end."""
    now, saved = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), []
    for _ in range(MAX_ROUNDS):
        hung, least = _large_star(now, scratch)
        after = scratch.save(_small_star(hung), "edges")
        for done in (*saved, least):
            scratch.drop(done)
        now, saved = after, [after]
        # of stars, each node hangs on one centre, and no centre hangs on another
        ends = now.select("u", F.lit(1).alias("hangs")).unionAll(now.select(F.col("v").alias("u"), F.lit(0).alias("hangs")).distinct())
        if ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("rows")).where("hangs > 0 and rows > 1").isEmpty():
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            found = scratch.save(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots), "components")
            scratch.drop(now)
            return found
    raise RuntimeError("components did not settle")
