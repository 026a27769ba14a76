"""Connected components of an edge table by alternating large-star and small-star rounds, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, split_join, table


#: Edges from which hubs are looked for: below, no node can burden a task.
MANY = 1 << 20


def _star(e: DataFrame, large: bool, n: int) -> DataFrame:
    """e: n distinct rows a > b. Links every neighbour above (large) or at most equal (small) of a node to its least neighbour. The neighbours of a hub stay where they are and only its least one is sent to them."""
    near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    least = near.groupBy("a").agg((F.least(F.min("b"), F.first("a")) if large else F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    if n >= MANY:
        least = table(least, "least")
        met = split_join(near, least.drop("n"), "a", least, n)
    else:
        met = near.join(least.drop("n"), "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge and the least node that it reaches; roots are there too. Edges may repeat, point both ways or be loops; empty edges give an empty table."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    cur = table(e, "edges")
    was = mark(cur)
    while was[0]:
        new = table(_star(_star(cur, True, was[0]), False, was[0]), "edges")
        drop(cur)
        now, cur = mark(new), new
        if now == was:
            break
        was = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
