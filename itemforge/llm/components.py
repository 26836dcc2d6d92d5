"""Connected components of an edge table, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.shared import forget, settle


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): rows (id, root) for every id with an edge, root being the smallest id it reaches.

    Each round turns an edge (u, v), u > v, into (v, p(u)) and (u, p(p(u))), with p(u) the smallest neighbour below u,
    until only stars around the roots are left; every round is settled in the shared folder. A hub's edges share the
    smaller end, which is never a grouping key before partial aggregation; Spark splits its join partition.
    Nulls and loops are dropped; an empty table gives no rows.
    """
    spark = edges.sparkSession
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter((F.col("u") != F.col("v")) & F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    before, rows = None, now.count()
    while True:
        lowest = now.groupBy("u").agg(F.min("v").alias("p"))
        next_ = lowest.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = lowest.join(next_, "p", "left").select("u", F.coalesce("pp", "p").alias("v"))
        joined = now.join(lowest, "u").filter(F.col("v") > F.col("p")).select(F.col("v").alias("u"), F.col("p").alias("v"))
        new = settle(jumped.union(joined).distinct(), 2 * rows)  # an edge gives two at most
        size = new.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        now, rows = new, size[0]
        if tuple(size) == before:
            forget(spark)
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).union(
                now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_anti").select("v", F.col("v").alias("root")))
        before = tuple(size)
