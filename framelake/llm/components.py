"""Connected components of a distributed link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import let_go, salted_join, settled_at


def _star(pairs: DataFrame, total: int, large: bool) -> tuple[DataFrame, str]:
    """One step over rows (u, v), ``total`` at most, settled, with its path: each u's smallest neighbour m (itself included) takes over its neighbours above (large) or below u (small).

    The minima are settled too: ``pairs`` and they are read in several places of the plan, which would hold a copy of their own plan for each.
    """
    least, path = settled_at(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")), "least")
    moved = salted_join(pairs, least, "u", total)
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
    out = settled_at(out.where("u <> v").distinct(), "stars")
    let_go(pairs.sparkSession, path)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (columns a, b of type long): component is the smallest id reachable.

    Self-links, repeated links and rows with a null end are ignored. Minima are pre-aggregated before the shuffle and joined back, a hub's
    in many parts, so its links are never gathered; every step is a table in the shared folder, so that a lost executor costs one step at most
    and the driver plans one step at a time, and is deleted when the next one is there.
    """
    spark = links.sparkSession
    tree, path = settled_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct(), "links")
    was, now = None, (tree.count(), None)
    while now != was and now[0]:
        was, old = now, path
        step, step_path = _star(tree.union(tree.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * was[0], True)
        tree, path = _star(step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 2 * was[0], False)
        let_go(spark, old)
        let_go(spark, step_path)
        now = tuple(tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return tree.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tree.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
