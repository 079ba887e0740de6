"""Connected components of a link table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest document reachable from each one in ``links`` (a, b).

    Alternates large-star and small-star steps until nothing changes; each step is a
    grouped minimum and a join on documents, so a hub's many links are combined on the
    map side and its join is split by Spark if it is skewed.
    """
    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        # large star: bigger neighbours of each node move to the smallest of its neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = saved(small, "edges")
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    return e.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())
