"""Connected components of a link table by repeated joins; no link list ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """links (a, b) -> (v, c): every vertex with the smallest vertex reachable from it.

    Every round each vertex takes the smallest label among its neighbours and then its label's label, so labels
    travel twice as far each time. Self links and repeated links change nothing; no links give no rows.
    """
    scratch = scratch or Scratch(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(both.filter("a <> b").distinct())
    labels = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")))
    while True:
        nearest = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("c").alias("m"))
        hooked = labels.join(nearest, labels.v == nearest.a).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        roots = labels.select(F.col("v").alias("r"), F.col("c").alias("up"))
        moved = scratch.keep(hooked.join(roots, hooked.c == roots.r).select("v", "old", F.least("c", "up").alias("c")))
        labels = moved.select("v", "c")
        if moved.filter("c <> old").isEmpty():
            return labels
