"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of texts -> (v, c): every vertex with the smallest vertex that it reaches.

    In each round a vertex takes the smallest label around it and then that label's own label, so the number of rounds grows with the logarithm of the longest path. Only minima per
    vertex are shuffled besides the links; nothing is gathered.
    """
    ends = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(ends.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("c")).withColumnRenamed("a", "v"))
    while True:
        around = ends.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(around, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumped = cut(lower.join(labels.select(F.col("v").alias("c"), F.col("c").alias("up")), "c").select("v", "old", F.least("c", "up").alias("c")))
        labels = jumped.select("v", "c")
        if jumped.filter("c <> old").isEmpty():
            return labels


def first_claims(claims: DataFrame) -> DataFrame:
    """Claims that hold when they are taken in order and none may use what an earlier one holds: (claim).

    claims: claim, place (its order; claims of one place don't exclude each other), id (what it wants, one row for each), fixed (holds whatever came before) and, where known, wishes (how much it wants). A thing that is
    wanted only by claims without another wish goes to the first of them. For the rest, in each round the claims that come first on all they want hold, and later claims on the same things fall, so the number of
    rounds is that of the longest chain of claims that wait for one another.
    """
    if "wishes" not in claims.columns:
        claims = claims.withColumn("wishes", F.count("*").over(Window.partitionBy("claim")))
    whole = Window.partitionBy("id")
    rows = claims.filter("id is not null").withColumns({"plain": F.max("wishes").over(whole) == 1, "first": F.min("place").over(whole)})
    # Claims that fell already are not written.
    rows = cut(rows.filter("not plain or fixed or place = first").select("claim", F.when(~F.col("plain"), F.col("place")).alias("place"), F.when(~F.col("plain"), F.col("id")).alias("id"), "plain", "fixed"))
    settled = rows.filter("plain").select("claim")
    open_ = rows.filter("not plain and not fixed").select("claim", "place", "id")
    held = rows.filter("not plain and fixed").select("claim", "place", "id")
    while not open_.isEmpty():
        before = held.groupBy("id").agg(F.min("place").alias("held"))
        fallen = open_.join(before, "id").filter(F.col("place") > F.col("held")).select("claim").distinct()
        left = open_.join(fallen, "claim", "left_anti")
        first = left.groupBy("id").agg(F.min("place").alias("first"))
        won = left.join(first, "id").groupBy("claim").agg(F.min(F.col("place") == F.col("first")).alias("won")).filter("won").select("claim")
        won = left.join(won, "claim", "left_semi")
        held = cut(held.unionByName(won))
        open_ = cut(left.join(won.select("claim").distinct(), "claim", "left_anti"))
    return held.select("claim").unionByName(settled).distinct()
