"""Claims on ledger rows: which of them collide, and which decision may go without harm.

claims: sheet_id, subject, source (DECISION, CURRENT or GROUP), decision (its key, for claims by decision). A subject may claim a row through several sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """(sheet_id, subjects, resolved, severity, after_confirmation) of rows that several subjects claim.

    A subject is resolved if it holds the row now or by decision. Several resolved ones are CRITICAL; else groups share the row, which is explained (INFO). after_confirmation: a decision is among the claims.
    """
    per_subject = claims.filter("sheet_id is not null").groupBy("sheet_id", "subject").agg(F.max(F.col("source").isin("CURRENT", "DECISION")).alias("resolved"), F.max(F.col("source") == "DECISION").alias("decided"))
    rows = per_subject.groupBy("sheet_id").agg(F.count("*").alias("subjects"), F.count_if("resolved").alias("resolved"), F.max("decided").alias("after_confirmation")).filter("subjects > 1")
    return rows.select("sheet_id", "subjects", "resolved", F.when(F.col("resolved") > 1, "CRITICAL").otherwise("INFO").alias("severity"), "after_confirmation")


def safe_invalidations(claims: DataFrame, statuses: DataFrame, exact: DataFrame) -> DataFrame:
    """Decisions that may be withdrawn: (sheet_id, decision, obsolete, winner, separate_id, decision_status).

    statuses: decision, status, as decisions are judged today; exact: subject, sheet_id, pairs that fit in amount, payment and cycle.

    The proof is what the claims would be without the decision. Of the row's two subjects one claims it by this decision alone, which names no other row, and the other holds it now and fits it exactly: so one
    owner is left. The subject that loses the row either holds another row now, which fits it exactly and which no other subject claims, or its decision is STALE, so that it loses nothing that holds. All
    conditions are counts per row and per subject; nothing is gathered.
    """
    held = claims.filter("sheet_id is not null")
    source = lambda name: F.max(F.col("source") == name).alias(name)
    # Claims and fits are dealt out by row once; of decisions it matters only whether a subject has none, one or more.
    asked = held.select("sheet_id", "subject", "source", "decision", F.lit(True).alias("claimed")).unionByName(exact.select("sheet_id", "subject", F.lit(True).alias("fits")), allowMissingColumns=True).repartition("sheet_id")
    sides = asked.groupBy("sheet_id", "subject").agg(source("CURRENT"), source("GROUP"), F.min("decision").alias("decision"), F.max("decision").alias("last"), F.max("claimed").alias("claimed"), F.max("fits").alias("fits"))
    decisions = F.when(F.col("decision").isNull(), 0).when(F.col("decision") == F.col("last"), 1).otherwise(2)
    whole = Window.partitionBy("sheet_id")
    sides = sides.filter("claimed").withColumn("decisions", decisions).withColumns({"subjects": F.count("*").over(whole), "owners": F.count("subject").over(whole), "of_row": F.sum("decisions").over(whole)})
    firm = F.coalesce(F.col("CURRENT") & ~F.col("GROUP") & F.col("fits") & F.col("subject").isNotNull(), F.lit(False))
    two, one = (F.col("subjects") == 2) & (F.col("of_row") == 1), (F.col("owners") == 1) & firm
    loses = two & (F.col("decisions") == 1) & ~F.col("GROUP") & ~F.col("CURRENT")
    wins = two & (F.col("decisions") == 0) & firm
    kept = cut(sides.select("sheet_id", "subject", "decision", loses.alias("loses"), wins.alias("wins"), one.alias("apart")).filter("loses or wins or apart"))
    single = held.filter("decision is not null").groupBy("decision").agg(F.min("sheet_id").alias("low"), F.max("sheet_id").alias("high")).filter("low = high").select("decision")
    losing = kept.filter("loses").select("sheet_id", F.col("subject").alias("obsolete"), "decision")
    winning = kept.filter("wins").select("sheet_id", F.col("subject").alias("winner"))
    apart = kept.filter("apart").select(F.col("subject").alias("obsolete"), F.col("sheet_id").alias("other"))
    pairs = losing.join(winning, "sheet_id").join(single, "decision", "left_semi").join(statuses.select("decision", F.col("status").alias("decision_status")), "decision", "left").join(apart, "obsolete", "left")
    separate = F.col("other").isNotNull() & (F.col("other") != F.col("sheet_id"))
    proof = pairs.groupBy("sheet_id", "decision", "obsolete", "winner", "decision_status").agg(F.min(F.when(separate, F.col("other"))).alias("separate_id"))
    return proof.filter("separate_id is not null or decision_status = 'STALE'").select("sheet_id", "decision", "obsolete", "winner", "separate_id", "decision_status")
