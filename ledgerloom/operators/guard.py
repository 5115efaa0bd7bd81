"""The last look before a missing row is written: the ledger as it is now is searched again, and whatever answers the row keeps it out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut
from . import cards
from .matching import CONFIG, MatchConfig, candidate_edges


def _none(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def bank_guard(pending: DataFrame, bank: DataFrame, ledger: DataFrame, rejected: DataFrame | None = None, taken: DataFrame | None = None, config: MatchConfig = CONFIG) -> DataFrame:
    """(bank_id, allowed, candidates, free, best_id) of pending bank rows (bank_id).

    Any plausible row of the ledger that the user hasn't refused for this bank row keeps it out, also one that another row has taken: two movements may have been meant, and the user must say so. free counts those
    that nobody has taken; best_id is the one with the highest score, a free one first. A pending row that is no longer in bank isn't allowed. ledger: as it is now; rejected: bank_id, sheet_id; taken: sheet_id,
    bank_id of the rows that other subjects hold.
    """
    asked = pending.select("bank_id").distinct()
    edges = candidate_edges(bank.join(asked.withColumnRenamed("bank_id", "id"), "id", "left_semi"), ledger, config).select("bank_id", "sheet_id", "score")
    open_ = edges if rejected is None else edges.join(rejected.select("bank_id", "sheet_id").distinct(), ["bank_id", "sheet_id"], "left_anti")
    # A row is busy if its first or its last holder is another; no list of holders goes along with the pairs.
    held = (taken if taken is not None else _none(bank, "sheet_id string, bank_id string")).groupBy("sheet_id").agg(F.min("bank_id").alias("one"), F.max("bank_id").alias("other"))
    rows = open_.join(held, "sheet_id", "left").withColumn("busy", F.coalesce((F.col("one") != F.col("bank_id")) | (F.col("other") != F.col("bank_id")), F.lit(False)))
    told = rows.groupBy("bank_id").agg(F.count("*").alias("candidates"), F.count_if(~F.col("busy")).alias("free"), F.min(F.struct("busy", (-F.col("score")).alias("minus"), "sheet_id")).alias("best"))
    known = bank.select(F.col("id").alias("bank_id"), F.lit(True).alias("known")).distinct()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return asked.join(told, "bank_id", "left").join(known, "bank_id", "left").select("bank_id", (F.col("known").isNotNull() & (n("candidates") == 0)).alias("allowed"), n("candidates").alias("candidates"), n("free").alias("free"), F.col("best.sheet_id").alias("best_id"))


def invoice_guard(
    pending: DataFrame, purchases: DataFrame, statements: DataFrame, ledger: DataFrame, refunded: DataFrame | None = None, confirmed: DataFrame | None = None, rejected: DataFrame | None = None
) -> DataFrame:
    """(purchase_id, allowed, status, candidates) of pending purchases (purchase_id).

    All invoices are matched again with the ledger as it is now, in the order of their due dates, so that rows which earlier invoices take are gone for later ones. A purchase is kept out unless it's still
    missing and no plausible row of the ledger is left that the user hasn't refused for it. The other tables are those of cards.purchase_states() and cards.consume().
    """
    pairs = cards.plausible_rows(purchases, ledger, keep=False)
    states = cut(cards.purchase_states(purchases, ledger, refunded, confirmed, rejected, pairs=pairs))
    after = cards.consume(states, statements, confirmed=confirmed)
    asked = pending.select("purchase_id").distinct()
    open_ = pairs.join((rejected if rejected is not None else _none(purchases, "purchase_id string, sheet_id string")).select("purchase_id", "sheet_id").distinct(), ["purchase_id", "sheet_id"], "left_anti")
    left = open_.join(asked, "purchase_id", "left_semi").groupBy("purchase_id").agg(F.count("*").alias("candidates"))
    n = F.coalesce("candidates", F.lit(0))
    rows = asked.join(after.select("purchase_id", "status"), "purchase_id", "left").join(left, "purchase_id", "left")
    return rows.select("purchase_id", F.coalesce((F.col("status") == "CARD_MISSING") & (n == 0), F.lit(False)).alias("allowed"), "status", n.alias("candidates"))
