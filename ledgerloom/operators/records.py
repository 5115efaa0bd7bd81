"""Audits and merges over records: running balances, last-writer-wins decisions, provenance, eligibility and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balance_audit(rows: DataFrame) -> DataFrame:
    """Rows whose reported balance doesn't follow from the one before: statement, source_row, date, expected, reported, difference, gap_days, compensated.

    rows: statement, source_row, date, credit, debit, balance_after. A break is compensated if the next row returns to the balance before it.
    """
    order = Window.partitionBy("statement").orderBy("date", "source_row")
    seen = rows.filter("balance_after is not null").select(
        "*", F.lag("balance_after").over(order).alias("before"), F.lag("date").over(order).alias("date_before"), F.lead("balance_after").over(order).alias("next"), (F.lead("credit").over(order) - F.lead("debit").over(order)).alias("next_move")
    )
    expected = F.col("before") + F.col("credit") - F.col("debit")
    compensated = F.coalesce((F.col("balance_after") + F.col("next_move") == F.col("next")) & (F.col("next") == F.col("before")), F.lit(False))
    return seen.filter(F.col("balance_after") != expected).select(
        "statement", "source_row", "date", expected.alias("expected"), F.col("balance_after").alias("reported"), (F.col("balance_after") - expected).alias("difference"), F.datediff("date", "date_before").alias("gap_days"), compensated.alias("compensated")
    )


def sync_merge(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Last writer wins per key: a local active decision replaces a remote one only if newer; a local tombstone also on a tie. Both: key, updated_ts, state."""
    rank = F.when((F.col("side") == "local") & (F.col("state") == "DELETED"), 2).when(F.col("side") == "remote", 1).otherwise(0)
    both = remote.select("key", "updated_ts", "state", F.lit("remote").alias("side")).unionByName(local.select("key", "updated_ts", "state", F.lit("local").alias("side")))
    return both.groupBy("key").agg(F.max_by(F.struct("updated_ts", "state", "side"), F.struct("updated_ts", rank.alias("rank"))).alias("won")).select("key", "won.*")


def audit_merge(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The audit's merge per key: the newer active decision, remote on a tie; a local tombstone overrides whatever its age."""
    r = remote.select("key", F.col("updated_ts").alias("r_ts"), F.col("state").alias("r_state"))
    x = local.select("key", F.col("updated_ts").alias("l_ts"), F.col("state").alias("l_state"))
    local_wins = F.col("r_ts").isNull() | F.coalesce(F.col("l_state") == "DELETED", F.lit(False)) | F.coalesce(F.col("l_ts") > F.col("r_ts"), F.lit(False))
    return r.join(x, "key", "full").select("key", F.when(local_wins, F.col("l_ts")).otherwise(F.col("r_ts")).alias("updated_ts"), F.when(local_wins, F.col("l_state")).otherwise(F.col("r_state")).alias("state"), F.when(local_wins, "local").otherwise("remote").alias("side"))


def period_filter(rows: DataFrame, date: str, first: str | None = None, last: str | None = None, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of a period; every bound is optional and inclusive."""
    for bound, keep in ((first, F.col(date) >= F.lit(first)), (last, F.col(date) < F.date_add(F.lit(last).cast("date"), 1)), (year, F.year(date) == year), (month, F.month(date) == month)):
        if bound is not None:
            rows = rows.filter(keep)
    return rows


def missing_sources(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys listed before and not now."""
    return previous.select(key).distinct().join(current.select(key), key, "left_anti")


def eligibility(item: dict[str, Column]) -> Column:
    """First reason why a missing item can't be added, or ELIGIBLE. item: source, status, direction, type, in_sheet, added, complete."""
    kind = item["type"]
    absent = F.when(item["source"] == "STATEMENT", item["status"] != "CARD_MISSING").otherwise(item["status"] != "MISSING")
    return (
        F.when(item["added"], "ALREADY_ADDED").when(item["in_sheet"], "ALREADY_IN_SHEET").when(kind == "REFUND", "REFUND").when(item["direction"] != "DEBIT", "NOT_DEBIT")
        .when(kind == "CARD_PAYMENT", "CARD_PAYMENT").when(kind == "TRANSFER", "OUT_OF_SCOPE_TRANSFER").when(kind.isin("INVESTMENT", "INVESTMENT_INCOME"), "OUT_OF_SCOPE_INVESTMENT")
        .when(~kind.isin("PURCHASE", "EXPENSE"), "NOT_EXPENSE").when(absent, "NOT_MISSING").when(~item["complete"], "UNSUPPORTED_WRITE").otherwise("ELIGIBLE")
    )


def totals(bank: DataFrame) -> DataFrame:
    """One row: debit and credit cents and counts."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0))
    return bank.agg(side("DEBIT").alias("debit_total"), side("CREDIT").alias("credit_total"), F.count_if(F.col("direction") == "DEBIT").alias("debits"), F.count("*").alias("transactions"))


def balance_summary(movements: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Per statement: initial, reported and calculated balance, credits, debits, difference and whether it balances; nulls where no balance is known.

    movements: statement, source_row, date, credit, debit, balance_after. excluded: the same columns for rows that were left out but report a balance. The initial balance is the first reported one without its own
    movement, or as it stands if that row was left out; the reported one is the last of a movement.
    """
    cols = ["statement", "date", "source_row", "credit", "debit", "balance_after"]
    points = movements.select(*cols, F.lit(True).alias("included"))
    if excluded is not None:
        points = points.unionByName(excluded.select(*cols, F.lit(False).alias("included")))
    known, place = F.col("balance_after").isNotNull(), F.struct("date", "source_row")
    opening = F.col("balance_after") - F.when(F.col("included"), F.col("credit") - F.col("debit")).otherwise(0)
    out = points.groupBy("statement").agg(
        F.min_by(F.when(known, opening), F.when(known, place)).alias("initial"), F.max_by("balance_after", F.when(known & F.col("included"), place)).alias("reported"),
        F.sum(F.when(F.col("included"), F.col("credit")).otherwise(0)).alias("credits"), F.sum(F.when(F.col("included"), F.col("debit")).otherwise(0)).alias("debits"), F.count_if("included").alias("movements"),
    )
    calculated = F.col("initial") + F.col("credits") - F.col("debits")
    return out.select("statement", "initial", "reported", "credits", "debits", "movements", calculated.alias("calculated"), (F.col("reported") - calculated).alias("difference"), (F.col("reported") == calculated).alias("balanced"))


def missing_expenses(items: DataFrame) -> DataFrame:
    """Items that are missing debits of the type expense. items: status, direction, type."""
    return items.filter("status = 'MISSING' and direction = 'DEBIT' and type = 'EXPENSE'")


def missing_summary(items: DataFrame) -> DataFrame:
    """One row: number and sum of missing expenses."""
    return missing_expenses(items).agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
