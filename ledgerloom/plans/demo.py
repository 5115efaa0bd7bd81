"""Projections of the driver's tables onto bank and ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bank_rows(spark: SparkSession, sf_dir: str, cents: bool = True) -> DataFrame:
    """purchase events as debits, error events as refund credits; whole units give denser amounts."""
    amount = F.floor(F.col("value") * (100 if cents else 1) + 0.5).cast("long")
    debit = F.col("event_type") == "purchase"
    return events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").cast("string").alias("id"), F.to_date("ts").alias("date"), amount.alias("amount"), F.when(debit, "DEBIT").otherwise("CREDIT").alias("direction"), F.lit(True).alias("direction_known"),
        F.when(debit, "EXPENSE").otherwise("REFUND").alias("type"), F.when(debit, "pix enviado").otherwise("estorno pix").alias("original_description"), F.lit(None).cast("string").alias("counterparty_name"), F.lit("Pix").alias("payment_method"),
    )


def mixed_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purchase and error events as bank rows of every type, in tenths, by the last digits of the event."""
    k, is_debit = F.col("event_id"), F.col("event_type") == "purchase"
    kind = F.when(~is_debit, "REFUND").when(k % 20 == 0, "OTHER").when(k % 20 == 1, "INVESTMENT").when(k % 20 == 2, "TRANSFER").when(k % 20 == 3, "CARD_PAYMENT").when(k % 20 == 4, "INCOME").otherwise("EXPENSE")
    said = F.when(~is_debit, "estorno pix").when(k % 20 == 0, "lancamento diverso").when(k % 20 == 1, "aplicacao cdb").when(k % 3 == 0, "PIX ENVIADO").when(k % 3 == 1, "Pix enviado Padaria Central").otherwise("Compra Mercado Sul")
    return events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error")).select(
        k.cast("string").alias("id"), F.to_date("ts").alias("date"), F.floor(F.col("value") * 10 + 0.5).cast("long").alias("amount"), F.when(is_debit & (k % 20 != 4), "DEBIT").otherwise("CREDIT").alias("direction"), (k % 17 != 0).alias("direction_known"),
        kind.alias("type"), said.alias("original_description"), F.when(k % 5 == 0, "Padaria Central").alias("counterparty_name"), F.when(k % 3 == 2, "Débito").otherwise("Pix").alias("payment_method"),
    )


def mixed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view events as ledger rows: investments, transfers and expenses with several payment methods, in tenths."""
    k = F.col("event_id")
    kind = F.when(k % 12 == 0, "INVESTMENT").when(k % 12 == 1, "TRANSFER").otherwise("EXPENSE")
    paid = F.when(k % 12 == 0, "Investimento").when(k % 12 == 1, "Transferência").when(k % 4 == 0, "Crédito_Bradesco").when(k % 4 == 1, "Débito").otherwise("Pix")
    said = F.element_at(F.array(*map(F.lit, ("padaria central", "mercado sul", "farmacia popular", "mercado"))), (k % 4 + 1).cast("int"))
    return events(spark, sf_dir).filter("event_type = 'view'").select(
        k.cast("string").alias("id"), k.alias("row_idx"), F.to_date("ts").alias("date"), F.floor(F.col("value") * 10 + 0.5).cast("long").alias("amount"), F.lit("DEBIT").alias("direction"), kind.alias("type"), said.alias("original_description"),
        said.alias("description"), paid.alias("payment_method"),
    )
