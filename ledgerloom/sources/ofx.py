"""Bank statements in OFX: one row per transaction, by text functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_amount


def _tag(block: Column, name: str) -> Column:
    """Value of an SGML element up to the next tag or line end; null if absent or blank."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?i)<{name}>([^<\r\n]*)", 1)), F.lit(""))


def _day(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """parse() of the files under a path."""
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content")))


def parse(documents: DataFrame) -> DataFrame:
    """Transactions of documents (file, content): (file, row, date, amount in signed cents, direction, fitid, document, memo, name, period_start, period_end, ledger_balance).

    Files without transactions give no rows; a transaction without a valid date or amount keeps nulls there.
    """
    files = documents.select("file", F.col("content").alias("value"))
    blocks = F.regexp_extract_all("value", F.lit(r"(?is)<STMTTRN>(.*?)(?=<STMTTRN>|</STMTTRN>|</BANKTRANLIST>)"), F.lit(1))
    rows = files.select("file", _day(_tag(F.col("value"), "DTSTART")).alias("period_start"), _day(_tag(F.col("value"), "DTEND")).alias("period_end"), normalize_amount(_tag(F.col("value"), "BALAMT")).alias("ledger_balance"), F.posexplode(blocks).alias("row", "block"))
    block = F.col("block")
    amount = normalize_amount(_tag(block, "TRNAMT"))
    return rows.select(
        "file", "row", _day(_tag(block, "DTPOSTED")).alias("date"), amount.alias("amount"), F.when(amount < 0, "DEBIT").when(amount >= 0, "CREDIT").alias("direction"), _tag(block, "FITID").alias("fitid"), _tag(block, "CHECKNUM").alias("document"),
        _tag(block, "MEMO").alias("memo"), _tag(block, "NAME").alias("name"), "period_start", "period_end", "ledger_balance",
    )
