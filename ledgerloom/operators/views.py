"""What a dashboard shows of a reconciliation, which sources are active, and what may be written to the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import friendly_label, normalize_description

# Payment methods of the ledger.
PAYMENT_METHODS = ["Pix", "Débito", "Débito automático", "Investimento", "Crédito_Bradesco"]


def inferred_payment(description: Column, source: Column) -> Column:
    """Payment method of a row to be written: the card for invoices, else what the text suggests, or an empty text."""
    return F.when(source == "STATEMENT", "Crédito_Bradesco").otherwise(friendly_label(description)["payment"])


def same_record(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Whether two ledger rows are one record: equal date and amount, and equal text and payment method but for accents, case and punctuation."""
    plain = lambda c: F.trim(F.regexp_replace(normalize_description(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return (left["date"] == right["date"]) & (left["amount"] == right["amount"]) & (plain(left["description"]) == plain(right["description"])) & (plain(left["payment_method"]) == plain(right["payment_method"]))


def to_append(pending: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pending rows that the ledger doesn't hold yet, so that a repeated write changes nothing. Both: date, amount, description, payment_method; rows that repeat each other count once."""
    key = lambda df: df.withColumn("_text", normalize_description(F.coalesce("description", F.lit("")))).withColumn("_paid", normalize_description(F.coalesce("payment_method", F.lit(""))))
    cols = ["date", "amount", "_text", "_paid"]
    return key(pending).join(key(ledger).select(*cols).distinct(), cols, "left_anti").dropDuplicates(cols).drop("_text", "_paid")


def writable(pending: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending bank rows that no plausible ledger row answers but refused ones. pending: bank_id; edges: bank_id, disposition."""
    return pending.join(edges.filter("disposition <> 'REJECTED_BY_DECISION'").select("bank_id"), "bank_id", "left_anti")


def unmatched_view(unmatched: DataFrame, states: DataFrame, ignored: DataFrame) -> DataFrame:
    """Unmatched ledger rows that no invoice took and no decision set aside. unmatched: id; states: status, sheet_id, sheet_ids of card purchases; ignored: sheet_id."""
    taken = states.filter("status in ('CARD_MATCHED', 'CARD_GROUP_MATCHED')").select(F.explode(F.array_compact(F.concat(F.array("sheet_id"), F.coalesce("sheet_ids", F.array().cast("array<string>"))))).alias("id"))
    return unmatched.join(taken, "id", "left_anti").join(ignored.select(F.col("sheet_id").alias("id")), "id", "left_anti")


def active_sources(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """Entries with those of their drive files that are still listed; one without any and without a manual source goes. entries: drive_ids, manual_ids (null where there are none); listed: file_id."""
    named = entries.withColumn("_row", F.monotonically_increasing_id()).select("_row", *entries.columns)
    files = named.select("_row", F.posexplode("drive_ids").alias("_at", "file_id")).join(listed.select("file_id").distinct(), "file_id").groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "file_id"))), lambda x: x["file_id"]).alias("_kept"))
    out = named.join(files, "_row", "left").withColumn("drive_ids", F.coalesce("_kept", F.array().cast("array<string>")))
    return out.filter((F.size("drive_ids") > 0) | (F.size(F.coalesce("manual_ids", F.array().cast("array<string>"))) > 0)).select(entries.columns)


def counter_divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, bank_id) of items that only one of two lists holds."""
    only = lambda a, b, side: a.select("bank_id").distinct().join(b.select("bank_id"), "bank_id", "left_anti").select(F.lit(side).alias("side"), "bank_id")
    return only(left, right, "LEFT").unionByName(only(right, left, "RIGHT"))


def metrics(items: DataFrame) -> DataFrame:
    """One row: items by status, without card payments among those matched; yields are income of the automatic investment. items: status, type, amount, subtype."""
    return items.agg(
        F.count_if((F.col("status") == "MATCHED") & (F.col("type") != "CARD_PAYMENT")).alias("matched"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_if(F.col("status") == "MISSING").alias("missing"),
        F.count_if(F.col("status") == "OUT_OF_SCOPE").alias("out_of_scope"), F.coalesce(F.sum(F.when((F.col("status") == "OUT_OF_SCOPE") & (F.col("subtype") == "INVEST_FACIL_YIELD"), F.col("amount"))), F.lit(0)).alias("yield_total"),
    )


def batch_totals(rows: DataFrame, adjustments: DataFrame) -> DataFrame:
    """One row: number and sum of purchases, refunds and adjustments of a batch of invoices. rows: type, amount; adjustments: amount, direction."""
    side = lambda t: (F.count_if(F.col("type") == t), F.coalesce(F.sum(F.when(F.col("type") == t, F.col("amount"))), F.lit(0)))
    (np, sp), (nr, sr) = side("PURCHASE"), side("REFUND")
    signed = F.when(F.col("direction") == "DEBIT", F.col("amount")).otherwise(-F.col("amount"))
    extra = adjustments.agg(F.count("*").alias("adjustments"), F.coalesce(F.sum(signed), F.lit(0)).alias("adjusted"))
    return rows.agg(np.alias("purchases"), sp.alias("purchased"), nr.alias("refunds"), sr.alias("refunded")).crossJoin(F.broadcast(extra))  # one row each


def choices(ledger: DataFrame, column: str) -> DataFrame:
    """Distinct filled values of a column, sorted."""
    value = F.trim(F.col(column).cast("string"))
    return ledger.select(value.alias(column)).filter(F.col(column) != "").distinct().orderBy(column)


def matrix_problems(rows: DataFrame) -> DataFrame:
    """Problems that stop a read of the ledger sheet: (line, problem). rows: line, description, date, amount, category, payment_method, id as text. Rows without any of them are checkboxes only and no records."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    any_ = F.lit(False)
    for c in ("description", "date", "amount", "category", "payment_method", "id"):
        any_ = any_ | filled(c)
    records = rows.filter(any_)
    absent = F.array_compact(F.array(*(F.when(~filled(c), F.lit(f"MISSING_{c.upper()}")) for c in ("description", "date", "amount", "id"))))
    lost = records.select("line", F.explode(absent).alias("problem"))
    named = records.filter(filled("id")).select("line", F.trim("id").alias("id"))
    twice = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").join(named, "id").select("line", F.lit("DUPLICATE_ID").alias("problem"))
    return lost.unionByName(twice)


def new_ids(rows: DataFrame, existing: DataFrame, key: str, tries: int = 32) -> DataFrame:
    """rows with new_id: eight hexadecimal digits from a hash of the key and the try, the first try that no ledger row and no earlier row has; null if none of them is free. existing: id."""
    wish = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("n")).withColumn("new_id", F.substring(F.sha2(F.concat_ws("/", F.col(key).cast("string"), "n"), 256), 1, 8))
    free = wish.join(existing.select(F.lower(F.trim("id")).alias("new_id")).distinct(), "new_id", "left_anti")
    owner = free.groupBy("new_id").agg(F.min(F.struct("n", key)).alias("first")).select("new_id", F.col("first.n").alias("n"), F.col(f"first.{key}").alias(key))
    return rows.join(owner.groupBy(key).agg(F.min_by("new_id", "n").alias("new_id")), key, "left")
