"""Queries of single rules: why a row is no purchase, which records are one, which files are read, which decisions count, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.identity import decision_key
from .operators import cards, decisions, views
from .plans.demo import events
from .sources import files


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def card_rejections(spark, sf_dir):
    """Every order as a purchase beside a ledger row that differs from it by the order's number: the first gate that keeps the row out."""
    k = F.col("k")
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.floor("o_totalprice").cast("long").alias("a"))
    parcel = k % 3 == 0
    purchase = {
        "type": F.when(k % 11 == 0, "REFUND").otherwise("PURCHASE"), "amount": F.col("a"), "date": F.col("d"), "due_date": F.date_add("d", 10), "number": F.when(parcel, 2), "total": F.when(parcel, 10),
    }
    row = {
        "direction": F.when(k % 7 == 0, "CREDIT").otherwise("DEBIT"), "payment_method": F.when(k % 5 == 0, "Pix").when(k % 5 == 1, "CRÉDITO BRADESCO").otherwise("Crédito_Bradesco"), "type": F.when(k % 13 == 0, "INVESTMENT").otherwise("EXPENSE"),
        "amount": F.col("a") + F.when(k % 4 == 0, 1).otherwise(0), "number": F.when(parcel & (k % 2 == 0), F.when(k % 9 == 0, 3).otherwise(2)), "total": F.when(parcel & (k % 2 == 0), 10), "date": F.expr("date_add(d, cast(k % 25 as int))"),
    }
    return o.select("k", cards.rejection(purchase, row).alias("gate"))


def same_records(spark, sf_dir):
    """Orders as ledger rows beside a copy in other letters, of another day, amount or text by their number."""
    k = F.col("k")
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.floor("o_totalprice").cast("long").alias("a"))
    left = {"date": F.col("d"), "amount": F.col("a"), "description": F.concat(F.lit("Pão & Café nº "), k.cast("string")), "payment_method": F.lit("Crédito_Bradesco")}
    right = {
        "date": F.when(k % 3 == 0, F.date_add("d", 1)).otherwise(F.col("d")), "amount": F.col("a") + F.when(k % 5 == 0, 1).otherwise(0), "payment_method": F.when(k % 11 == 0, "Pix").otherwise("CREDITO BRADESCO"),
        "description": F.concat(F.when(k % 7 == 0, "PAO CAFE ").otherwise("PAO, CAFE - Nº "), k.cast("string")),
    }
    return o.select("k", views.same_record(left, right).alias("same"))


def live_pairs(spark, sf_dir):
    """Orders and their customers as pairs, of which every third order and every fourth customer is gone."""
    o = _orders(spark, sf_dir)
    pairs = o.select(F.col("o_orderkey").cast("string").alias("bank_id"), F.col("o_custkey").cast("string").alias("sheet_id"))
    bank = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("id"))
    ledger = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("id"))
    return decisions.live_pairs(pairs, bank, ledger)


def _files(spark, sf_dir):
    k = F.col("c_custkey")
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".CSV", ".ofx", ".txt", "", ".pdf.zip"))), (k % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("string").alias("file_id"), F.concat(F.lit("arquivo"), k.cast("string"), ending).alias("name"), F.when(k % 9 == 0, "Text/CSV").when(k % 9 == 1, "application/zip").alias("mime_type"), F.timestamp_seconds(k).alias("modified_time"),
        (k % 50).alias("size"), F.when(k % 4 != 0, F.lit("bank")).alias("kind"), (k % 3).cast("string").alias("folder_id"), F.when(k % 10 != 0, (k % 40).cast("string")).alias("sha256"),
    )


def supported_files(spark, sf_dir):
    return files.supported(_files(spark, sf_dir)).select("file_id")


def changed_files(spark, sf_dir):
    """Customers as files; the index of the last run knows two in three as processed, some of them with another size, another kind or as a failure."""
    k = F.col("file_id").cast("long")
    now = _files(spark, sf_dir)
    index = now.filter(k % 3 != 0).withColumn("size", F.when(k % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("kind", F.when(k % 8 == 0, "bank").otherwise(F.col("kind")))
    return files.changed(now, index.withColumn("processing_status", F.when(k % 7 == 0, "ERROR").otherwise("PROCESSED"))).select("file_id")


def first_copies(spark, sf_dir):
    return files.first_copies(_files(spark, sf_dir)).select("file_id", "copy_of")


def dispatched_statements(spark, sf_dir):
    """Events as files by the rest of their number: an OFX envelope, a delimited text with a header, one without, an envelope without movements, a blank text."""
    k = F.col("event_id")
    body = F.array(
        F.concat(F.lit("OFXHEADER:100\n<OFX><STMTTRN><FITID>"), k.cast("string")), F.concat(F.lit("Data;Histórico;Valor\n01/02/2026;Padaria;"), k.cast("string")), F.concat(F.lit("a;b;c\n1;2;"), k.cast("string")), F.lit("OFXHEADER:100\n<OFX>"), F.lit(" \n"),
    )
    documents = events(spark, sf_dir).select(k.cast("string").alias("file"), F.element_at(body, (k % 5 + 1).cast("int")).alias("content"))
    movements, delimited, errors = files.dispatch(documents)
    return movements.select("file", F.lit("OFX").alias("way")).unionByName(delimited.select("file", F.lit("DELIMITED").alias("way"))).unionByName(errors.select("file", F.col("error").alias("way")))


def _decisions(spark, sf_dir):
    """Orders as decisions about their customer; every ninth is of another version, every eighth has no full time."""
    k = F.col("o_orderkey")
    ids = F.array(k.cast("string"))
    return _orders(spark, sf_dir).select(
        k.alias("k"), decision_key(F.lit("PAIR_CONFIRMED"), ids).alias("key"), F.when(k % 9 == 0, 2).otherwise(1).alias("schema_version"), F.lit("PAIR_CONFIRMED").alias("kind"), ids.alias("identities"),
        F.array(F.col("o_custkey").cast("string")).alias("selected"), F.when(k % 8 == 0, "2026-02").otherwise("2026-02-03T04:05:06.000Z").alias("updated_at"), F.lit("ACTIVE").alias("state"),
    )


def applicable_decisions(spark, sf_dir):
    """Every third key is buried, half of these before the decision was made; every seventh is blocked."""
    made = _decisions(spark, sf_dir)
    gone = made.filter("k % 3 = 0").select("key", F.when(F.col("k") % 2 == 0, "2026-02-03T04:05:06.000Z").otherwise("2026-02-03T04:05:05.999Z").alias("updated_at"))
    return decisions.applicable(made, gone, made.filter("k % 7 = 0").select("key")).select("k")


def buried_decisions(spark, sf_dir):
    """Tombstones of every second decision, on top of older ones for every third key: always later than the decision and the tombstone before."""
    made = _decisions(spark, sf_dir)
    gone = made.filter("k % 3 = 0").select("key", F.when(F.col("k") % 5 == 0, "2027-01-01T00:00:00.000Z").otherwise("2026-01-01T00:00:00.000Z").alias("updated_at"))
    return decisions.bury(made.filter("k % 2 = 0"), gone, "2026-02-03T04:05:06Z")


def superseded_owners(spark, sf_dir):
    """Decisions about card purchases: the order is the purchase, the customer the row; the newest order of each fifth customer confirms its row anew, and every sixth order has lost its purchase."""
    made = _decisions(spark, sf_dir).withColumn("kind", F.lit("STATEMENT_MATCH_CONFIRMED"))
    aliases = made.filter("k % 6 <> 0").select(F.col("identities")[0].alias("identity"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("purchase_id"))
    new = _orders(spark, sf_dir).filter("o_custkey % 5 = 0").groupBy(F.col("o_custkey").cast("string").alias("row")).agg(F.concat(F.lit("p"), F.max("o_orderkey").cast("string")).alias("purchase_id"))
    return decisions.superseded_owners(made, new, aliases)


QUERIES = {
    f.__name__: f
    for f in (card_rejections, same_records, live_pairs, supported_files, changed_files, first_copies, dispatched_statements, applicable_decisions, buried_decisions, superseded_owners)
}

_FILES = """f AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS file_id, 'arquivo' || c_custkey || ['.pdf', '.CSV', '.ofx', '.txt', '', '.pdf.zip'][c_custkey % 6 + 1] AS name,
    CASE WHEN c_custkey % 9 = 0 THEN 'Text/CSV' WHEN c_custkey % 9 = 1 THEN 'application/zip' END AS mime, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 40 END AS sha FROM customer)"""
_KEY = "'PAIR_CONFIRMED:[\"' || o_orderkey || '\"]'"

ORACLE_SQL = {
    "card_rejections": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'NOT_PURCHASE' WHEN o_orderkey % 7 = 0 THEN 'DIRECTION' WHEN o_orderkey % 5 = 0 THEN 'PAYMENT_METHOD' WHEN o_orderkey % 13 = 0 THEN 'NATURE' WHEN o_orderkey % 4 = 0 THEN 'AMOUNT'
        WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'NO_INSTALLMENT' WHEN o_orderkey % 9 = 0 THEN 'INSTALLMENT' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 25 > 7 AND o_orderkey % 25 <> 10 THEN 'DATE' END AS gate FROM orders""",
    "same_records": "SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS same FROM orders",
    "live_pairs": "SELECT o_orderkey::VARCHAR AS bank_id, o_custkey::VARCHAR AS sheet_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)",
    "supported_files": f"WITH {_FILES} SELECT file_id FROM f WHERE k % 6 < 3 OR k % 9 = 0",
    "changed_files": "SELECT c_custkey::VARCHAR AS file_id FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 8 = 0 OR c_custkey % 7 = 0",
    "first_copies": f"WITH {_FILES}, w AS (SELECT *, first_value(file_id) OVER (PARTITION BY sha ORDER BY name, file_id) AS head FROM f) SELECT file_id, CASE WHEN sha IS NOT NULL AND head <> file_id THEN head END AS copy_of FROM w",
    "dispatched_statements": "SELECT event_id::VARCHAR AS file, ['OFX', 'DELIMITED', 'UNKNOWN_LAYOUT', 'UNKNOWN_LAYOUT', 'EMPTY_FILE'][event_id % 5 + 1] AS way FROM events",
    "applicable_decisions": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AND o_orderkey % 7 <> 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)",
    "buried_decisions": f"""SELECT {_KEY} AS key, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 15 = 0 THEN '2027-01-01T00:00:00.001Z' WHEN o_orderkey % 8 = 0 THEN '2026-02-03T04:05:06.000Z' ELSE '2026-02-03T04:05:06.001Z' END
        WHEN o_orderkey % 5 = 0 THEN '2027-01-01T00:00:00.000Z' ELSE '2026-01-01T00:00:00.000Z' END AS updated_at FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
    "superseded_owners": f"""WITH n AS (SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders WHERE o_custkey % 5 = 0 GROUP BY 1)
        SELECT {_KEY} AS key FROM orders JOIN n ON c = o_custkey WHERE o_orderkey % 6 = 0 OR o_orderkey <> k""",
}
