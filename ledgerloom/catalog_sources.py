"""Queries of statement sources, remote decisions and invariants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_records import _FINDINGS, _findings
from .functions.identity import decision_key, fingerprint
from .operators import audit, decisions
from .plans.demo import events
from .sources import files, ofx


def _cents():
    return F.floor(F.col("value") * 100 + 0.5).cast("long")


def _ofx(spark, sf_dir):
    """The events of each user as one statement; every third has a check number, every seventh no closing tag of its own."""
    c, k = _cents(), F.col("event_id")
    sign = F.when(F.col("event_type") == "error", "").otherwise("-")
    money = F.concat(sign, (F.floor(c / 100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    check = F.when(k % 3 == 0, F.concat(F.lit("<CHECKNUM>"), k.cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("<STMTTRN>\n<DTPOSTED>"), F.date_format("ts", "yyyyMMdd"), F.lit("120000\n<TRNAMT>"), money, F.lit("\n<FITID>F"), k.cast("string"), F.lit("\n"), check, F.lit("<MEMO>Pix enviado\n"), F.when(k % 7 == 0, "").otherwise("</STMTTRN>\n"))
    head = "OFXHEADER:100\n<OFX><BANKMSGSRSV1><BANKTRANLIST><DTSTART>20200101<DTEND>20301231\n"
    rows = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", body.alias("b")))), lambda x: x["b"]), "").alias("b"))
    return rows.select("file", F.concat(F.lit(head), "b", F.lit("</BANKTRANLIST><LEDGERBAL><BALAMT>12,34</LEDGERBAL></OFX>")).alias("content"))


def ofx_rows(spark, sf_dir):
    return ofx.parse(_ofx(spark, sf_dir)).select("file", "row", "date", "amount", "direction", "fitid", "document", "memo", "period_start", "ledger_balance")


def statement_formats(spark, sf_dir):
    """Formats of OFX statements, of single events as delimited lines, and of blank texts."""
    lines = events(spark, sf_dir).select(F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat_ws(";", "ts", "event_type")).alias("content"))
    both = _ofx(spark, sf_dir).select("content").unionByName(lines)
    return both.groupBy(files.statement_format(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


def remote_decisions(spark, sf_dir):
    """Orders as rows of the remote table: some with another id, an impossible time, no list, or an id that repeats."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderkey").agg(F.max("o_custkey").alias("c"))
    ids = F.array(k.cast("string"))
    key = decision_key(F.lit("PAIR_CONFIRMED"), ids)
    stamp = F.when(k % 5 == 0, "2026-02-30T00:00:00Z").otherwise("2026-02-03T04:05:06Z")
    rows = o.select(
        k.alias("line"), F.when(k % 11 == 0, "x").when(k % 7 == 0, "same").otherwise(fingerprint(key)).alias("decision_id"), F.lit("PAIR_CONFIRMED").alias("kind"), fingerprint(k.cast("string")).alias("subject"), F.lit("ACTIVE").alias("status"),
        F.when(k % 13 == 0, "oops").otherwise(F.to_json(ids)).alias("related"), F.to_json(F.struct(F.array(F.col("c").cast("string")).alias("selected"))).alias("metadata"), F.lit("2026-01-01T00:00:00-03:00").alias("created_at"), stamp.alias("updated_at"), F.lit("1").alias("version"),
    )
    return decisions.remote_rows(rows).select("line", "issue")


def invariant_status(spark, sf_dir):
    """The fourteen invariants over the findings of orders; the sources of two have mixed revisions or are missing, one has no subjects."""
    n = F.col("id") + 1
    facts = spark.range(14).select(F.concat(F.lit("INV-"), F.lpad(n.cast("string"), 2, "0")).alias("invariant"), (n != 10).alias("applicable"), (n == 5).alias("mixed"), (n == 7).alias("unavailable"))
    return audit.invariant_executions(audit.enrich(_findings(spark, sf_dir)), facts)


QUERIES = {f.__name__: f for f in (ofx_rows, statement_formats, remote_decisions, invariant_status)}

ORACLE_SQL = {
    "ofx_rows": """SELECT CAST(user_id AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS row, CAST(ts AS DATE) AS date, CAST(floor(value * 100 + 0.5) AS BIGINT) * CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS amount,
        CASE WHEN event_type = 'error' OR floor(value * 100 + 0.5) = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS direction, 'F' || event_id AS fitid, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS document, 'Pix enviado' AS memo, DATE '2020-01-01' AS period_start, CAST(1234 AS BIGINT) AS ledger_balance FROM events""",
    "statement_formats": "SELECT 'OFX' AS format, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT CASE WHEN event_id % 5 = 0 THEN 'EMPTY' ELSE 'DELIMITED' END, count(*) FROM events GROUP BY 1",
    "remote_decisions": """WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY CASE WHEN k % 11 = 0 THEN 'x' WHEN k % 7 = 0 THEN 'same' ELSE k::VARCHAR END) AS n FROM o)
        SELECT k AS line, CASE WHEN n > 1 THEN 'DUPLICATE_REMOTE_DECISION_ID' WHEN k % 5 = 0 THEN 'INVALID_DECISION_TIMESTAMP' WHEN k % 13 = 0 OR k % 11 = 0 OR k % 7 = 0 THEN 'INVALID_REMOTE_DECISION_ROW' END AS issue FROM n""",
    "invariant_status": f"""WITH {_FINDINGS}, e AS (SELECT severity, CASE code WHEN 'DOUBLE_CLAIM' THEN 1 WHEN 'MATCHED_WITHOUT_LINK' THEN 8 WHEN 'CARD_PAYMENT_AS_EXPENSE_MISSING' THEN 5 WHEN 'REFUNDED_BUT_MISSING' THEN 6 ELSE 3 END AS i FROM f),
        g AS (SELECT i, count(*) AS n, count(*) FILTER (severity <> 'INFO') AS o FROM e GROUP BY i)
        SELECT 'INV-' || lpad(r.i::VARCHAR, 2, '0') AS invariant, CASE WHEN r.i = 10 THEN 'NOT_APPLICABLE' WHEN r.i = 5 THEN 'SKIPPED_DUE_TO_REVISION' WHEN r.i = 7 THEN 'UNAVAILABLE' WHEN coalesce(o, 0) > 0 THEN 'EXECUTED_FAIL' ELSE 'EXECUTED_PASS' END AS status, coalesce(n, 0) AS findings
        FROM (SELECT unnest(range(1, 15)) AS i) r LEFT JOIN g ON g.i = r.i""",
}
