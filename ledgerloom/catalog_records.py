"""Queries over imports, cards, audits, decisions and source overlaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import decision_key, fingerprint
from .operators import audit, cards, decisions, overlap
from .plans.demo import events
from .sources import delimited, files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


def statement_import(spark, sf_dir):
    """Each event as a statement file of its own: a title, the header, one movement and a total."""
    money = F.translate(F.format_number("value", 2), ",.", ".,")
    side = F.when(F.col("event_type") == "purchase", F.concat(F.lit(";"), money)).otherwise(F.concat(money, F.lit(";")))
    row = F.concat_ws(";", F.date_format("ts", "dd/MM/yyyy"), F.lit("Pix enviado"), F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"')), side, F.lit(""))
    content = F.concat_ws("\n", F.lit("Extrato"), F.lit("Data;Histórico;Docto.;Crédito (R$);Débito (R$);Saldo (R$)"), row, F.lit("Total;;;0,00;0,00;"))
    lines = delimited.rows(events(spark, sf_dir).select(F.col("event_id").cast("string").alias("file"), content.alias("content")))
    parsed = delimited.bank_rows(delimited.companions(delimited.sections(lines)))
    return parsed.select("file", "line", "row_class", "date", "amount", "direction", "bank_transaction_id")


def row_fingerprints(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fingerprint(F.to_date("ts"), F.col("event_type"), _cents("value")).alias("fingerprint"))


def _purchases(spark, sf_dir):
    """Purchase events as card purchases due ten days later."""
    none = F.lit(None).cast("int")
    return events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("statement"), F.lit("1").alias("card"), F.to_date("ts").alias("date"), F.date_add(F.to_date("ts"), 10).alias("due_date"), F.lit("loja central").alias("description"),
        _cents("value").alias("amount"), F.lit("PURCHASE").alias("type"), F.lit("DEBIT").alias("direction"), none.alias("number"), none.alias("total"),
    )


def _costs(spark, sf_dir):
    none = F.lit(None).cast("int")
    return events(spark, sf_dir).filter("event_type = 'view'").select(
        F.col("event_id").cast("string").alias("id"), F.to_date("ts").alias("date"), F.lit("loja central").alias("description"), _cents("value").alias("amount"), F.lit("DEBIT").alias("direction"), F.lit("EXPENSE").alias("type"),
        F.lit("Crédito_Bradesco").alias("payment_method"), none.alias("number"), none.alias("total"),
    )


def card_candidates(spark, sf_dir):
    return cards.candidates(_purchases(spark, sf_dir), _costs(spark, sf_dir)).select("purchase_id", "sheet_id", "amount", "on_due", "days", "previous_cycle")


def card_purchase_states(spark, sf_dir):
    return cards.purchase_states(_purchases(spark, sf_dir), _costs(spark, sf_dir)).select("purchase_id", "status", "sheet_id", "candidates")


def card_refunds(spark, sf_dir):
    """Line items of odd orders as purchases, of even ones as credits; suppliers as statements."""
    odd = F.col("l_orderkey") % 2 == 1
    rows = _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("statement"), F.lit(None).cast("string").alias("card"), F.to_date("l_shipdate").alias("date"), F.lit("Loja").alias("description"), F.lit(1).alias("amount"),
        F.when(odd, "PURCHASE").otherwise("REFUND").alias("type"), F.when(odd, "DEBIT").otherwise("CREDIT").alias("direction"), F.lit(None).cast("int").alias("number"),
    )
    return cards.refunds(rows)


def installment_refunds(spark, sf_dir):
    """The line items of an order as instalments; every third order is returned in one credit."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("amount"))
    sums = line.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("total"), F.sum("amount").alias("sum"))
    shape = [F.col("l_orderkey").alias("statement"), F.lit("1").alias("card"), F.lit("2026-01-01").cast("date").alias("date"), F.lit("loja").alias("description")]
    bought = line.join(sums.select("l_orderkey", "total"), "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), *shape, "amount", F.lit("PURCHASE").alias("type"), F.lit("DEBIT").alias("direction"), F.col("l_linenumber").alias("number"), "total")
    none = F.lit(None).cast("int")
    back = sums.filter("l_orderkey % 3 = 0").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("id"), *shape, F.col("sum").alias("amount"), F.lit("REFUND").alias("type"), F.lit("CREDIT").alias("direction"), none.alias("number"), none.alias("total"))
    return cards.installment_refunds(bought.unionByName(back)).select("refund_id", F.array_join("purchase_ids", ",").alias("purchases"), "amount")


def invoice_payments(spark, sf_dir):
    """Even orders as invoices, odd ones as payments, in hundreds."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("amount"))
    invoices = rows.filter("k % 2 = 0").select(F.col("k").alias("statement"), F.col("day").alias("due_date"), F.col("amount").alias("total"))
    return cards.payment_candidates(invoices, rows.filter("k % 2 = 1").select(F.col("k").alias("id"), F.col("day").alias("date"), "amount", F.lit("CARD_PAYMENT").alias("type")))


def _card_rows(spark, sf_dir):
    credit = F.col("o_orderpriority").startswith("1")
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement"), F.col("o_orderpriority").alias("card"), _cents("o_totalprice").alias("amount"), F.when(credit, "CREDIT").otherwise("DEBIT").alias("direction"))


def invoice_checks(spark, sf_dir):
    """Invoices of customers; every fifth reports one cent too much in debits, every seventh in total."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0))
    rows = _card_rows(spark, sf_dir)
    invoices = rows.groupBy("statement").agg((side("DEBIT") + F.when(F.col("statement") % 5 == 0, 1).otherwise(0)).alias("debits"), side("CREDIT").alias("credits"))
    invoices = invoices.select("*", F.lit(0).cast("long").alias("previous_balance"), (F.col("debits") - F.col("credits") + F.when(F.col("statement") % 7 == 0, 1).otherwise(0)).alias("total"))
    return cards.invoice_checks(invoices, rows)


def card_subtotals(spark, sf_dir):
    return cards.card_subtotals(_card_rows(spark, sf_dir))


def provenance(spark, sf_dir):
    """Customers as rows whose source has their number; orders as sources, every fiftieth of which names a row that doesn't exist."""
    entities = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_custkey").alias("source_ids"))
    named = F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1_000_000_000_000).otherwise(0)
    sources = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.array(named).alias("entity_ids"))
    found = audit.provenance(entities.select(F.col("id").cast("string").alias("id"), F.col("source_ids").cast("array<string>").alias("source_ids")), sources.select(F.col("source_id").cast("string").alias("source_id"), F.col("entity_ids").cast("array<string>").alias("entity_ids")))
    return found.select("code", "severity", "subject", F.array_join("related", ",").alias("related"))


def duplicate_movements(spark, sf_dir):
    """Line items as movements; the line number is the source, and for every fifth part the next number as well."""
    n = F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_partkey") % 5 == 0, F.array(n, n + 1)).otherwise(F.array(n)).alias("source_ids"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("amount"), F.col("l_returnflag").alias("direction"), F.lit("x").alias("original_description")
    )
    return audit.duplicates_across_sources(rows).select("date", "amount", "direction", "id")


def source_conflicts(spark, sf_dir):
    """The first and second lines of an order as one document in two sources."""
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("source_id"), F.col("l_orderkey").cast("string").alias("document"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("amount"), F.col("l_returnflag").alias("direction"), F.lit(None).cast("long").alias("balance_after")
    )
    return audit.source_conflicts(rows, "1", "2").select("document", F.array_join("differs", ",").alias("differs"))


def double_claims(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("sheet_id"), (F.col("l_linenumber") == 1).alias("confirmed"))
    return audit.double_claims(rows)


def _findings(spark, sf_dir):
    """Orders as bank rows whose states, links, candidates and refunds follow from their keys."""
    k = F.col("o_orderkey")
    items = _table(spark, sf_dir, "orders").select(
        k.alias("k"), k.cast("string").alias("bank_id"), F.when(k % 3 == 0, "MATCHED").when(k % 3 == 1, "REVIEW").otherwise("MISSING").alias("status"), F.when(k % 4 == 0, "ASSIGNMENT_CONFLICT").alias("review_reason"),
        F.when(k % 5 != 0, F.col("o_custkey").cast("string")).alias("sheet_id"), F.lit(None).cast("array<string>").alias("composition"), F.when(k % 7 == 0, "CARD_PAYMENT").otherwise("EXPENSE").alias("type"), F.lit("DEBIT").alias("direction"),
        F.when(k % 19 == 0, "Gastos cartão de crédito").otherwise("x").alias("text"),
    )
    edges = items.filter("k % 2 = 0").select("bank_id", F.explode(F.array(F.lit("REJECTED_BY_DECISION"), F.when(F.col("k") % 10 == 0, "REJECTED_BY_DECISION").otherwise("AVAILABLE"))).alias("disposition"))
    claims = items.select(F.col("bank_id").alias("subject"), "sheet_id", F.lit(False).alias("confirmed")).filter("sheet_id like '%7'")
    refunds = items.select(F.when(F.col("k") % 23 == 0, "REFUNDED").otherwise("PARTIAL").alias("status"), F.array("bank_id").alias("original_ids"))
    return audit.state_findings(items.drop("k"), edges, claims, refunds)


def audit_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("code", "severity", "subject")


def _card_findings(spark, sf_dir):
    """Orders as card purchases: recomputed states that differ from those shown, references to rows that went or changed, missing ones with candidates; every second decision is newer than its tombstone."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(k, F.concat(F.lit("c"), k.cast("string")).alias("purchase_id"))
    state = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int")).alias("status")
    pure, now = rows.select("purchase_id", state(("CARD_MATCHED", "CARD_MISSING", "CARD_REVIEW"), 3)), rows.select("purchase_id", state(("CARD_MISSING", "CARD_REVIEW", "CARD_MATCHED", "CARD_GROUP_MATCHED"), 4))
    found = [audit.card_state_findings(pure, now, rows.filter(k % 2 == 0).select("purchase_id"))]
    for code, severity, test in (("ORPHANED_SHEET_REFERENCE", "REVIEW", k % 10 == 5), ("ORPHANED_SHEET_REFERENCE", "INFO", k % 10 == 0), ("EDITED_SHEET_REFERENCE", "INFO", k % 7 == 0), ("MISSING_COM_CANDIDATO", "CRITICAL", k % 11 == 0), ("NEWER_TOMBSTONE_EXISTS", "INFO", k % 13 == 0), ("UNUSED_STRONG_CANDIDATE", "REVIEW", k % 6 == 0)):
        found.append(audit._finding(rows.filter(test), code, severity, F.col("purchase_id")))
    return audit.union([_findings(spark, sf_dir), *found])


def audit_summary(spark, sf_dir):
    return audit.audit_summary(audit.lifecycle(audit.enrich(_card_findings(spark, sf_dir))))


def audit_collapsed(spark, sf_dir):
    return audit.collapse(_card_findings(spark, sf_dir)).select("subject", "code", "severity", F.array_join("others", ",").alias("others"))


def table_revision(spark, sf_dir):
    return audit.revision(_table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


def _decisions(spark, sf_dir):
    """Orders as decisions that pair an order with a customer; some are malformed or repeat a kind's key."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "PAIR_REJECTED").when(k % 4 == 1, "PAIR_CONFIRMED").when(k % 4 == 2, "BANK_IGNORED").otherwise("SHEET_IGNORED")
    bank, sheet = k.cast("string"), F.col("o_custkey").cast("string")
    ids = F.when(kind == "PAIR_REJECTED", F.array(bank, sheet)).when(kind == "SHEET_IGNORED", F.array(sheet)).otherwise(F.array(bank))
    rows = _table(spark, sf_dir, "orders").select(k.alias("n"), kind.alias("kind"), ids.alias("identities"), F.when(kind == "PAIR_CONFIRMED", F.array(sheet)).otherwise(F.array().cast("array<string>")).alias("selected"))
    stamp = F.when(F.col("n") % 11 == 0, "2026-02-30T00:00:00Z").otherwise("2026-02-03T04:05:06Z")
    return rows.select("n", F.when(F.col("n") % 13 == 0, "x").otherwise(decision_key(F.col("kind"), F.col("identities"))).alias("key"), F.lit(1).alias("schema_version"), "kind", "identities", "selected", stamp.alias("updated_at"), F.lit("ACTIVE").alias("state"))


def decision_validity(spark, sf_dir):
    return _decisions(spark, sf_dir).select("n", decisions.is_valid().alias("valid"))


def _decided_rows(spark, sf_dir):
    """Orders as bank rows and customers as ledger rows of one day; amounts follow from their keys."""
    text = lambda t: F.lit(t).cast("string")
    return tuple(
        _table(spark, sf_dir, t).select(
            F.col(k).cast("string").alias("id"), F.lit("2026-01-01").cast("date").alias("date"), (F.col(k) % 3).alias("amount"), F.lit("DEBIT").alias("direction"), F.lit(True).alias("direction_known"), F.lit("EXPENSE").alias("type"), F.lit("x").alias("original_description"),
            text(None).alias("counterparty_name"), F.lit("Pix").alias("payment_method"),
        )
        for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"))
    )


def decision_pairs(spark, sf_dir):
    return decisions.confirmed_pairs(_decisions(spark, sf_dir), *_decided_rows(spark, sf_dir))


def decision_status(spark, sf_dir):
    out = decisions.status(_decisions(spark, sf_dir).filter("n % 13 <> 0"), *_decided_rows(spark, sf_dir))
    return out.groupBy("kind", "status").agg(F.count("*").alias("n"))


def overlap_merge(spark, sf_dir):
    """Line items as movements; the first lines of orders as one export, the second lines as another in the same format without documents."""
    rows = _table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(
        "l_linenumber", F.col("l_orderkey").alias("row_idx"), F.col("l_orderkey").cast("string").alias("id"), F.to_date("l_shipdate").alias("date"), F.lit("DEBIT").alias("direction"), F.col("l_quantity").cast("long").alias("amount"),
        F.lit("").alias("document"), F.lit("CSV").alias("format"), F.concat(F.lit("loja "), F.col("l_returnflag")).alias("original_description"),
    )
    return overlap.overlaps(rows.filter("l_linenumber = 1"), rows.filter("l_linenumber = 2"))


def file_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(k.alias("file_id"), F.when(k % 5 == 0, "SKIPPED").alias("result"), (k % 2).alias("processed"), (k % 3).alias("duplicates"), (k % 7).alias("errors"))
    return files.outcome_summary(files.outcomes(rows))


QUERIES = {
    f.__name__: f
    for f in (statement_import, row_fingerprints, card_candidates, card_purchase_states, card_refunds, installment_refunds, invoice_payments, invoice_checks, card_subtotals, provenance, duplicate_movements, source_conflicts, double_claims, audit_findings, audit_summary, audit_collapsed, table_revision, decision_validity, decision_pairs, decision_status, overlap_merge, file_outcomes)
}

_CARDS = """e AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS d, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount, event_type FROM events),
    p AS (SELECT b.id AS purchase_id, s.id AS sheet_id, b.amount, s.d = b.d + 10 AS on_due, CAST(abs(s.d - b.d) AS INTEGER) AS days, (year(b.d + 10) - year(s.d)) * 12 + month(b.d + 10) - month(s.d) = 1 AND abs(day(b.d + 10) - day(s.d)) <= 3 AS previous_cycle
        FROM e b JOIN e s ON b.amount = s.amount AND b.event_type = 'purchase' AND s.event_type = 'view' AND (s.d = b.d + 10 OR abs(s.d - b.d) <= 7)),
    c AS (SELECT * FROM p QUALIFY on_due OR NOT bool_or(on_due) OVER (PARTITION BY purchase_id))"""
_FINDINGS = """i AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'REVIEW' ELSE 'MISSING' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS sheet FROM orders),
    f AS (SELECT 'MATCHED_WITHOUT_LINK' AS code, 'CRITICAL' AS severity, subject FROM i WHERE status = 'MATCHED' AND sheet IS NULL
        UNION ALL SELECT 'REVIEW_WITHOUT_CANDIDATES', 'REVIEW', subject FROM i WHERE status = 'REVIEW' AND sheet IS NULL
        UNION ALL SELECT 'ASSIGNMENT_CONFLICT', 'REVIEW', subject FROM i WHERE status = 'REVIEW' AND k % 4 = 0 AND sheet IS NOT NULL
        UNION ALL SELECT CASE WHEN k % 10 = 0 THEN 'EXPECTED_MANUAL_REJECTION' ELSE 'MISSING_WITH_STRONG_CANDIDATE' END, CASE WHEN k % 10 = 0 THEN 'INFO' ELSE 'CRITICAL' END, subject FROM i WHERE status = 'MISSING' AND k % 7 <> 0 AND k % 2 = 0
        UNION ALL SELECT 'CARD_PAYMENT_AS_EXPENSE_MISSING', 'CRITICAL', subject FROM i WHERE status = 'MISSING' AND (k % 7 = 0 OR k % 19 = 0)
        UNION ALL SELECT 'REFUNDED_BUT_MISSING', 'CRITICAL', subject FROM i WHERE status = 'MISSING' AND k % 23 = 0
        UNION ALL SELECT 'DOUBLE_CLAIM', 'CRITICAL', sheet FROM i WHERE sheet LIKE '%7' GROUP BY sheet HAVING count(DISTINCT subject) > 1)"""
_CARD_FINDINGS = """o AS (SELECT o_orderkey AS k, 'c' || o_orderkey AS s, ['CARD_MATCHED', 'CARD_MISSING', 'CARD_REVIEW'][o_orderkey % 3 + 1] AS pure, ['CARD_MISSING', 'CARD_REVIEW', 'CARD_MATCHED', 'CARD_GROUP_MATCHED'][o_orderkey % 4 + 1] AS now FROM orders),
    g AS (SELECT code, severity, subject FROM f
        UNION ALL SELECT 'DERIVED_STATE_MISMATCH', CASE WHEN pure = 'CARD_MATCHED' AND now = 'CARD_MISSING' OR pure = 'CARD_MISSING' AND now IN ('CARD_MATCHED', 'CARD_GROUP_MATCHED') OR pure = 'CARD_REVIEW' AND now = 'CARD_MISSING' AND k % 2 = 0 THEN 'CRITICAL'
            WHEN pure = 'CARD_REVIEW' AND now = 'CARD_GROUP_MATCHED' THEN 'INFO' ELSE 'REVIEW' END, s FROM o WHERE pure <> now
        UNION ALL SELECT 'ORPHANED_SHEET_REFERENCE', CASE WHEN k % 10 = 5 THEN 'REVIEW' ELSE 'INFO' END, s FROM o WHERE k % 5 = 0 UNION ALL SELECT 'EDITED_SHEET_REFERENCE', 'INFO', s FROM o WHERE k % 7 = 0
        UNION ALL SELECT 'MISSING_COM_CANDIDATO', 'CRITICAL', s FROM o WHERE k % 11 = 0 UNION ALL SELECT 'NEWER_TOMBSTONE_EXISTS', 'INFO', s FROM o WHERE k % 13 = 0 UNION ALL SELECT 'UNUSED_STRONG_CANDIDATE', 'REVIEW', s FROM o WHERE k % 6 = 0)"""
_DECISIONS = "k AS (SELECT o_orderkey AS n, o_custkey AS c, CASE o_orderkey % 4 WHEN 0 THEN 'PAIR_REJECTED' WHEN 1 THEN 'PAIR_CONFIRMED' WHEN 2 THEN 'BANK_IGNORED' ELSE 'SHEET_IGNORED' END AS kind FROM orders)"

ORACLE_SQL = {
    "statement_import": """SELECT CAST(event_id AS VARCHAR) AS file, CAST(3 AS INTEGER) AS line, 'TRANSACTION' AS row_class, CAST(ts AS DATE) AS date, CAST(floor(round(value, 2) * 100 + 0.5) AS BIGINT) AS amount,
        CASE WHEN event_type = 'purchase' THEN 'DEBIT' ELSE 'CREDIT' END AS direction, 'doc:' || event_id AS bank_transaction_id FROM events
        UNION ALL SELECT CAST(event_id AS VARCHAR), 4, 'FOOTER_OR_METADATA', NULL, 0, 'DEBIT', NULL FROM events""",
    "card_candidates": f"WITH {_CARDS} SELECT * FROM c",
    "card_purchase_states": f"""WITH {_CARDS}, w AS (SELECT c.*, count(*) OVER (PARTITION BY sheet_id, user_id) AS wanted FROM c JOIN events ON purchase_id = CAST(event_id AS VARCHAR)),
        b AS (SELECT purchase_id, count(*) AS n, min(sheet_id) AS sheet, bool_and(wanted = 1 AND (on_due OR days <= 3 AND (days = 0 OR NOT previous_cycle))) AS sure FROM w GROUP BY 1),
        s AS (SELECT e.id AS purchase_id, CASE WHEN n IS NULL THEN 'CARD_MISSING' WHEN n = 1 AND sure THEN 'CARD_MATCHED' ELSE 'CARD_REVIEW' END AS status, sheet, coalesce(n, 0) AS candidates FROM e LEFT JOIN b ON e.id = b.purchase_id WHERE event_type = 'purchase')
        SELECT purchase_id, status, CASE WHEN status = 'CARD_MATCHED' THEN sheet END AS sheet_id, candidates FROM s""",
    "card_refunds": """SELECT min(CASE WHEN l_orderkey % 2 = 1 THEN l_orderkey || '-' || l_linenumber END) AS purchase_id, min(CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey || '-' || l_linenumber END) AS refund_id
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE) HAVING count(*) = 2 AND sum(l_orderkey % 2) = 1""",
    "installment_refunds": """SELECT 'r' || l_orderkey AS refund_id, string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY l_linenumber) AS purchases, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount
        FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey HAVING count(*) > 1 AND count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*)""",
    "invoice_payments": """WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 100) AS BIGINT) AS a FROM orders)
        SELECT i.k AS statement, b.k AS bank_id, CAST(abs(b.d - i.d) AS INTEGER) AS days, abs(b.a - i.a) AS cents, CAST(row_number() OVER (PARTITION BY i.k ORDER BY abs(b.d - i.d), abs(b.a - i.a), b.d, b.k) AS INTEGER) AS rank
        FROM r i JOIN r b ON i.k % 2 = 0 AND b.k % 2 = 1 AND abs(b.a - i.a) <= 1 AND abs(b.d - i.d) <= 7""",
    "invoice_checks": """WITH s AS (SELECT o_custkey AS statement, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END) AS BIGINT) AS d, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS c FROM orders GROUP BY 1),
        r AS (SELECT *, d + CASE WHEN statement % 5 = 0 THEN 1 ELSE 0 END AS x, CASE WHEN statement % 7 = 0 THEN 1 ELSE 0 END AS y FROM s),
        u AS (SELECT statement, 'DEBITS' AS "check", x AS expected, d AS actual FROM r UNION ALL SELECT statement, 'CREDITS', c, c FROM r UNION ALL SELECT statement, 'EQUATION', x - c + y, x - c FROM r UNION ALL SELECT statement, 'LINES', 0, 0 FROM r)
        SELECT statement, "check", expected = actual AS ok, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual FROM u""",
    "card_subtotals": "SELECT o_custkey AS statement, o_orderpriority AS card, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) * CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE 1 END) AS BIGINT) AS net, count(*) AS n FROM orders GROUP BY 1, 2",
    "provenance": """SELECT 'SOURCE_POINTS_TO_MISSING_ENTITY' AS code, 'REVIEW' AS severity, CAST(o_custkey + 1000000000000 AS VARCHAR) AS subject, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS related FROM orders WHERE o_orderkey % 50 = 0 GROUP BY o_custkey
        UNION ALL SELECT 'ACTIVE_ENTITY_WITHOUT_SOURCE', 'REVIEW', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)""",
    "duplicate_movements": """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS amount, l_returnflag AS direction, CASE WHEN l_partkey % 5 = 0 THEN [l_linenumber, l_linenumber + 1] ELSE [l_linenumber] END AS src, l_orderkey || '-' || l_linenumber AS id FROM lineitem),
        s AS (SELECT DISTINCT date, amount, direction, src FROM r)
        SELECT date, amount, direction, id FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.date = r.date AND s.amount = r.amount AND s.direction = r.direction AND NOT list_has_any(s.src, r.src))""",
    "source_conflicts": """WITH o AS (SELECT l_linenumber AS s, l_orderkey AS k, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS d, min(CAST(l_quantity AS BIGINT)) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
        j AS (SELECT CAST(a.k AS VARCHAR) AS document, concat_ws(',', CASE WHEN a.d <> b.d THEN 'date' END, CASE WHEN a.q <> b.q THEN 'amount' END, CASE WHEN a.f <> b.f THEN 'direction' END) AS differs FROM o a JOIN o b ON a.k = b.k AND a.s = 1 AND b.s = 2 AND a.n = 1 AND b.n = 1)
        SELECT * FROM j WHERE differs <> ''""",
    "double_claims": """WITH c AS (SELECT l_partkey AS sheet_id, l_orderkey, bool_or(l_linenumber = 1) AS sure FROM lineitem GROUP BY 1, 2) SELECT sheet_id, count(*) AS owners, count(*) FILTER (sure) AS confirmed FROM c GROUP BY 1 HAVING count(*) > 1""",
    "audit_findings": f"WITH {_FINDINGS} SELECT * FROM f",
    "audit_summary": f"""WITH {_FINDINGS}, {_CARD_FINDINGS}, r AS (
            SELECT code, severity, CASE WHEN code LIKE 'EXPECTED_%' THEN 'EXPECTED' WHEN severity = 'INFO' THEN 'INFO' WHEN code IN ('ASSIGNMENT_CONFLICT', 'UNUSED_STRONG_CANDIDATE') THEN 'RELATED' ELSE 'PRIMARY' END AS role,
                CASE WHEN code IN ('ASSIGNMENT_CONFLICT', 'UNUSED_STRONG_CANDIDATE', 'MISSING_COM_CANDIDATO', 'MISSING_WITH_STRONG_CANDIDATE') THEN 'RECONCILIATION_ASSIGNMENT' WHEN code = 'DOUBLE_CLAIM' THEN 'OWNERSHIP' ELSE code END || ':' || subject AS cause FROM g
        ) SELECT count(DISTINCT cause) FILTER (severity = 'CRITICAL') AS critical, count(DISTINCT cause) FILTER (severity = 'REVIEW') AS review, count(DISTINCT cause) FILTER (severity = 'INFO' AND code IN ('ORPHANED_SHEET_REFERENCE', 'EDITED_SHEET_REFERENCE')) AS maintenance,
            count(DISTINCT cause) FILTER (code = 'NEWER_TOMBSTONE_EXISTS') AS legacy, count(DISTINCT cause) FILTER (severity = 'INFO') AS informational, count(DISTINCT cause) FILTER (severity <> 'INFO') AS attention FROM r WHERE role <> 'RELATED'""",
    "audit_collapsed": f"""WITH {_FINDINGS}, {_CARD_FINDINGS}, h AS (SELECT *, CASE WHEN code IN ('DERIVED_STATE_MISMATCH', 'ORPHANED_SHEET_REFERENCE', 'EDITED_SHEET_REFERENCE', 'MISSING_COM_CANDIDATO') THEN '' ELSE code END AS about FROM g),
        g2 AS (SELECT subject, about, min((CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END, code)) AS top, list_sort(list(DISTINCT code)) AS codes FROM h GROUP BY 1, 2)
        SELECT subject, top[2] AS code, CASE top[1] WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'REVIEW' ELSE 'INFO' END AS severity, array_to_string(list_filter(codes, lambda c: c <> top[2]), ',') AS others FROM g2""",
    "row_fingerprints": """WITH t AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) || chr(31) || event_type || chr(31) || CAST(floor(value * 100 + 0.5) AS BIGINT) AS s FROM events),
        u AS (SELECT event_id, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::UBIGINT) AS c, list_transform(range(1, length(s) + 1), lambda i: (ord(s[i]) + i - 1)::UBIGINT) AS p FROM t),
        h AS (SELECT event_id, list_reduce(list_prepend(2166136261::UBIGINT, c), lambda h, x: (xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS a, list_reduce(list_prepend(2654435769::UBIGINT, p), lambda h, x: (xor(h, x) * 2246822507::UBIGINT) & 4294967295::UBIGINT) AS b FROM u)
        SELECT event_id, lower(lpad(to_hex(a), 8, '0') || lpad(to_hex(b), 8, '0')) AS fingerprint FROM h""",
    "table_revision": """SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 15) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS revision FROM orders""",
    "decision_validity": "SELECT o_orderkey AS n, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS valid FROM orders",
    "decision_pairs": "SELECT CAST(o_orderkey AS VARCHAR) AS bank_id, CAST(o_custkey AS VARCHAR) AS sheet_id, count(*) OVER (PARTITION BY o_custkey) > 1 AS conflicting FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 3 = o_custkey % 3",
    "decision_status": f"""WITH {_DECISIONS}, s AS (SELECT kind, CASE WHEN n % 11 = 0 THEN 'INVALID' WHEN kind IN ('BANK_IGNORED', 'SHEET_IGNORED') OR n % 3 = c % 3 THEN 'VALID' ELSE 'STALE' END AS status FROM k WHERE n % 13 <> 0)
        SELECT kind, status, count(*) AS n FROM s GROUP BY 1, 2""",
    "overlap_merge": """WITH r AS (SELECT l_linenumber AS s, l_orderkey AS id, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem WHERE l_linenumber <= 2),
        k AS (SELECT s, d, q, count(*) AS n, min(id) AS id, min(f) AS f FROM r GROUP BY 1, 2, 3), t AS (SELECT s, d, q, f, count(*) AS n, min(id) AS id FROM r GROUP BY 1, 2, 3, 4),
        one AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.s = 1 AND b.s = 2 AND a.d = b.d AND a.q = b.q AND a.n = 1 AND b.n = 1 AND a.f = b.f)
        SELECT CAST(a.id AS VARCHAR) AS known_id, CAST(b.id AS VARCHAR) AS incoming_id, CASE WHEN (a.id, b.id) IN (SELECT (a, b) FROM one) THEN 'SINGLE' ELSE 'TEXT' END AS how
        FROM t a JOIN t b ON a.s = 1 AND b.s = 2 AND a.d = b.d AND a.q = b.q AND a.f = b.f AND a.n = 1 AND b.n = 1""",
    "file_outcomes": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'SKIPPED' WHEN o_orderkey % 2 > 0 THEN 'PROCESSED' WHEN o_orderkey % 3 > 0 THEN 'DUPLICATE' WHEN o_orderkey % 7 > 0 THEN 'ERROR' ELSE 'PROCESSING_ERROR' END AS status, count(*) AS files FROM orders GROUP BY 1""",
}
