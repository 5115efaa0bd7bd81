"""Queries of decisions, findings, exports and dashboard views over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_invoices import _GROUPS, _group_states
from .catalog_matching import _STATE, _reconciled
from .catalog_records import _FINDINGS, _findings
from .operators import audit, cards, decisions, groups, views
from .plans.demo import events, mixed_bank, mixed_ledger
from .plans.shared import cut
from .sources import export


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bank(spark, sf_dir):
    return mixed_bank(spark, sf_dir).withColumn("bank_transaction_id", F.concat(F.lit("t"), "id"))


def export_missing(spark, sf_dir):
    out = export.missing_export(_reconciled(spark, sf_dir).settled, _bank(spark, sf_dir))
    return out.toDF("day", "text", "money", "side", "payment", "id")


def export_out_of_scope(spark, sf_dir):
    out = export.out_of_scope_export(_reconciled(spark, sf_dir).settled.filter("sheet_id is null"), _bank(spark, sf_dir), mixed_ledger(spark, sf_dir))
    return out.toDF("day", "text", "side", "type", "money", "sheet")


def export_summary(spark, sf_dir):
    """All metrics but the number of unmatched ledger rows, which depends on which of several best assignments is taken."""
    r, ledger = _reconciled(spark, sf_dir), mixed_ledger(spark, sf_dir)
    out = export.summary_export(r.settled, _bank(spark, sf_dir), ledger, r.unmatched, groups.duplicate_members(ledger))
    return out.toDF("metric", "value").filter("metric <> 'Não encontrados no extrato'")


def export_lines(spark, sf_dir):
    """Customers as lines of an export, with quotes in a cell and an empty one."""
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", export.csv_line([F.col("c_custkey"), F.concat(F.lit('a "b" '), "c_name"), F.lit(None).cast("string"), export.money(F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long"))]).alias("line"))


def finding_roots(spark, sf_dir):
    """Findings by category, invariant and role."""
    return audit.enrich(_findings(spark, sf_dir)).groupBy("code", "category", "invariant", "role").agg(F.count("*").alias("n"), F.count_distinct("root_cause").alias("causes"))


def finding_groups(spark, sf_dir):
    """Primary findings of each subject with what they absorb."""
    return audit.group_by_cause(audit.enrich(_findings(spark, sf_dir))).groupBy("code", "role", F.array_join("related_codes", ",").alias("related")).agg(F.count("*").alias("n"))


def finding_final(spark, sf_dir):
    out = audit.finalize(_findings(spark, sf_dir).withColumn("confidence", F.lit("HIGH")), "STALE")
    return out.groupBy("code", "severity", "confidence").agg(F.count("*").alias("n"))


def mismatch_severity(spark, sf_dir):
    """Every pair of states of a purchase, from the line numbers of order lines."""
    states = F.array(*map(F.lit, ("CARD_MATCHED", "CARD_GROUP_MATCHED", "CARD_MISSING", "CARD_REVIEW")))
    of = lambda c, n: F.get(states, ((F.col(c) / n).cast("long") % 4).cast("int"))
    rows = _table(spark, sf_dir, "lineitem").select(of("l_orderkey", 1).alias("pure"), of("l_partkey", 1).alias("now"), (F.col("l_suppkey") % 2 == 0).alias("open"))
    return rows.select("pure", "now", "open", audit.mismatch_severity(F.col("pure"), F.col("now"), F.col("open")).alias("severity")).distinct()


def card_mismatches(spark, sf_dir):
    """Purchases whose state with consumption differs from the one without."""
    pure = cut(_group_states(spark, sf_dir))
    now = pure.withColumn("status", F.when(F.col("purchase_id").endswith("1"), "CARD_MISSING").otherwise(F.col("status")))
    return audit.card_state_findings(pure, now, pure.select("purchase_id").filter("purchase_id like '%01'")).groupBy("code", "severity").agg(F.count("*").alias("n"))


def invoice_findings(spark, sf_dir):
    """Customers as invoices whose equation or subtotals are off by their key; orders as subtotals."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("statement"), F.floor(F.col("o_totalprice")).cast("long").alias("amount"))
    k = F.col("statement").cast("long")
    s = o.groupBy("statement").agg(F.sum("amount").alias("sum")).select("statement", F.when(k % 5 > 0, F.col("sum")).otherwise(F.col("sum") + 1).alias("total"), F.when(k % 7 == 0, 3).when(k % 7 == 1, None).otherwise(0).cast("long").alias("difference"))
    return audit.invoice_findings(s, o).select("code", "severity", "subject")


def diagnostic_confidence(spark, sf_dir):
    k = F.col("event_id")
    sure = audit.confidence(k % 2 == 0, F.when(k % 3 == 0, "PARTIAL").otherwise("COMPLETE"), F.when(k % 5 == 0, "INCOMPLETE").when(k % 5 == 1, "HEURISTIC").otherwise("CANONICAL"), (k % 7).cast("int"), k % 11 == 0, k % 13 == 0)
    return events(spark, sf_dir).select("event_id", sure.alias("confidence"))


def dashboard_metrics(spark, sf_dir):
    k = F.col("event_id")
    items = events(spark, sf_dir).select(F.when(k % 4 == 0, "MATCHED").when(k % 4 == 1, "REVIEW").when(k % 4 == 2, "MISSING").otherwise("OUT_OF_SCOPE").alias("status"), F.when(k % 5 == 0, "CARD_PAYMENT").otherwise("EXPENSE").alias("type"), k.alias("amount"), F.when(k % 3 == 0, "INVEST_FACIL_YIELD").alias("subtype"))
    return views.metrics(items)


def batch_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "REFUND").otherwise("PURCHASE").alias("type"), F.col("l_quantity").cast("long").alias("amount"))
    adjustments = _table(spark, sf_dir, "orders").select(F.floor("o_totalprice").cast("long").alias("amount"), F.when(F.col("o_orderkey") % 3 == 0, "CREDIT").otherwise("DEBIT").alias("direction"))
    return views.batch_totals(rows, adjustments)


def ledger_choices(spark, sf_dir):
    return views.choices(_table(spark, sf_dir, "customer").withColumn("category", F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))), "category")


def counter_divergence(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("bank_id"))
    return views.counter_divergence(rows.filter("bank_id % 2 = 0"), rows.filter("bank_id % 3 = 0"))


def inferred_payment(spark, sf_dir):
    k = F.col("event_id")
    said = F.element_at(F.array(*map(F.lit, ("PIX QR CODE DINÂMICO loja", "Compra Visa padaria", "Seguro cart deb", "Aplicação CDB 1", "Gastos cartão de crédito", "outra coisa"))), (k % 6 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", views.inferred_payment(said, F.when(k % 5 == 0, "STATEMENT").otherwise("BANK")).alias("payment"))


def appended_rows(spark, sf_dir):
    """Orders of two statuses as pending ledger rows against the finished ones of the same day, amount and clerk."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 5).alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, "Café Bar").otherwise("cafe bar").alias("description"), F.lit("Pix").alias("payment_method"), "o_orderstatus")
    out = views.to_append(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus = 'F'"))
    return out.select("date", "amount")


def writable_rows(spark, sf_dir):
    """Missing bank rows that may be written: no plausible ledger row but refused ones."""
    r = _reconciled(spark, sf_dir)
    return views.writable(r.settled.filter("status = 'MISSING'").select("bank_id"), r.answers)


def sheet_problems(spark, sf_dir):
    """Orders as lines of the ledger sheet with blanks and repeated ids by their keys."""
    k = F.col("o_orderkey")
    cell = lambda n, c: F.when(k % n == 0, " ").otherwise(F.col(c).cast("string"))
    rows = _table(spark, sf_dir, "orders").select(k.alias("line"), cell(5, "o_orderpriority").alias("description"), cell(7, "o_orderdate").alias("date"), cell(11, "o_totalprice").alias("amount"), F.lit("c").alias("category"), F.lit("p").alias("payment_method"), F.when(k % 13 == 0, F.lit("same")).otherwise(k.cast("string")).alias("id"))
    return views.matrix_problems(rows)


def decision_upsert(spark, sf_dir):
    """Customers' even orders as the stored decisions, odd ones as changes."""
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key"), (F.col("o_orderkey") % 2).alias("odd")).agg(F.max("o_orderkey").alias("k"))
    stamp = F.concat(F.lit("2026-01-01T00:00:0"), (F.col("k") % 10).cast("string"), F.lit("Z"))
    stored = o.filter("odd = 0").select("key", F.lit("ACTIVE").alias("state"), stamp.alias("updated_at"), F.when(F.col("k") % 3 == 0, "x").otherwise(stamp).alias("created_at"))
    changed = o.filter("odd = 1").select("key", F.when(F.col("k") % 5 == 0, "DELETED").otherwise("ACTIVE").alias("state"), F.lit("2026-02-02T00:00:00Z").alias("updated_at"))
    return decisions.upsert(stored, changed)


QUERIES = {
    f.__name__: f
    for f in (export_missing, export_out_of_scope, export_summary, export_lines, finding_roots, finding_groups, finding_final, mismatch_severity, card_mismatches, invoice_findings, diagnostic_confidence, dashboard_metrics, batch_totals, ledger_choices, counter_divergence, inferred_payment, appended_rows, writable_rows, sheet_problems, decision_upsert)
}

_SAID = "CASE said WHEN 'refund' THEN 'estorno pix' WHEN 'other' THEN 'lancamento diverso' WHEN 'investment' THEN 'aplicacao cdb' WHEN 'pix' THEN 'PIX ENVIADO' WHEN 'pix padaria' THEN 'Pix enviado Padaria Central' ELSE 'Compra Mercado Sul' END"
_MONEY = "'R$ ' || CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100) || ',' || lpad((abs({0}) % 100)::VARCHAR, 2, '0')"
_RICH = f"""{_FINDINGS}, e AS (
        SELECT *, CASE WHEN code LIKE 'DOUBLE%' THEN 'DECISION' WHEN code LIKE '%PAYMENT%' OR code LIKE '%REFUND%' THEN 'FINANCIAL' ELSE 'STATE' END AS category,
            CASE code WHEN 'DOUBLE_CLAIM' THEN 'INV-01' WHEN 'MATCHED_WITHOUT_LINK' THEN 'INV-08' WHEN 'CARD_PAYMENT_AS_EXPENSE_MISSING' THEN 'INV-05' WHEN 'REFUNDED_BUT_MISSING' THEN 'INV-06' ELSE 'INV-03' END AS invariant,
            CASE WHEN code LIKE 'EXPECTED%' THEN 'EXPECTED' WHEN code = 'ASSIGNMENT_CONFLICT' THEN 'RELATED' ELSE 'PRIMARY' END AS role,
            CASE WHEN code IN ('ASSIGNMENT_CONFLICT', 'MISSING_WITH_STRONG_CANDIDATE') THEN 'RECONCILIATION_ASSIGNMENT' WHEN code = 'DOUBLE_CLAIM' THEN 'OWNERSHIP' ELSE code END || ':' || subject AS cause FROM f)"""

ORACLE_SQL = {
    "export_missing": f"WITH RECURSIVE {_STATE} SELECT d AS day, {_SAID} AS text, {_MONEY.format('amount')} AS money, side, CASE pays WHEN 'debito' THEN 'Débito' ELSE 'Pix' END AS payment, 't' || b AS id FROM told JOIN bank ON bank_id = b WHERE status = 'MISSING'",
    "export_out_of_scope": f"""WITH RECURSIVE {_STATE} SELECT d AS day, {_SAID} AS text, CASE bank.side WHEN 'DEBIT' THEN 'Saída' ELSE 'Entrada' END AS side, bank.kind AS type, {_MONEY.format('amount')} AS money, '' AS sheet
        FROM items JOIN bank ON bank_id = b WHERE status = 'OUT_OF_SCOPE' AND NOT (bank.kind = 'INVESTMENT' AND sheet_id IS NOT NULL)""",
    "export_summary": f"""WITH RECURSIVE {_STATE}, c AS (SELECT count(*) FILTER (status = 'MATCHED') AS m, count(*) FILTER (status = 'REVIEW') AS r, count(*) FILTER (status = 'MISSING') AS x, count(*) FILTER (status = 'CARD_DIVERGENCE') AS v, count(*) FILTER (status = 'OUT_OF_SCOPE') AS o, count(*) FILTER (status = 'IGNORED') AS i FROM told),
        t AS (SELECT count(*) FILTER (kind = 'CARD_PAYMENT') AS cards, CAST(sum(amount) FILTER (side = 'DEBIT') AS BIGINT) AS debit, CAST(sum(amount) FILTER (side = 'CREDIT') AS BIGINT) AS credit FROM bank), l AS (SELECT CAST(sum(amount) AS BIGINT) AS total FROM ledger),
        g AS (SELECT count(*) AS n FROM (SELECT 1 FROM ledger a GROUP BY d, amount, CASE WHEN said LIKE 'mercado%' THEN 'mercado' ELSE said END HAVING count(*) > 1))
        SELECT 'Conciliadas' AS metric, m::VARCHAR AS value FROM c UNION ALL SELECT 'Para revisão', r::VARCHAR FROM c UNION ALL SELECT 'Possíveis ausências', x::VARCHAR FROM c UNION ALL SELECT 'Divergências de cartão', v::VARCHAR FROM c UNION ALL SELECT 'Fora do escopo', o::VARCHAR FROM c UNION ALL SELECT 'Ignoradas', i::VARCHAR FROM c
        UNION ALL SELECT 'Pagamentos de cartão', cards::VARCHAR FROM t UNION ALL SELECT 'Total de débitos', {_MONEY.format('debit')} FROM t UNION ALL SELECT 'Total de créditos', {_MONEY.format('credit')} FROM t UNION ALL SELECT 'Total planilha', {_MONEY.format('total')} FROM l
        UNION ALL SELECT 'Possíveis duplicidades', n::VARCHAR FROM g UNION ALL SELECT unnest(['Saldo inicial', 'Saldo final', 'Saldo calculado', 'Diferença de saldo']), ''""",
    "export_lines": f"""WITH c AS (SELECT c_custkey, c_name, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS a FROM customer) SELECT c_custkey, '"' || c_custkey || '";"a ""b"" ' || c_name || '";"";"' || {_MONEY.format('a')} || '"' AS line FROM c""",
    "finding_roots": f"WITH {_RICH} SELECT code, category, invariant, role, count(*) AS n, count(DISTINCT cause) AS causes FROM e GROUP BY ALL",
    "finding_groups": f"""WITH {_RICH}, p AS (SELECT cause, min(code) AS code FROM e WHERE role = 'PRIMARY' GROUP BY cause), r AS (SELECT cause, list_sort(list(DISTINCT code)) AS codes FROM e WHERE role = 'RELATED' GROUP BY cause),
        x AS (SELECT p.code, 'PRIMARY' AS role, coalesce(array_to_string(codes, ','), '') AS related FROM p LEFT JOIN r USING (cause) UNION ALL SELECT code, role, '' FROM e WHERE role = 'EXPECTED' OR role = 'RELATED' AND cause NOT IN (SELECT cause FROM p))
        SELECT code, role, related, count(*) AS n FROM x GROUP BY ALL""",
    "finding_final": f"""WITH {_FINDINGS} SELECT code, CASE WHEN code IN ('MISSING_WITH_STRONG_CANDIDATE', 'CARD_PAYMENT_AS_EXPENSE_MISSING', 'REVIEW_WITHOUT_CANDIDATES', 'ASSIGNMENT_CONFLICT') THEN 'REVIEW' ELSE severity END AS severity, 'LOW' AS confidence, count(*) AS n FROM f GROUP BY ALL
        UNION ALL SELECT 'AUDIT_INPUT_REVISION_MISMATCH', 'REVIEW', 'LOW', 1""",
    "mismatch_severity": """WITH s AS (SELECT ['CARD_MATCHED', 'CARD_GROUP_MATCHED', 'CARD_MISSING', 'CARD_REVIEW'] AS s), r AS (SELECT DISTINCT s[l_orderkey % 4 + 1] AS pure, s[l_partkey % 4 + 1] AS now, l_suppkey % 2 = 0 AS open FROM lineitem, s)
        SELECT *, CASE WHEN pure IN ('CARD_MATCHED', 'CARD_GROUP_MATCHED') AND now = 'CARD_MISSING' OR pure = 'CARD_MISSING' AND now IN ('CARD_MATCHED', 'CARD_GROUP_MATCHED') OR pure = 'CARD_REVIEW' AND now = 'CARD_MISSING' AND open THEN 'CRITICAL' WHEN pure = 'CARD_REVIEW' AND now = 'CARD_GROUP_MATCHED' THEN 'INFO' ELSE 'REVIEW' END AS severity FROM r""",
    "card_mismatches": f"WITH {_GROUPS} SELECT 'DERIVED_STATE_MISMATCH' AS code, CASE WHEN status = 'CARD_REVIEW' AND id NOT LIKE '%01' THEN 'REVIEW' ELSE 'CRITICAL' END AS severity, count(*) AS n FROM st WHERE id LIKE '%1' AND status <> 'CARD_MISSING' GROUP BY ALL",
    "invoice_findings": "SELECT 'INVOICE_TOTAL_MISMATCH' AS code, 'REVIEW' AS severity, CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey UNION ALL SELECT 'CARD_SUBTOTAL_MISMATCH', 'REVIEW', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey",
    "diagnostic_confidence": """SELECT event_id, CASE WHEN event_id % 2 = 1 OR event_id % 3 = 0 OR event_id % 5 = 0 THEN 'LOW' WHEN event_id % 5 > 1 AND event_id % 7 >= 2 AND (event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 7 >= 4) THEN 'HIGH' WHEN event_id % 7 > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM events""",
    "dashboard_metrics": """SELECT count(*) FILTER (event_id % 4 = 0 AND event_id % 5 <> 0) AS matched, count(*) FILTER (event_id % 4 = 1) AS review, count(*) FILTER (event_id % 4 = 2) AS missing, count(*) FILTER (event_id % 4 = 3) AS out_of_scope, CAST(coalesce(sum(event_id) FILTER (event_id % 4 = 3 AND event_id % 3 = 0), 0) AS BIGINT) AS yield_total FROM events""",
    "batch_totals": """SELECT count(*) FILTER (l_returnflag <> 'R') AS purchases, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R') AS BIGINT) AS purchased, count(*) FILTER (l_returnflag = 'R') AS refunds, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R') AS BIGINT) AS refunded,
        (SELECT count(*) FROM orders) AS adjustments, (SELECT CAST(sum(CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) FROM orders) AS adjusted FROM lineitem""",
    "ledger_choices": "SELECT DISTINCT trim(c_mktsegment) AS category FROM customer WHERE c_custkey % 9 <> 0",
    "counter_divergence": "SELECT CASE WHEN event_id % 2 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, event_id AS bank_id FROM events WHERE (event_id % 2 = 0) <> (event_id % 3 = 0)",
    "inferred_payment": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Crédito_Bradesco' ELSE ['Pix', 'Débito', 'Débito automático', 'Investimento', '', ''][event_id % 6 + 1] END AS payment FROM events",
    "appended_rows": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 5 AS amount, o_orderstatus AS s FROM orders) SELECT DISTINCT date, amount FROM o WHERE s <> 'F' AND (date, amount) NOT IN (SELECT (date, amount) FROM o WHERE s = 'F')",
    "writable_rows": f"WITH RECURSIVE {_STATE} SELECT bank_id FROM told WHERE status = 'MISSING'",
    "sheet_problems": """SELECT o_orderkey AS line, 'MISSING_DESCRIPTION' AS problem FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'MISSING_DATE' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'MISSING_AMOUNT' FROM orders WHERE o_orderkey % 11 = 0
        UNION ALL SELECT o_orderkey, 'DUPLICATE_ID' FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY CASE WHEN o_orderkey % 13 = 0 THEN 'same' ELSE o_orderkey::VARCHAR END) AS n FROM orders) WHERE n > 1""",
    "decision_upsert": """WITH o AS (SELECT o_custkey::VARCHAR AS key, o_orderkey % 2 AS odd, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), s AS (SELECT *, '2026-01-01T00:00:0' || (k % 10) || 'Z' AS stamp FROM o WHERE odd = 0), c AS (SELECT * FROM o WHERE odd = 1)
        SELECT coalesce(s.key, c.key) AS key, CASE WHEN c.k % 5 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS state, CASE WHEN c.k IS NULL THEN stamp ELSE '2026-02-02T00:00:00Z' END AS updated_at, CASE WHEN s.k % 3 <> 0 THEN stamp WHEN c.k IS NOT NULL THEN '2026-02-02T00:00:00Z' ELSE 'x' END AS created_at,
            CASE WHEN c.k IS NULL THEN 0 WHEN c.k % 5 = 0 THEN 1 ELSE 2 END AS place FROM s FULL JOIN c ON s.key = c.key""",
}
