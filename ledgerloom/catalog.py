"""Registered queries over the driver's tables and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog_invoices, catalog_matching, catalog_records, catalog_rules, catalog_sources, catalog_state, catalog_views
from .functions import text
from .operators import groups, matching, records
from .plans.demo import bank_rows, events


#: "Sao Jose" with combining accents, letters with carons and rings, an approval phrase.
_SUFFIX = " Sa\u0303o Jose\u0301 Dvo\u0159\u00e1k \u016b\u1ea1 Compra Aprovada Cart\u00e3o final 12"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalize_text(spark, sf_dir):
    """Texts with an ending that holds combining accents, precomposed letters and phrases that go."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_description(F.concat("text", F.lit(_SUFFIX)))).alias("digest"))


def parse_amount(spark, sf_dir):
    shown = F.concat(F.lit("R$ "), F.translate(F.format_number("value", 2), ",.", ".,"))
    return events(spark, sf_dir).select("event_id", text.normalize_amount(shown).alias("cents"))


def parse_date(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", text.normalize_date(F.date_format("ts", "dd/MM/yy")).alias("day"))


#: Texts that reach every rule of the classifier, with what the rules say.
SAID = {
    "Gastos Cartão de Crédito": ("CARD_PAYMENT", None), "GASTO C CREDITO": ("CARD_PAYMENT", None), "Devolução Pix": ("REFUND", None), "Estorno compra": ("REFUND", None), "Rentab Invest Facilcred": ("INVESTMENT_INCOME", None), "Resgate CDB": ("INVESTMENT", "RESCUE"),
    "Vencimento CDB": ("INVESTMENT", "RESCUE"), "Aplicação CDB": ("INVESTMENT", "APPLICATION"), "TED recebida": ("TRANSFER", None), "limited offer": ("TRANSFER", None), "Transf entre contas": ("TRANSFER", None), "DOC 12": ("TRANSFER", None), "doca": ("OTHER", None),
    "Pix enviado para minha conta": ("TRANSFER", None), "Pix recebido Ana": ("INCOME", None), "Crédito Pix": ("INCOME", None), "PIX QR CODE DINÂMICO": ("EXPENSE", None), "Pix enviado": ("EXPENSE", None), "Conta de telefone": ("EXPENSE", None), "Farmácia": ("EXPENSE", None), "Saldo": ("OTHER", None),
}


def classify_type(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("event_id") % len(SAID) + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", text.transaction_type(said).alias("type"), text.investment_action(said).alias("action"))


def token_similarity(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    pairs = parts.select("p_partkey", "p_name", (F.col("p_partkey") + 1).alias("other")).join(parts.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("other_name")), "other")
    return pairs.select("p_partkey", F.round(text.description_similarity(F.col("p_name"), F.col("other_name")), 6).alias("similarity"))


def refund_groups(spark, sf_dir):
    return matching.refund_groups(bank_rows(spark, sf_dir)).select("refund_id", "status", F.array_join("original_ids", ",").alias("originals"), "gross", "refunded", "net")


def bank_totals(spark, sf_dir):
    return records.totals(bank_rows(spark, sf_dir))


def balance_audit(spark, sf_dir):
    """A running balance per user in which every row with an id divisible by 97 is off by one cent."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    credit = F.when(F.col("event_type") == "error", cents).otherwise(0)
    rows = events(spark, sf_dir).select(F.col("user_id").alias("statement"), F.col("event_id").alias("source_row"), F.to_date("ts").alias("date"), credit.alias("credit"), (cents - credit).alias("debit"))
    running = F.sum(F.col("credit") - F.col("debit")).over(Window.partitionBy("statement").orderBy("date", "source_row").rowsBetween(Window.unboundedPreceding, 0))
    return records.balance_audit(rows.withColumn("balance_after", running + F.when(F.col("source_row") % 97 == 0, 1).otherwise(0)))


def _versions(spark, sf_dir, first: int):
    state = F.when(F.col("event_id") % 5 == 0, "DELETED").otherwise("ACTIVE")
    rows = events(spark, sf_dir).filter(F.col("event_id") % 2 == first)
    return rows.groupBy(F.col("user_id").alias("key")).agg(F.max(F.to_date("ts")).alias("updated_ts"), F.max_by(state, F.struct("ts", "event_id")).alias("state"))


def lww_merge(spark, sf_dir):
    return records.sync_merge(_versions(spark, sf_dir, 0), _versions(spark, sf_dir, 1))


def audit_merge(spark, sf_dir):
    return records.audit_merge(_versions(spark, sf_dir, 0), _versions(spark, sf_dir, 1))


def period_filter(spark, sf_dir):
    rows = records.period_filter(_table(spark, sf_dir, "orders"), "o_orderdate", "1995-01-01", "1996-06-30")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def missing_diff(spark, sf_dir):
    """Customers as the files listed before, those of every fortieth order as the files listed now."""
    late = _table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 40 == 0)
    return records.missing_sources(_table(spark, sf_dir, "customer").select("c_custkey"), late.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def eligibility(spark, sf_dir):
    k = F.col("event_id")
    item = {
        "source": F.when(k % 2 == 0, "STATEMENT").otherwise("BANK"), "status": F.when(k % 3 == 0, "MISSING").when(k % 3 == 1, "CARD_MISSING").otherwise("MATCHED"), "direction": F.when(k % 7 == 0, "CREDIT").otherwise("DEBIT"),
        "type": F.when(F.col("event_type") == "error", "REFUND").when(F.col("event_type") == "click", "TRANSFER").otherwise("EXPENSE"), "in_sheet": k % 11 == 0, "added": k % 13 == 0, "complete": k % 5 != 0,
    }
    return events(spark, sf_dir).select("event_id", records.eligibility(item).alias("reason"))


def duplicate_groups(spark, sf_dir):
    """Groups of equal line items as the ledger's duplicates: their day, quantity and size."""
    line = _table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = line.select(key.alias("id"), F.col("l_orderkey").alias("row_idx"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("amount"), F.md5((F.col("l_partkey") % 50).cast("string")).alias("description"))
    return groups.duplicate_members(rows).groupBy("date", "amount", "anchor_id").agg(F.count("*").alias("n")).groupBy("date", "amount", "n").agg(F.count("*").alias("groups"))


def card_compositions(spark, sf_dir):
    """Orders as card costs; each customer's bill is the sum of the even-numbered orders of the year before the last order."""
    cost = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("date"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("amount"))
    last = cost.groupBy("account").agg(F.max("date").alias("last"))
    recent = cost.join(last, "account").filter(F.datediff("last", "date") <= groups.HORIZON)
    bills = recent.groupBy("account", "last").agg(F.sum(F.when(F.col("id").cast("long") % 2 == 0, F.col("amount")).otherwise(0)).alias("amount"))
    bills = bills.select(F.col("account").cast("string").alias("bill_id"), "account", F.col("last").alias("date"), "amount")
    out = groups.card_compositions(bills, cost)
    return out.select("bill_id", "status", "candidates", "rank", "score", F.array_join("ids", ",").alias("ids"))


QUERIES = {
    f.__name__: f
    for f in (normalize_text, parse_amount, parse_date, classify_type, token_similarity, refund_groups, bank_totals, balance_audit, lww_merge, audit_merge, period_filter, missing_diff, eligibility, duplicate_groups, card_compositions)
}

_BANK = "SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS d, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount, event_type FROM events"
_VERSIONS = """
    r AS (SELECT user_id AS key, max(CAST(ts AS DATE)) AS ts, arg_max(CASE WHEN event_id % 5 = 0 THEN 'DELETED' ELSE 'ACTIVE' END, (ts, event_id)) AS state FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    l AS (SELECT user_id AS key, max(CAST(ts AS DATE)) AS ts, arg_max(CASE WHEN event_id % 5 = 0 THEN 'DELETED' ELSE 'ACTIVE' END, (ts, event_id)) AS state FROM events WHERE event_id % 2 = 1 GROUP BY 1)"""

ORACLE_SQL = {
    "normalize_text": rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text || '{_SUFFIX}')), '\b(?:compra aprovada|pagamento aprovado|cartao final \d+)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents""",
    "parse_amount": "SELECT event_id, CAST(floor(round(value, 2) * 100 + 0.5) AS BIGINT) AS cents FROM events",
    "parse_date": "SELECT event_id, CAST(ts AS DATE) AS day FROM events",
    "classify_type": "WITH s AS (SELECT [{}] AS kinds, [{}] AS actions) SELECT event_id, kinds[event_id % {n} + 1] AS type, nullif(actions[event_id % {n} + 1], '') AS action FROM events, s".format(
        *(", ".join(f"'{v[i] or ''}'" for v in SAID.values()) for i in (0, 1)), n=len(SAID)
    ),
    "refund_groups": f"""WITH e AS ({_BANK}), p AS (SELECT r.id AS rid, r.amount AS ra, o.id AS oid, o.amount AS oa FROM e r JOIN e o ON r.event_type = 'error' AND o.event_type = 'purchase' AND r.d - o.d BETWEEN 1 AND 60 AND o.amount >= r.amount),
        x AS (SELECT * FROM p WHERE ra = oa), q AS (SELECT * FROM p WHERE rid NOT IN (SELECT rid FROM x) AND oid NOT IN (SELECT oid FROM x)),
        c AS (SELECT * FROM x UNION ALL SELECT q.* FROM q WHERE rid IN (SELECT rid FROM q GROUP BY rid HAVING count(*) = 1)),
        k AS (SELECT *, count(*) OVER (PARTITION BY oid) AS claims FROM c),
        g AS (SELECT rid, ra, string_agg(oid, ',' ORDER BY oid) AS originals, count(*) AS n, max(claims) AS claims, max(oa) AS oa FROM k GROUP BY rid, ra)
        SELECT rid AS refund_id, CASE WHEN n > 1 OR claims > 1 THEN 'REVIEW' WHEN ra = oa THEN 'REFUNDED' ELSE 'PARTIAL' END AS status, originals, CASE WHEN n = 1 AND claims = 1 THEN oa END AS gross, ra AS refunded, CASE WHEN n = 1 AND claims = 1 THEN oa - ra END AS net FROM g""",
    "bank_totals": f"""WITH e AS ({_BANK}) SELECT CAST(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE 0 END) AS BIGINT) AS debit_total, CAST(sum(CASE WHEN event_type = 'error' THEN amount ELSE 0 END) AS BIGINT) AS credit_total,
        count(*) FILTER (event_type = 'purchase') AS debits, count(*) AS transactions FROM e WHERE event_type IN ('purchase', 'error')""",
    "balance_audit": """WITH e AS (SELECT user_id AS statement, event_id AS source_row, CAST(ts AS DATE) AS date, CAST(floor(value * 100 + 0.5) AS BIGINT) * CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS move FROM events),
        b AS (SELECT *, CAST(sum(move) OVER (PARTITION BY statement ORDER BY date, source_row ROWS UNBOUNDED PRECEDING) AS BIGINT) + CASE WHEN source_row % 97 = 0 THEN 1 ELSE 0 END AS bal FROM e),
        w AS (SELECT *, lag(bal) OVER o AS before, lag(date) OVER o AS day_before, lead(bal) OVER o AS after, lead(move) OVER o AS next_move FROM b WINDOW o AS (PARTITION BY statement ORDER BY date, source_row))
        SELECT statement, source_row, date, before + move AS expected, bal AS reported, bal - before - move AS difference, CAST(date - day_before AS INTEGER) AS gap_days, coalesce(bal + next_move = after AND after = before, false) AS compensated FROM w WHERE bal <> before + move""",
    "lww_merge": f"""WITH {_VERSIONS}, u AS (SELECT key, ts, state, 'remote' AS side, 1 AS rank FROM r UNION ALL SELECT key, ts, state, 'local', CASE WHEN state = 'DELETED' THEN 2 ELSE 0 END FROM l)
        SELECT key, ts AS updated_ts, state, side FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, rank DESC) = 1""",
    "audit_merge": f"""WITH {_VERSIONS}, j AS (SELECT coalesce(r.key, l.key) AS key, r.ts AS rt, r.state AS rs, l.ts AS lt, l.state AS ls, r.ts IS NULL OR coalesce(l.state = 'DELETED', false) OR coalesce(l.ts > r.ts, false) AS w FROM r FULL JOIN l ON r.key = l.key)
        SELECT key, CASE WHEN w THEN lt ELSE rt END AS updated_ts, CASE WHEN w THEN ls ELSE rs END AS state, CASE WHEN w THEN 'local' ELSE 'remote' END AS side FROM j""",
    "period_filter": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'",
    "missing_diff": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)",
    "eligibility": """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'ALREADY_ADDED' WHEN event_id % 11 = 0 THEN 'ALREADY_IN_SHEET' WHEN event_type = 'error' THEN 'REFUND' WHEN event_id % 7 = 0 THEN 'NOT_DEBIT' WHEN event_type = 'click' THEN 'OUT_OF_SCOPE_TRANSFER'
        WHEN event_id % 3 <> CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END THEN 'NOT_MISSING' WHEN event_id % 5 = 0 THEN 'UNSUPPORTED_WRITE' ELSE 'ELIGIBLE' END AS reason FROM events""",
    "duplicate_groups": """WITH g AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS amount, l_partkey % 50 AS p, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT date, amount, n, count(*) AS "groups" FROM g GROUP BY ALL""",
}

for _part in (catalog_matching, catalog_records, catalog_invoices, catalog_sources, catalog_views, catalog_state, catalog_rules):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
