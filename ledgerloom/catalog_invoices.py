"""Queries of invoices made from orders: parsing of both layouts, groups, consumption, settlement, balances and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import cards, records
from .plans.demo import events
from .plans.shared import cut
from .sources import invoices

MONTHS = [m.upper() for m in invoices.MONTHS]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column):
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


def _money(cents):
    return F.translate(F.format_number(cents / 100, 2), ",.", ".,")


def invoice_pages(spark, sf_dir) -> DataFrame:
    """(file, pages): a customer's orders as an invoice, due ten days after the last one. Odd customers have the Internet Banking layout, in which every third order has a full date, every third a day above and a month
    below it and an instalment, and every third no date of its own; even ones have the mobile layout. Orders with a number divisible by seven are credits."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), _cents("o_totalprice").alias("a"))
    credit = F.col("k") % 7 == 0
    shown = F.concat(_money(F.col("a")), F.when(credit, "-").otherwise(""))
    buys = F.concat(F.lit("COMPRA "), F.col("k").cast("string"))
    plain = F.concat_ws(" | ", buys, shown)
    dated = F.concat_ws(" | ", F.date_format("d", "dd/MM/yyyy"), buys, shown)
    split = F.array(F.dayofmonth("d").cast("string"), F.concat_ws(" | ", F.concat(buys, F.lit(" 2/10")), shown), F.element_at(F.array(*map(F.lit, MONTHS)), F.month("d")))
    banking = F.when(F.col("k") % 3 == 0, F.array(dated)).when(F.col("k") % 3 == 1, split).otherwise(F.array(plain))
    mobile = F.array(F.concat_ws(" | ", F.date_format("d", "dd/MM"), F.concat(F.lit("LOJA "), F.col("k").cast("string"), F.lit(" (3/12)")), F.lit("RECIFE"), shown))
    lines = F.when(F.col("file") % 2 == 1, banking).otherwise(mobile)
    c = o.withColumn("lines", lines).groupBy("file").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("d", "k", "lines"))), lambda r: r["lines"])).alias("rows"), F.date_add(F.max("d"), 10).alias("due"),
        F.sum(F.when(credit, F.col("a")).otherwise(0)).alias("credits"), F.sum(F.when(credit, 0).otherwise(F.col("a"))).alias("debits"),
    )
    due, total = F.date_format("due", "dd/MM/yyyy"), _money(F.abs(F.col("debits") - F.col("credits")))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    first = F.array(
        F.lit("Fatura | Data 07/10/2026 - 00:00:00"), F.lit("Cartao selecionado"), said("Data de vencimento: | ", due), said("Total da fatura: | R$ ", total),
        said("Gastos referentes ao cartão: Final 1111 | TITULAR | Valor da fatura: | R$ ", total),
    )
    end = F.array(F.lit("Resumo das Despesas | Real"), F.lit("Saldo anterior | 0,00"), said("(-)Pagamentos/Créditos: | ", _money(F.col("credits"))), said("(+)Despesas locais: | ", _money(F.col("debits"))))
    front = F.array(F.lit("Total da fatura Vencimento"), said("R$ ", total, " ", due), F.lit("Saldo anterior 0,00"), said("Créditos/Pagamentos ", _money(F.col("credits"))), said("Compras/Débitos ", _money(F.col("debits"))))
    back = F.concat(F.array(F.lit("Lançamentos"), F.lit("Numero do Cartao 1234 XXXX XXXX 5678"), F.lit("Data | Histórico de Lançamentos | Cidade | R$")), F.col("rows"), F.array(F.lit("Total para FULANO"), total, said("Total da fatura em real ", total), F.lit("Limites"), F.lit("01/01 | FORA | X | 1,00")))
    return c.select("file", F.when(F.col("file") % 2 == 1, F.array(F.concat(first, F.col("rows"), end))).otherwise(F.array(front, back)).alias("pages"))


def invoice_rows(spark, sf_dir):
    return invoices.parse(invoice_pages(spark, sf_dir)).rows.select("file", "card", "date", "description", "amount", "direction", "type", "number", "total", "city")


def invoice_statements(spark, sf_dir):
    out = invoices.parse(invoice_pages(spark, sf_dir)).statements
    return out.select("file", "layout", "due_date", "total", "previous_balance", "credits", "debits", "difference", F.array_join("errors", ",").alias("errors"))


def invoice_subtotals(spark, sf_dir):
    return invoices.parse(invoice_pages(spark, sf_dir)).subtotals


def invoice_layouts(spark, sf_dir):
    """The layouts of whole invoices, of their first pages and of mere documents."""
    pages = invoice_pages(spark, sf_dir)
    texts = pages.select(F.array_join(F.flatten("pages"), "\n").alias("text")).unionByName(_table(spark, sf_dir, "documents").select("text"))
    return texts.groupBy(invoices.layout(F.col("text")).alias("layout")).agg(F.count("*").alias("n"))


def _lines(spark, sf_dir):
    """Line items, one for each order and number, dealt out by order."""
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))


def _group_purchases(spark, sf_dir, *more):
    """Line items as purchases: the order is the invoice, the quantity the amount in tens; every fifth supplier sells under another name. last: the last purchase of the order. more: columns of the line besides."""
    none = F.lit(None).cast("int")
    day = F.to_date(F.lit("2026-03-10"))
    name = F.concat_ws("-", "l_orderkey", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return _lines(spark, sf_dir).select(
        name.alias("id"), F.max(name).over(Window.partitionBy("l_orderkey")).alias("last"), F.col("l_orderkey").cast("string").alias("statement"), F.lit("1").alias("card"), F.lit("2026-03-01").cast("date").alias("date"), day.alias("due_date"),
        F.when(F.col("l_suppkey") % 5 == 0, "farmacia popular").otherwise("loja central").alias("description"), (F.col("l_orderkey") * 100 + F.ceil(F.col("l_quantity") / 10)).cast("long").alias("amount"), F.lit("PURCHASE").alias("type"), F.lit("DEBIT").alias("direction"),
        none.alias("number"), none.alias("total"), *more,
    )


def _group_costs(spark, sf_dir, bought=None):
    """A ledger row on the due date for every line item but the last of each order. bought: _group_purchases(), where they are kept."""
    bought = bought if bought is not None else _group_purchases(spark, sf_dir)
    kept = bought.filter("id <> last or substring(id, -1) in ('2', '4')")
    return kept.select(F.concat(F.lit("s"), "id").alias("id"), F.col("due_date").alias("date"), F.lit("compra").alias("description"), "amount", "direction", F.lit("EXPENSE").alias("type"), F.lit("Crédito_Bradesco").alias("payment_method"), "number", "total")


def _group_states(spark, sf_dir):
    bought = cut(_group_purchases(spark, sf_dir))
    return cards.purchase_states(bought, _group_costs(spark, sf_dir, bought))


def card_group_states(spark, sf_dir):
    out = _group_states(spark, sf_dir)
    return out.select("purchase_id", "status", "sheet_id", F.size(F.coalesce("sheet_ids", F.array().cast("array<string>"))).alias("rows"), "candidates")


def card_counts(spark, sf_dir):
    return cards.purchase_counts(_group_states(spark, sf_dir))


def card_issues(spark, sf_dir):
    return cards.only_issues(_group_states(spark, sf_dir))


def card_consumption(spark, sf_dir):
    """Line items as matches of their order with the part as ledger row; orders take rows in the order of their dates; odd customers' missing purchases are ignored."""
    line = cut(_lines(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("purchase_id"), F.col("l_orderkey").cast("string").alias("statement"), F.col("l_partkey").cast("string").alias("part"), "l_linenumber"))
    missing = F.col("l_linenumber") == 7
    states = line.select("purchase_id", "statement", F.when(missing, "CARD_MISSING").otherwise("CARD_MATCHED").alias("status"), F.when(~missing, F.col("part")).alias("sheet_id"), F.lit(None).cast("array<string>").alias("sheet_ids"), F.lit(1).cast("long").alias("candidates"))
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("statement"), F.to_date("o_orderdate").alias("due_date"), "o_custkey")
    ignored = line.join(o.filter("o_custkey % 2 = 1"), "statement").select("purchase_id")
    return cards.consume(states, o, ignored).select("purchase_id", "status", "sheet_id")


def invoice_settlement(spark, sf_dir):
    """Even orders as invoices, odd ones as payments, in hundreds."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("amount"))
    owed = rows.filter("k % 2 = 0").select(F.col("k").alias("statement"), F.col("day").alias("due_date"), F.col("amount").alias("total"))
    paid = rows.filter("k % 2 = 1").select(F.col("k").alias("id"), F.col("day").alias("date"), "amount", F.lit("CARD_PAYMENT").alias("type"))
    return cards.settled(owed, paid)


def balance_summary(spark, sf_dir):
    """Running balances of users, reported by every second event only; signups are left-out rows that report a balance."""
    c = _cents("value")
    credit = F.when(F.col("event_type") == "error", c).otherwise(0)
    rows = events(spark, sf_dir).select(F.col("user_id").alias("statement"), F.col("event_id").alias("source_row"), F.to_date("ts").alias("date"), credit.alias("credit"), (c - credit).alias("debit"), "event_type")
    running = F.sum(F.col("credit") - F.col("debit")).over(Window.partitionBy("statement").orderBy("date", "source_row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("balance_after", F.when(F.col("source_row") % 2 == 0, running + F.when(F.col("source_row") % 50 == 0, 1).otherwise(0)))
    return records.balance_summary(rows.filter("event_type <> 'signup'"), rows.filter("event_type = 'signup'"))


def missing_summary(spark, sf_dir):
    k = F.col("event_id")
    items = events(spark, sf_dir).select(F.when(k % 3 == 0, "MISSING").otherwise("MATCHED").alias("status"), F.when(k % 4 == 0, "CREDIT").otherwise("DEBIT").alias("direction"), F.when(k % 5 == 0, "OTHER").otherwise("EXPENSE").alias("type"), _cents("value").alias("amount"))
    return records.missing_summary(items)


QUERIES = {f.__name__: f for f in (invoice_rows, invoice_statements, invoice_subtotals, invoice_layouts, card_group_states, card_counts, card_issues, card_consumption, invoice_settlement, balance_summary, missing_summary)}

_INVOICES = """
    o AS (SELECT o_custkey AS file, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS a, o_orderkey % 7 = 0 AS credit FROM orders),
    f AS (SELECT file, max(d) + 10 AS due, sum(CASE WHEN credit THEN a ELSE 0 END)::BIGINT AS credits, sum(CASE WHEN credit THEN 0 ELSE a END)::BIGINT AS debits FROM o GROUP BY file),
    own AS (
        SELECT o.*, due, CASE WHEN file % 2 = 1 AND k % 3 = 0 THEN d WHEN file % 2 = 1 AND k % 3 = 2 THEN NULL
            ELSE TRY_CAST((year(due) - CASE WHEN month(d) > month(due) THEN 1 ELSE 0 END) || '-' || month(d) || '-' || day(d) AS DATE) END AS own FROM o JOIN f USING (file)
    ), dated AS (SELECT *, CASE WHEN file % 2 = 1 AND k % 3 = 2 THEN last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY d, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE own END AS date FROM own),
    r AS (
        SELECT file, CASE WHEN file % 2 = 1 THEN 'XXXX XXXX XXXX 1111' ELSE '1234 XXXX XXXX 5678' END AS card, date, CASE WHEN file % 2 = 1 THEN 'COMPRA ' ELSE 'LOJA ' END || k AS description, a AS amount, CASE WHEN credit THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
            CASE WHEN credit THEN 'REFUND' ELSE 'PURCHASE' END AS type, CASE WHEN file % 2 = 0 THEN 3 WHEN k % 3 = 1 THEN 2 END AS number, CASE WHEN file % 2 = 0 THEN 12 WHEN k % 3 = 1 THEN 10 END AS total, CASE WHEN file % 2 = 0 THEN 'RECIFE' ELSE '' END AS city
        FROM dated WHERE date IS NOT NULL
    )"""
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)"
_GROUPS = f"""{_LINES},
    p AS (SELECT l_orderkey AS o, l_orderkey || '-' || lpad(l_linenumber::VARCHAR, 2, '0') AS id, l_orderkey * 100 + ceil(l_quantity / 10) AS amount, CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS text FROM lines),
    s AS (SELECT 's' || id AS sheet, amount FROM (SELECT *, max(id) OVER (PARTITION BY o) AS last FROM p) WHERE id <> last OR id[-1] IN ('2', '4')),
    c AS (SELECT amount, count(*) AS rows, min(sheet) AS sheet FROM s GROUP BY amount), b AS (SELECT amount, count(*) AS buyers, min(text) = max(text) AS alike FROM p GROUP BY amount),
    st AS (
        SELECT id, o, CASE WHEN rows IS NULL THEN 'CARD_MISSING' WHEN rows = 1 AND buyers = 1 THEN 'CARD_MATCHED' WHEN rows > 1 AND rows = buyers AND alike THEN 'CARD_GROUP_MATCHED' ELSE 'CARD_REVIEW' END AS status, sheet, coalesce(rows, 0) AS rows
        FROM p JOIN b USING (amount) LEFT JOIN c USING (amount)
    )"""
ORACLE_SQL = {
    "invoice_rows": f"WITH {_INVOICES} SELECT * FROM r",
    "invoice_statements": f"""WITH {_INVOICES}, t AS (SELECT file, coalesce(sum(CASE WHEN direction = 'DEBIT' THEN amount END), 0) AS bought, coalesce(sum(CASE WHEN direction = 'CREDIT' THEN amount END), 0) AS back FROM r GROUP BY file),
        z AS (SELECT f.*, abs(debits - credits) AS total, coalesce(bought, 0) AS bought, coalesce(back, 0) AS back, file % 2 = 1 AS banking FROM f LEFT JOIN t USING (file))
        SELECT file, CASE WHEN banking THEN 'INTERNET_BANKING' ELSE 'MOBILE_APP' END AS layout, due AS due_date, total, CAST(0 AS BIGINT) AS previous_balance, credits, debits, debits - credits - total AS difference,
            concat_ws(',', CASE WHEN banking AND bought = 0 AND back = 0 THEN 'LINES' END, CASE WHEN bought - back <> total THEN 'CARD_SUBTOTAL' END, CASE WHEN bought <> debits THEN 'DEBITS' END, CASE WHEN banking AND back <> credits THEN 'CREDITS' END,
                CASE WHEN debits - credits <> total THEN 'EQUATION' END, CASE WHEN NOT banking AND bought = 0 THEN 'PURCHASES' END) AS errors FROM z""",
    "invoice_subtotals": f"WITH {_INVOICES} SELECT file, CASE WHEN file % 2 = 1 THEN 'XXXX XXXX XXXX 1111' ELSE '1234 XXXX XXXX 5678' END AS card, abs(debits - credits) AS amount FROM f",
    "invoice_layouts": "SELECT 'UNKNOWN' AS layout, count(*) AS n FROM documents UNION ALL SELECT CASE WHEN c % 2 = 1 THEN 'INTERNET_BANKING' ELSE 'MOBILE_APP' END, count(*) FROM (SELECT DISTINCT o_custkey AS c FROM orders) GROUP BY 1",
    "card_group_states": f"WITH {_GROUPS} SELECT id AS purchase_id, status, CASE WHEN status = 'CARD_MATCHED' THEN sheet END AS sheet_id, CAST(CASE WHEN status = 'CARD_GROUP_MATCHED' THEN rows ELSE 0 END AS INTEGER) AS rows, rows AS candidates FROM st",
    "card_counts": f"WITH {_GROUPS} SELECT count(*) AS eligible, count(*) FILTER (status IN ('CARD_MATCHED', 'CARD_GROUP_MATCHED')) AS matched, count(*) FILTER (status = 'CARD_REVIEW') AS review, count(*) FILTER (status = 'CARD_MISSING') AS missing, 0::BIGINT AS refunded, 0::BIGINT AS ignored FROM st",
    "card_issues": f"WITH {_GROUPS} SELECT DISTINCT o::VARCHAR AS statement FROM st WHERE status IN ('CARD_REVIEW', 'CARD_MISSING')",
    "card_consumption": f"""WITH {_LINES}, x AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey::VARCHAR AS part, l_linenumber = 7 AS missing, o_custkey % 2 = 1 AS odd, (CAST(o_orderdate AS DATE)::VARCHAR, l_orderkey::VARCHAR) AS place FROM lines JOIN orders ON o_orderkey = l_orderkey),
        m AS (SELECT part, min(place) AS first FROM x WHERE NOT missing GROUP BY part)
        SELECT id AS purchase_id, CASE WHEN missing AND odd THEN 'CARD_IGNORED' WHEN missing THEN 'CARD_MISSING' WHEN place = first THEN 'CARD_MATCHED' ELSE 'CARD_REVIEW' END AS status, CASE WHEN NOT missing AND place = first THEN part END AS sheet_id FROM x LEFT JOIN m USING (part)""",
    "invoice_settlement": """WITH RECURSIVE r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 100) AS BIGINT) AS a FROM orders),
        c AS (SELECT i.k AS s, b.k AS p, i.d AS due, abs(b.d - i.d) AS days, abs(b.a - i.a) AS cents, b.d AS paid FROM r i JOIN r b ON i.k % 2 = 0 AND b.k % 2 = 1 AND abs(i.a - b.a) <= 1 AND abs(i.d - b.d) <= 7),
        q AS (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM c), o AS (SELECT s, row_number() OVER (ORDER BY n, due, s::VARCHAR) AS i FROM (SELECT DISTINCT s, n, due FROM q)), l AS (SELECT s, list(p ORDER BY days, cents, paid, p) AS ps FROM q GROUP BY s),
        walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS s, NULL::BIGINT AS p
            UNION ALL SELECT o.i, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, o.s, x FROM (SELECT o.i, o.s, walk.used, list_filter(l.ps, lambda y: NOT list_contains(walk.used, y))[1] AS x FROM walk JOIN o ON o.i = walk.i + 1 JOIN l ON l.s = o.s) o)
        SELECT s AS statement, p AS bank_id FROM walk WHERE p IS NOT NULL""",
    "balance_summary": """WITH e AS (SELECT user_id AS u, event_id AS k, CAST(ts AS DATE) AS d, event_type <> 'signup' AS inc, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c, event_type = 'error' AS cr FROM events),
        b AS (SELECT *, CASE WHEN cr THEN c ELSE -c END AS m, CASE WHEN k % 2 = 0 THEN CAST(sum(CASE WHEN cr THEN c ELSE -c END) OVER (PARTITION BY u ORDER BY d, k ROWS UNBOUNDED PRECEDING) AS BIGINT) + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END END AS bal FROM e),
        g AS (SELECT u, arg_min(bal - CASE WHEN inc THEN m ELSE 0 END, (d, k)) FILTER (bal IS NOT NULL) AS initial, arg_max(bal, (d, k)) FILTER (bal IS NOT NULL AND inc) AS reported, CAST(coalesce(sum(c) FILTER (inc AND cr), 0) AS BIGINT) AS credits,
            CAST(coalesce(sum(c) FILTER (inc AND NOT cr), 0) AS BIGINT) AS debits, count(*) FILTER (inc) AS movements FROM b GROUP BY u)
        SELECT u AS statement, initial, reported, credits, debits, movements, initial + credits - debits AS calculated, reported - (initial + credits - debits) AS difference, reported = initial + credits - debits AS balanced FROM g""",
    "missing_summary": "SELECT count(*) AS n, CAST(coalesce(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)), 0) AS BIGINT) AS total FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0",
}
