"""Queries of kept state and its explanation: refreshed assignments, appends, decision streams, folded sources, expected states, claims, records across lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog_invoices import _GROUPS, _group_costs, _group_purchases
from .catalog_matching import _ROWS, _solved
from .operators import audit, claims, expected, guard, overlap, refresh, views
from .operators.matching import candidate_edges
from .plans.demo import events, mixed_bank, mixed_ledger
from .plans.shared import cut, shared_folder
from .sources import records
from .sources.versions import VersionedTable
from .streaming import decisions


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


def refreshed_assignment(spark, sf_dir) -> DataFrame:
    """Yesterday every 50th event was missing and every 49th had another amount; the kept assignment of yesterday is refreshed to today's rows. Every component with the sum of its best assignment, and the pairs that
    all its best assignments share, with their margin."""
    bank, ledger = mixed_bank(spark, sf_dir), mixed_ledger(spark, sf_dir)
    k = F.col("id").cast("long")
    yesterday = lambda rows: rows.filter(k % 50 != 0).withColumn("amount", F.when(k % 49 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    folder = _folder(spark)
    kept = refresh.Kept.at(spark, f"{folder}/kept")
    refresh.build(kept, yesterday(bank), yesterday(ledger))
    for name, rows in (("bank", bank), ("ledger", ledger)):
        refresh.by_amount(rows, f"{folder}/{name}")
    named = lambda rows, side: rows.filter((k % 50 == 0) | (k % 49 == 0)).select(F.lit(side).alias("side"), "id", F.explode(F.when((k % 49 == 0) & (k % 50 != 0), F.array("amount", F.col("amount") + 1)).otherwise(F.array("amount"))).alias("amount"))
    refresh.refresh(kept, spark.read.parquet(f"{folder}/bank"), spark.read.parquet(f"{folder}/ledger"), named(bank, "BANK").unionByName(named(ledger, "LEDGER")))
    pairs = kept.pairs.read()
    totals = pairs.groupBy("component").agg(F.sum("score").alias("total"))
    sure = pairs.filter("margin > 0").select("component", "bank_id", "sheet_id", "margin", "ambiguous", "matched")
    return totals.join(sure, "component", "left")


def appended_rows(spark, sf_dir) -> DataFrame:
    """Orders of even customers are the ledger; two batches, which share every order with a number divisible by three, are appended to it, the first twice."""
    o = _table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.floor(F.col("o_totalprice")).cast("long").alias("amount"), F.concat(F.lit("Pedido "), (F.col("o_custkey") % 50).cast("string")).alias("description"), F.lit("Pix").alias("payment_method"), "o_custkey", "o_orderkey"
    )
    cols = ["date", "amount", "description", "payment_method"]
    table = VersionedTable(spark, _folder(spark), "date date, amount long, description string, payment_method string")
    of = lambda test: o.filter(test).select(cols)
    for batch in (of("o_custkey % 2 = 0"), of("o_orderkey % 2 = 0 or o_orderkey % 3 = 0"), of("o_orderkey % 2 = 0 or o_orderkey % 3 = 0"), of("o_orderkey % 2 = 1")):
        table.append(batch, views.to_append)
    return table.read()


def decision_stream(spark, sf_dir) -> DataFrame:
    """Events as versions of their user's decision, odd ones local, arriving as JSON files in the order of a hash and merged in batches of one file."""
    folder = _folder(spark)
    k = F.col("event_id")
    versions = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.to_date("ts").cast("timestamp").alias("updated_ts"), F.when(k % 5 == 0, "DELETED").otherwise("ACTIVE").alias("state"), F.when(k % 2 == 1, "local").otherwise("remote").alias("side"))
    versions.repartition(3, F.xxhash64("key", "updated_ts", "state")).write.json(f"{folder}/in")
    decisions.merge_new_files(spark, f"{folder}/in", f"{folder}/table", f"{folder}/progress", buckets=8, files_per_batch=1)
    return decisions.current(spark, f"{folder}/table").select("key", F.to_date("updated_ts").alias("day"), "state", "side")


def source_fold(spark, sf_dir) -> DataFrame:
    """Line items as movements of their order: the line's number is the source, the second one in another format, one of five texts by the supplier."""
    line = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    said = F.element_at(F.array(*map(F.lit, ("norte", "leste", "oeste", "praia", "campo"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = line.select(
        F.col("l_linenumber").cast("string").alias("source"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("row_idx"), F.lit("2026-01-05").cast("date").alias("date"), F.lit("DEBIT").alias("direction"),
        F.col("l_orderkey").cast("long").alias("amount"), F.lit("").alias("document"), F.when(F.col("l_linenumber") == 2, "OFX").otherwise("CSV").alias("format"), said.alias("original_description"),
    )
    return overlap.fold(rows).select("id", "source", "original_description", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("formats", ",").alias("formats"), F.array_join("descriptions", ",").alias("descriptions"))


def _card_decisions(purchases: DataFrame, costs: DataFrame):
    """By the part of a purchase: every 17th returned, every 13th confirmed with its own ledger row, every 11th refused its own row, every 7th the only one that may take its row."""
    own = F.concat(F.lit("s"), F.col("id"))
    part = F.col("part")
    key = lambda kind: F.concat_ws(":", F.lit(kind), "id")
    confirmed = purchases.filter(part % 13 == 0).select(F.col("id").alias("purchase_id"), own.alias("sheet_id"), key("C").alias("decision")).join(costs.select(F.col("id").alias("sheet_id")), "sheet_id", "left_semi")
    rejected = purchases.filter(part % 11 == 0).select(F.col("id").alias("purchase_id"), own.alias("sheet_id"), key("R").alias("decision"))
    reserved = purchases.filter(part % 7 == 0).select(own.alias("sheet_id"), F.col("id").alias("purchase_id"), key("O").alias("decision"))
    return purchases.filter(part % 17 == 0).select(F.col("id").alias("purchase_id")), confirmed, rejected, reserved


def card_expected_states(spark, sf_dir) -> DataFrame:
    """The purchases of card_group_states under decisions by their part; the state shown now is the pure one for orders with an even number. The chain is written as stage:outcome[evidence]decision."""
    purchases = cut(_group_purchases(spark, sf_dir, F.col("l_partkey").alias("part")))
    costs = _group_costs(spark, sf_dir, purchases)
    refunded, confirmed, rejected, reserved = _card_decisions(purchases, costs)
    now = purchases.select(F.col("id").alias("subject"), F.when(F.col("statement").cast("long") % 2 == 0, "CARD_REVIEW").otherwise("CARD_MISSING").alias("status"))
    out = expected.card_expected(purchases.drop("part"), costs, now, refunded, confirmed, rejected, reserved)
    shown = F.transform("chain", lambda s: F.concat(s["stage"], F.lit(":"), s["outcome"], F.lit("["), F.array_join(s["evidence"], ","), F.lit("]"), F.coalesce(s["decision"], F.lit(""))))
    return out.select("subject", "pure", "expected", "current", "target", F.array_join(shown, " > ").alias("chain"))


def _claims(spark, sf_dir) -> DataFrame:
    """Line items as claims of their order on one of three rows that two orders share for each line: by decision, as a group for every 13th part, else as it stands now."""
    line = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).distinct()
    source = F.when((F.col("o") + F.col("n")) % 3 == 0, "DECISION").when(F.col("p") % 13 == 0, "GROUP").otherwise("CURRENT")
    key = F.concat_ws("-", F.lit("d"), "o", "n", "p")
    return line.select(F.concat_ws("-", F.floor(F.col("o") / 2), F.col("n") * 3 + F.col("p") % 3).alias("sheet_id"), F.col("o").cast("string").alias("subject"), source.alias("source"), F.when(source == "DECISION", key).alias("decision"))


def claim_conflicts(spark, sf_dir) -> DataFrame:
    return claims.claim_conflicts(_claims(spark, sf_dir))


def safe_invalidations(spark, sf_dir) -> DataFrame:
    """Decisions of even orders are stale; orders with a number not divisible by five fit all their rows."""
    held = cut(_claims(spark, sf_dir))
    even = F.split("decision", "-")[1].cast("long") % 2 == 0
    statuses = held.filter("decision is not null").select("decision", F.when(even, "STALE").otherwise("VALID").alias("status"))
    exact = held.filter(F.col("subject").cast("long") % 5 != 0).select("subject", "sheet_id")
    return claims.safe_invalidations(held, statuses, exact)


def records_across_lines(spark, sf_dir) -> DataFrame:
    """Documents written as a delimited file with quoted texts and read again, record by record; n_lines is how many lines a record takes."""
    folder = _folder(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    docs.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/docs")
    rows = records.read_table(spark, f"{folder}/docs")
    value = lambda name: F.element_at("values", name)
    return rows.select(value("doc_id").cast("long").alias("doc_id"), F.sha2(value("text"), 256).alias("sha"), value("lang").alias("lang"), F.size(F.split(value("text"), "\n")).alias("n_lines"), "issue")


def audit_dismissals(spark, sf_dir) -> DataFrame:
    """Orders as findings, three in four dismissed before: the same but for the order of their parts, less grave, of another cause, of less impact, or without evidence of a row; every tenth without a signature."""
    k = F.col("k")
    texts = lambda *values: F.array(*(F.lit(v) for v in values))
    now = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(
        k, F.lit("DERIVED_STATE_MISMATCH").alias("code"), F.element_at(texts("CRITICAL", "REVIEW", "INFO"), (k % 3 + 1).cast("int")).alias("severity"), F.lit("INV-08").alias("invariant"), k.cast("string").alias("subject"),
        F.concat(F.lit("cause:"), k.cast("string")).alias("root_cause"), F.create_map(F.lit("sheetIdentity"), texts("s2", "s1"), F.lit("selected"), texts("d")).alias("target"),
        F.create_map(F.lit("row"), texts("r"), F.lit("updatedAt"), F.array(k.cast("string")), F.lit("candidateEvaluations"), texts("x")).alias("technical"), F.lit("high").alias("impact"), F.lit("CARD_MISSING").alias("current"),
        F.lit("CARD_MATCHED").alias("expected"), F.lit("CANONICAL").alias("identity"), F.lit(True).alias("comparable"),
    )
    of = lambda n, other, c: F.when(k % 5 == n, other).otherwise(F.col(c))
    then = now.filter(k % 4 != 3).withColumns({
        "target": F.create_map(F.lit("selected"), texts("d"), F.lit("index"), texts("7"), F.lit("sheetIdentity"), texts("s1", "s2")), "severity": of(1, F.lit("INFO"), "severity"), "root_cause": of(2, F.lit("other"), "root_cause"),
        "impact": of(3, F.lit("LOW"), "impact"), "technical": of(4, F.map_filter("technical", lambda name, _: name != "row"), "technical"),
    })
    saved = audit.signed(then).select("key", "severity", F.when(k % 10 != 5, F.col("signature")).alias("signature"), F.lit("2026-01-01").alias("dismissed_at"))
    return audit.dismissed(audit.signed(now), saved).select("k", "visible")


def bank_guard(spark, sf_dir) -> DataFrame:
    """Every fourth bank row is about to be written; every 7th pair is refused, and every ledger row with an even number is held by the bank row of the next number."""
    bank, ledger = mixed_bank(spark, sf_dir), mixed_ledger(spark, sf_dir)
    k = F.col("id").cast("long")
    pending = bank.filter(k % 4 == 0).select(F.col("id").alias("bank_id"))
    # Only refusals of the pending rows are asked for.
    edges = candidate_edges(bank.filter(k % 4 == 0), ledger).select("bank_id", "sheet_id")
    rejected = edges.filter((F.col("bank_id").cast("long") + F.col("sheet_id").cast("long")) % 7 == 0)
    taken = ledger.filter(k % 2 == 0).select(F.col("id").alias("sheet_id"), (k + 1).cast("string").alias("bank_id"))
    return guard.bank_guard(pending, bank, ledger, rejected, taken).select("bank_id", "allowed", "candidates", "free")


def invoice_guard(spark, sf_dir) -> DataFrame:
    """The purchases of card_group_states whose line has an even number are about to be written; every 5th has its own row refused."""
    purchases = cut(_group_purchases(spark, sf_dir))
    costs = _group_costs(spark, sf_dir, purchases)
    line, order = F.split("id", "-")[1].cast("int"), F.split("id", "-")[0].cast("long")
    pending = purchases.filter(line % 2 == 0).select(F.col("id").alias("purchase_id"))
    rejected = purchases.filter((line + order) % 5 == 0).select(F.col("id").alias("purchase_id"), F.concat(F.lit("s"), "id").alias("sheet_id"))
    return guard.invoice_guard(pending, purchases, purchases.select("statement", "due_date").distinct(), costs, rejected=rejected)


QUERIES = {f.__name__: f for f in (audit_dismissals, bank_guard, invoice_guard, refreshed_assignment, appended_rows, decision_stream, source_fold, card_expected_states, claim_conflicts, safe_invalidations, records_across_lines)}

_CLAIMS = """
    line AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem),
    claim AS (
        SELECT o // 2 || '-' || (n * 3 + p % 3) AS sheet, o, CASE WHEN (o + n) % 3 = 0 THEN 'DECISION' WHEN p % 13 = 0 THEN 'GROUP' ELSE 'CURRENT' END AS source, CASE WHEN (o + n) % 3 = 0 THEN 'd-' || o || '-' || n || '-' || p END AS decision FROM line
    )"""

ORACLE_SQL = {
    "bank_guard": f"""WITH {_ROWS}, open_edges AS (SELECT * FROM edges WHERE (kb + ks) % 7 <> 0),
        n AS (SELECT b, count(*) AS candidates, count(*) FILTER (ks % 2 = 1 OR ks + 1 = kb) AS free FROM open_edges GROUP BY b)
        SELECT bank.b AS bank_id, n.b IS NULL AS allowed, coalesce(candidates, 0) AS candidates, coalesce(free, 0) AS free FROM bank LEFT JOIN n USING (b) WHERE k % 4 = 0""",
    "invoice_guard": f"""WITH {_GROUPS}, x AS (SELECT *, id[-2:]::INTEGER AS line, (id[-2:]::INTEGER + o) % 5 = 0 AS refusing FROM p),
        pairs AS (SELECT x.id, o, x.amount, sheet FROM x JOIN s USING (amount) WHERE NOT (refusing AND sheet = 's' || x.id)),
        users AS (SELECT sheet, count(*) AS users FROM pairs GROUP BY 1), sets AS (SELECT id, list_sort(list(sheet)) AS rows, max(users) AS users FROM pairs JOIN users USING (sheet) GROUP BY 1),
        base AS (SELECT x.*, coalesce(rows, []) AS rows, users, count(*) OVER same AS n, min(coalesce(rows, [])) OVER same = max(coalesce(rows, [])) OVER same AS alike FROM x LEFT JOIN sets USING (id) WINDOW same AS (PARTITION BY o, amount, text)),
        told AS (SELECT *, CASE WHEN len(rows) > 1 AND n > 1 AND alike AND len(rows) = n AND users <= n THEN 'CARD_GROUP_MATCHED' WHEN len(rows) = 0 THEN 'CARD_MISSING' WHEN len(rows) = 1 AND users = 1 THEN 'CARD_MATCHED' ELSE 'CARD_REVIEW' END AS status FROM base)
        SELECT id AS purchase_id, status = 'CARD_MISSING' AS allowed, status, len(rows)::BIGINT AS candidates FROM told WHERE line % 2 = 0""",
    "audit_dismissals": "SELECT o_orderkey AS k, o_orderkey % 4 = 3 OR o_orderkey % 5 > 1 OR o_orderkey % 5 = 1 AND o_orderkey % 3 < 2 AS visible FROM orders",
    "refreshed_assignment": f"""WITH RECURSIVE {_ROWS}, {_solved("edges")}
        SELECT best.c AS component, total::BIGINT AS total, b AS bank_id, s AS sheet_id, margin::INTEGER AS margin, ambiguous, matched
        FROM best LEFT JOIN (SELECT c, b, s, margin, ambiguous, matched FROM planned WHERE margin > 0) USING (c)""",
    "appended_rows": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(floor(o_totalprice) AS BIGINT) AS amount, 'Pedido ' || (o_custkey % 50) AS description, 'Pix' AS payment_method, o_custkey, o_orderkey FROM orders)
        SELECT DISTINCT date, amount, description, payment_method FROM o WHERE o_custkey % 2 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 1""",
    "decision_stream": """SELECT user_id::VARCHAR AS key, CAST(ts AS DATE) AS day, CASE WHEN event_id % 5 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS state, CASE WHEN event_id % 2 = 1 THEN 'local' ELSE 'remote' END AS side FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, CASE WHEN side = 'local' AND state = 'DELETED' THEN 2 WHEN side = 'remote' THEN 1 ELSE 0 END DESC, state DESC) = 1""",
    "source_fold": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, ['norte', 'leste', 'oeste', 'praia', 'campo'][min(l_suppkey) % 5 + 1] AS said FROM lineitem GROUP BY ALL),
        q AS (SELECT *, row_number() OVER w AS i, lag(n) OVER w AS before, lag(said) OVER w AS said_before FROM l WINDOW w AS (PARTITION BY o ORDER BY n)),
        k AS (SELECT *, CASE WHEN i = 2 AND (n = 2) <> (before = 2) THEN said_before ELSE said END AS text FROM q)
        SELECT o || '-' || min(n) AS id, min(n)::VARCHAR AS source, text AS original_description, string_agg(n::VARCHAR, ',' ORDER BY n) AS source_ids,
            array_to_string(list_sort(list(DISTINCT CASE WHEN n = 2 THEN 'OFX' ELSE 'CSV' END)), ',') AS formats, array_to_string(list_sort(list(DISTINCT said)), ',') AS descriptions FROM k GROUP BY o, text""",
    "card_expected_states": f"""WITH {_GROUPS}, parts AS (SELECT l_orderkey || '-' || lpad(l_linenumber::VARCHAR, 2, '0') AS id, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
        x AS (SELECT p.*, part, part % 17 = 0 AS back FROM p JOIN parts USING (id)),
        own AS (SELECT sheet, amount, sheet[2:] AS owner, part FROM s JOIN parts ON parts.id = sheet[2:]),
        held AS (SELECT x.id, 's' || x.id AS sheet FROM x JOIN own ON own.owner = x.id WHERE NOT back AND x.part % 13 = 0 AND x.part % 11 <> 0),
        pairs AS (SELECT x.id, x.o, x.amount, sheet, owner, own.part % 7 = 0 AND owner <> x.id AS reserved, x.part % 11 = 0 AND owner = x.id AS refused FROM x JOIN own USING (amount) WHERE NOT back),
        found AS (SELECT pairs.* FROM pairs LEFT JOIN held ON held.sheet = pairs.sheet WHERE NOT reserved AND NOT refused AND (held.id IS NULL OR held.id = pairs.id)),
        users AS (SELECT sheet, count(*) AS users FROM found GROUP BY 1),
        sets AS (SELECT found.id, list_sort(list(sheet)) AS rows, max(users) AS users, min(sheet) AS sole FROM found JOIN users USING (sheet) GROUP BY 1),
        base AS (SELECT x.*, coalesce(rows, []) AS rows, users, sole, held.sheet AS hold FROM x LEFT JOIN sets USING (id) LEFT JOIN held USING (id)),
        free AS (SELECT *, count(*) OVER same AS n, min(rows) OVER same = max(rows) OVER same AS alike FROM base WHERE NOT back AND hold IS NULL WINDOW same AS (PARTITION BY o, amount, text)),
        grouped AS (SELECT id FROM free WHERE len(rows) > 1 AND n > 1 AND alike AND len(rows) = n AND users <= n),
        canonical AS (
            SELECT base.*, CASE WHEN back THEN 'CARD_REFUNDED' WHEN id IN (FROM grouped) THEN 'CARD_GROUP_MATCHED' WHEN hold IS NOT NULL THEN 'CARD_MATCHED' WHEN len(rows) = 0 THEN 'CARD_MISSING' WHEN len(rows) = 1 AND users = 1 THEN 'CARD_MATCHED' ELSE 'CARD_REVIEW' END AS canon FROM base
        ), reserved AS (SELECT id, arg_min(owner, sheet) AS owner, min(sheet) AS sheet FROM pairs WHERE reserved GROUP BY 1), refused AS (SELECT DISTINCT id FROM pairs WHERE refused),
        told AS (
            SELECT c.id, c.o, c.canon, st.status AS pure, CASE WHEN back THEN 1 WHEN hold IS NOT NULL THEN 2 WHEN c.id IN (FROM refused) THEN 3 WHEN r.id IS NOT NULL THEN 4 WHEN canon = 'CARD_GROUP_MATCHED' THEN 5 END AS step, hold, r.owner, r.sheet AS rs,
                CASE WHEN canon = 'CARD_MATCHED' THEN coalesce(hold, sole) WHEN canon = 'CARD_GROUP_MATCHED' THEN array_to_string(c.rows, ',') ELSE 'resultado final da atribuição global' END AS evidence, array_to_string(c.rows, ',') AS rows
            FROM canonical c JOIN st USING (id) LEFT JOIN reserved r USING (id)
        )
        SELECT id AS subject, pure, canon AS expected, CASE WHEN o % 2 = 0 THEN 'CARD_REVIEW' ELSE 'CARD_MISSING' END AS current, CASE WHEN step = 2 THEN hold END AS target,
            'PURE_MATCHING:' || pure || '[resultado do matcher sem decisões persistidas] > ' || CASE step WHEN 1 THEN 'REFUND:CARD_REFUNDED[compra integralmente neutralizada por crédito/estorno] > ' WHEN 2 THEN 'DECISION:confirmação manual válida aplicada[' || hold || ']C:' || id || ' > '
                WHEN 3 THEN 'DECISION:candidata rejeitada por decisão manual válida[]R:' || id || ' > ' WHEN 4 THEN 'RESERVATION:candidata reservada para outro subject[' || owner || ',' || rs || ']O:' || owner || ' > '
                WHEN 5 THEN 'GROUP_MATCHING:CARD_GROUP_MATCHED[' || rows || '] > ' ELSE '' END || 'FINAL_ASSIGNMENT:' || canon || '[' || evidence || ']' AS chain FROM told""",
    "claim_conflicts": f"""WITH {_CLAIMS}, s AS (SELECT sheet, o, bool_or(source IN ('CURRENT', 'DECISION')) AS resolved, bool_or(source = 'DECISION') AS decided FROM claim GROUP BY ALL)
        SELECT sheet AS sheet_id, count(*) AS subjects, count(*) FILTER (resolved) AS resolved, CASE WHEN count(*) FILTER (resolved) > 1 THEN 'CRITICAL' ELSE 'INFO' END AS severity, bool_or(decided) AS after_confirmation FROM s GROUP BY sheet HAVING count(*) > 1""",
    "safe_invalidations": f"""WITH {_CLAIMS}, owners AS (SELECT sheet, count(DISTINCT o) AS owners, count(DISTINCT decision) AS decisions FROM claim GROUP BY 1),
        firm AS (SELECT DISTINCT sheet, o FROM claim c WHERE source = 'CURRENT' AND o % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM claim g WHERE g.sheet = c.sheet AND g.o = c.o AND g.source = 'GROUP')),
        gone AS (SELECT DISTINCT c.sheet, c.decision, c.o AS obsolete FROM claim c JOIN owners USING (sheet) WHERE owners = 2 AND decisions = 1 AND decision IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claim x WHERE x.sheet = c.sheet AND x.o = c.o AND x.source <> 'DECISION')),
        proof AS (
            SELECT g.*, w.o AS winner, CASE WHEN obsolete % 2 = 0 THEN 'STALE' ELSE 'VALID' END AS decision_status, (SELECT min(f.sheet) FROM firm f JOIN owners z ON z.sheet = f.sheet WHERE f.o = g.obsolete AND f.sheet <> g.sheet AND z.owners = 1) AS separate_id
            FROM gone g JOIN firm w ON w.sheet = g.sheet AND w.o <> g.obsolete WHERE NOT EXISTS (SELECT 1 FROM claim d WHERE d.sheet = g.sheet AND d.o = w.o AND d.decision IS NOT NULL)
        )
        SELECT sheet AS sheet_id, decision, obsolete::VARCHAR AS obsolete, winner::VARCHAR AS winner, separate_id, decision_status FROM proof WHERE separate_id IS NOT NULL OR decision_status = 'STALE'""",
    "records_across_lines": "SELECT doc_id, sha256(coalesce(text, '')) AS sha, coalesce(lang, '') AS lang, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n_lines, NULL::VARCHAR AS issue FROM documents",
}
