from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.functions.identity import decision_key
from ledgerloom.operators import audit, cards, decisions, overlap, reconciliation, views
from ledgerloom.sources import export, files

PURCHASE = "id string, statement string, card string, date date, due_date date, description string, amount long, type string, direction string, number int, total int"
COST = "id string, date date, description string, amount long, direction string, type string, payment_method string, number int, total int"


def purchase(key, day, text, amount, number=None, total=None, kind="PURCHASE"):
    return (key, "s", "c", date(2026, 1, day), date(2026, 2, 10), text, amount, kind, "DEBIT" if kind == "PURCHASE" else "CREDIT", number, total)


def cost(key, day, text, amount, number=None, total=None, pay="Crédito_Bradesco", kind="EXPENSE"):
    return (key, day, text, amount, "DEBIT", kind, pay, number, total)


def test_installments_and_due_dates(spark):
    bought = spark.createDataFrame([purchase("p1", 5, "Loja Azul", 100, 2, 3), purchase("p2", 5, "Loja Azul", 200), purchase("p3", 5, None, 300), purchase("p4", 9, "Zeta", 400, 1, 2)], PURCHASE)
    rows = spark.createDataFrame([
        cost("a", date(2026, 1, 20), "(2/3) loja azul", 100, 2, 3), cost("b", date(2026, 1, 20), "(3/3) loja azul", 100, 3, 3), cost("c", date(2026, 2, 10), "x", 200), cost("d", date(2026, 1, 5), "Loja Azul", 200),
        cost("e", date(2026, 1, 20), "y", 300), cost("f", date(2026, 1, 5), "y", 300, pay="Pix"), cost("g", date(2026, 1, 5), None, 300, kind="TRANSFER"),
        cost("h", date(2025, 12, 5), "(1/2) outra coisa", 400, 1, 2), cost("i", date(2026, 1, 5), "(2/2) outra coisa", 400, 2, 2),
    ], COST)
    got = {(r.purchase_id, r.sheet_id) for r in cards.candidates(bought, rows).collect()}
    assert got == {("p1", "a"), ("p2", "c"), ("p4", "h")}
    assert {r.id for r in cards.in_sequence(rows).collect()} == {"h", "i"}
    back = spark.createDataFrame([("p1",)], "purchase_id string")
    states = {r.purchase_id: (r.status, r.sheet_id) for r in cards.purchase_states(bought, rows, back).collect()}
    assert states == {"p1": ("CARD_REFUNDED", None), "p2": ("CARD_MATCHED", "c"), "p3": ("CARD_MISSING", None), "p4": ("CARD_MATCHED", "h")}


def test_refunds_need_one_partner(spark):
    rows = [purchase("p1", 1, "A", 5), purchase("r1", 1, "a", 5, kind="REFUND"), purchase("p2", 2, "A", 5), purchase("p3", 2, "A", 5), purchase("r2", 2, "A", 5, kind="REFUND"), purchase("q1", 3, "B", 4, 1, 2), purchase("q2", 3, "B", 4, 2, 2), purchase("r3", 3, "B", 8, kind="REFUND")]
    df = spark.createDataFrame(rows, PURCHASE)
    assert [tuple(r) for r in cards.refunds(df).collect()] == [("p1", "r1")]
    assert [(r.refund_id, r.purchase_ids, r.amount) for r in cards.installment_refunds(df).collect()] == [("r3", ["q1", "q2"], 8)]
    nothing = spark.createDataFrame([], PURCHASE)
    assert cards.refunds(nothing).count() == cards.installment_refunds(nothing).count() == cards.purchase_states(nothing, spark.createDataFrame([], COST)).count() == 0


def decision(kind, identities, selected=(), stamp="2026-01-01T00:00:00Z"):
    return (kind, list(identities), list(selected), stamp)


def made(spark, *rows):
    df = spark.createDataFrame(list(rows), "kind string, identities array<string>, selected array<string>, updated_at string")
    return df.select(decision_key(F.col("kind"), F.col("identities")).alias("key"), F.lit(1).alias("schema_version"), "*", F.lit("ACTIVE").alias("state"))


BANK = "id string, date string, amount long, direction string, direction_known boolean, type string, original_description string, counterparty_name string, payment_method string"
SHEET = "id string, date string, amount long, direction string, type string, original_description string, payment_method string"


def sides(spark):
    """Ten bank and ledger rows of 10, 20, ... cents a piece, and a card row of the first amount."""
    banks = [(f"b{i}", "2026-01-05", 10 * i, "DEBIT", True, "EXPENSE", "PIX ENVIADO", None, "Pix") for i in range(1, 10)] + [("b10", "2026-01-05", 40, "DEBIT", True, "EXPENSE", "PIX ENVIADO", None, "Pix")]
    sheets = [(f"s{i}", "2026-01-06" if i != 7 else "2026-03-06", 10 * i, "DEBIT", "EXPENSE", "x", "Pix") for i in range(1, 10)]
    day = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))
    return day(banks, BANK), day(sheets, SHEET)


def test_decisions_reach_the_reconciliation(spark):
    bank, ledger = sides(spark)
    chosen = made(
        spark, decision("PAIR_CONFIRMED", ["b1"], ["s1"]), decision("PAIR_REJECTED", ["b2", "s2"]), decision("BANK_IGNORED", ["b3"]), decision("PAIR_CONFIRMED", ["b4"], ["s4"]), decision("PAIR_CONFIRMED", ["b10"], ["s4"]),
        decision("PAIR_CONFIRMED", ["b5"], ["s6"]), decision("PAIR_CONFIRMED", ["b7"], ["s7"]), decision("STATEMENT_MATCH_CONFIRMED", ["b8"], ["s8"]), decision("PAIR_CONFIRMED", ["b9"], ["gone"]), decision("PAIR_REJECTED", ["b6", "s7"]), decision("MISSING_ADDED_TO_SHEET", ["b6"], ["s6"]),
    )
    states = {(r.kind, r.key.split('"')[1]): r.status for r in decisions.status(chosen, bank, ledger).collect()}
    assert states["PAIR_CONFIRMED", "b1"] == "VALID" and states["PAIR_CONFIRMED", "b5"] == "STALE" and states["PAIR_CONFIRMED", "b7"] == "NEEDS_REVIEW" and states["PAIR_CONFIRMED", "b9"] == "ORPHANED" and states["PAIR_REJECTED", "b6"] == "STALE"
    pairs = {(r.bank_id, r.sheet_id): r.conflicting for r in decisions.confirmed_pairs(chosen, bank, ledger).collect()}
    assert pairs == {("b1", "s1"): False, ("b4", "s4"): True, ("b10", "s4"): True}
    full = ledger.withColumn("row_idx", F.lit(1)).withColumn("description", F.col("original_description"))
    items = {r.bank_id: r for r in reconciliation.reconcile(bank, full, decisions.hydrate(chosen, bank, ledger)).items.collect()}
    assert [(items[b].status, items[b].method) for b in ("b1", "b6")] == [("MATCHED", "MANUAL")] * 2 and items["b2"].status == "MISSING" and items["b3"].status == "IGNORED"
    assert {(items[b].status, items[b].review_reason, items[b].sheet_id) for b in ("b4", "b10")} == {("REVIEW", "ASSIGNMENT_CONFLICT", None)} and items["b8"].status == "REVIEW"


def test_tombstones_upserts_and_conflicts(spark):
    chosen = made(spark, decision("PAIR_CONFIRMED", ["b1"], ["s1"]), decision("PAIR_CONFIRMED", ["b2"], ["s1"], "2027-01-01T00:00:00Z"))
    key = 'PAIR_CONFIRMED:["b1"]'
    old = spark.createDataFrame([(key, "2026-05-01T00:00:00.500Z"), ("other", "2026-01-01T00:00:00Z")], "key string, updated_at string")
    stones = {r.key: r.updated_at for r in decisions.bury(chosen, old, "2026-04-01T00:00:00Z").collect()}
    assert stones == {key: "2026-05-01T00:00:00.501Z", 'PAIR_CONFIRMED:["b2"]': "2027-01-01T00:00:00.001Z", "other": "2026-01-01T00:00:00.000Z"}
    table = spark.createDataFrame([("a", "ACTIVE", "t1", "2026-01-01T00:00:00Z"), ("b", "ACTIVE", "t1", "x"), ("c", "ACTIVE", "t1", "t0")], "key string, state string, updated_at string, created_at string")
    changed = spark.createDataFrame([("a", "DELETED", "2026-02-02T00:00:00Z"), ("b", "ACTIVE", "2026-02-02T00:00:00Z"), ("d", "ACTIVE", "2026-02-02T00:00:00Z")], "key string, state string, updated_at string")
    got = {r.key: (r.state, r.created_at, r.place) for r in decisions.upsert(table, changed).collect()}
    assert got == {"a": ("DELETED", "2026-01-01T00:00:00Z", 1), "b": ("ACTIVE", "2026-02-02T00:00:00Z", 2), "c": ("ACTIVE", "t0", 0), "d": ("ACTIVE", "2026-02-02T00:00:00Z", 2)}
    listed = spark.createDataFrame([("f", "s1", key), ("f", "s1", 'PAIR_CONFIRMED:["b2"]'), ("g", "s1", key), ("g", "s1", key), ("h", "s9", key)], "finding string, row string, key string")
    assert [(r.finding, r.key) for r in decisions.resolvable(listed, chosen, old.filter("key = 'other'")).orderBy("key").collect()] == [("f", key), ("f", 'PAIR_CONFIRMED:["b2"]')]
    assert decisions.resolvable(listed, chosen, old).count() == 1


def test_card_decisions(spark):
    bought = [("p1", 10), ("p2", 20), ("p3", 30)]
    p = spark.createDataFrame([(i, "st", "1", "2026-01-01", "2026-02-10", "loja", a, "PURCHASE", "DEBIT", None, None) for i, a in bought], "id string, statement string, card string, date string, due_date string, description string, amount long, type string, direction string, number int, total int").withColumn("date", F.to_date("date")).withColumn("due_date", F.to_date("due_date"))
    c = spark.createDataFrame([("r1", "2026-02-10", "x", 10), ("r2", "2026-05-10", "x", 20), ("r3", "2026-05-10", "x", 99)], "id string, date string, description string, amount long").select("id", F.to_date("date").alias("date"), "description", "amount", F.lit("DEBIT").alias("direction"), F.lit("EXPENSE").alias("type"), F.lit("Crédito_Bradesco").alias("payment_method"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("int").alias("total"))
    aliases = spark.createDataFrame([("a1", "p1"), ("old1", "p1"), ("a2", "p2"), ("a3", "p3")], "identity string, purchase_id string")
    chosen = made(
        spark, decision("STATEMENT_MATCH_CONFIRMED", ["a1"], ["r1"]), decision("STATEMENT_MATCH_CONFIRMED", ["a2"], ["r2"]), decision("STATEMENT_MATCH_CONFIRMED", ["a3"], ["r3"]), decision("STATEMENT_MATCH_CONFIRMED", ["old1"], ["r1"]), decision("STATEMENT_MATCH_CONFIRMED", ["zz"], ["r1"]),
        decision("CARD_MISSING_CONFIRMED", ["a1"]), decision("CARD_MISSING_CONFIRMED", ["a3"]), decision("CARD_PURCHASE_IGNORED", ["a2"]), decision("CARD_PURCHASE_IGNORED", ["zz"]), decision("CARD_REVIEW_REJECTED_CANDIDATES", ["a1"], ["r1"]), decision("CARD_REVIEW_REJECTED_CANDIDATES", ["a2"], ["r2"]), decision("CARD_REVIEW_REJECTED_CANDIDATES", ["a3"], ["none"]),
    )
    got = {(r.kind.split("_")[1] + r.kind[-5:], r.key.split('"')[1]): r.status for r in decisions.card_status(chosen, aliases, p, c).collect()}
    assert got == {
        ("MATCHIRMED", "a1"): "VALID", ("MATCHIRMED", "a2"): "NEEDS_REVIEW", ("MATCHIRMED", "a3"): "STALE", ("MATCHIRMED", "old1"): "VALID", ("MATCHIRMED", "zz"): "NEEDS_REVIEW", ("MISSINGIRMED", "a1"): "STALE", ("MISSINGIRMED", "a3"): "VALID",
        ("PURCHASENORED", "a2"): "VALID", ("PURCHASENORED", "zz"): "ORPHANED", ("REVIEWDATES", "a1"): "VALID", ("REVIEWDATES", "a2"): "STALE", ("REVIEWDATES", "a3"): "ORPHANED",
    }
    held = decisions.statement_assignments(chosen, aliases, p, c).collect()
    assert {(r.purchase_id, r.sheet_id, r.conflicting) for r in held} == {("p1", "r1", False)}
    assert [r.key for r in decisions.superseded_owners(chosen, spark.createDataFrame([("p1", "r1")], "purchase_id string, row string"), aliases).collect()] == ['STATEMENT_MATCH_CONFIRMED:["zz"]']


def test_applicable_and_replaced(spark):
    chosen = made(spark, decision("BANK_IGNORED", ["b1"]), decision("BANK_IGNORED", ["b2"]), decision("BANK_IGNORED", ["b3"]), decision("BANK_IGNORED", [" "]), decision("PAIR_CONFIRMED", ["b4"], ["s1"]))
    gone = spark.createDataFrame([('BANK_IGNORED:["b1"]', "2026-01-01T00:00:00Z"), ('BANK_IGNORED:["b2"]', "2025-12-31T00:00:00Z")], "key string, updated_at string")
    blocked = spark.createDataFrame([('BANK_IGNORED:["b3"]',)], "key string")
    assert {r.identities[0] for r in decisions.applicable(chosen, gone, blocked).collect()} == {"b2", "b4"}
    new = made(spark, decision("PAIR_REJECTED", ["b4", "s1"]))
    assert sorted(r.kind for r in decisions.replace(chosen, new).collect()) == ["BANK_IGNORED"] * 4 + ["PAIR_REJECTED"]
    marked = decisions.integrity(chosen.unionByName(chosen.limit(1))).groupBy("issue").count().collect()
    assert {r.issue: r["count"] for r in marked} == {"DUPLICATE_REMOTE_DECISION_ID": 2, "INVALID_REMOTE_DECISION_ROW": 1, None: 3}
    a, b = (decisions.effective_revision(df).first() for df in (chosen, chosen.orderBy(F.desc("key"))))
    assert a == b and decisions.effective_revision(chosen.limit(0)).first().decisions == 0


MOVE = "id string, row_idx int, date date, direction string, amount long, document string, format string, original_description string"


def test_overlap_by_order_and_evidence(spark):
    day = date(2026, 1, 1)
    old = [(f"k{i}", i, day, "DEBIT", i, None, "CSV", "aaa bbb") for i in range(20)] + [("x1", 30, day, "DEBIT", 99, None, "CSV", "u"), ("x2", 31, day, "DEBIT", 99, None, "CSV", "v")]
    new = [(f"n{i}", i, day, "DEBIT", i, None, "OFX", None) for i in range(20)] + [("y1", 30, day, "DEBIT", 99, None, "OFX", "w"), ("y2", 31, day, "DEBIT", 99, None, "OFX", "v")]
    known, incoming = spark.createDataFrame(old, MOVE), spark.createDataFrame(new, MOVE)
    got = {r.known_id: (r.incoming_id, r.how) for r in overlap.overlaps(known, incoming).collect()}
    assert got.pop("x2") == ("y2", "TEXT") and got.pop("x1") == ("y1", "ORDER") and all(got[f"k{i}"] == (f"n{i}", "SINGLE") for i in range(20))
    weak = incoming.filter("amount > 90")
    assert {r.known_id for r in overlap.overlaps(known, weak).collect()} == {"x2"}
    merged = overlap.merge(known.withColumn("source_ids", F.array(F.lit("one"))), weak, "two").collect()
    assert len(merged) == 23 and {r.id: r.source_ids for r in merged}["x2"] == ["one", "two"] and {r.id: r.source_ids for r in merged}["y1"] == ["two"]


def test_overlap_by_likeness(spark):
    day = date(2026, 1, 1)
    row = lambda i, text, n=1: (i, n, day, "DEBIT", 5, None, "CSV", text)
    known = spark.createDataFrame([row("k1", "pix joao silva souza"), row("k2", "padaria central do bairro"), row("k3", "mercado novo azul"), row("k4", "mercado novo azul")], MOVE)
    incoming = spark.createDataFrame([row("n1", "joao silva souza"), row("n2", "padaria central"), row("n3", "central padaria"), row("n4", "mercado azul novo")], MOVE)
    assert [(r.known_id, r.incoming_id, r.how) for r in overlap.overlaps(known, incoming).collect()] == [("k1", "n1", "LIKE")]


def test_findings(spark):
    found = spark.createDataFrame([("A", "REVIEW", "s1", None), ("B", "CRITICAL", "s1", ["x", "y"]), ("A", "REVIEW", "s2", None)], "code string, severity string, subject string, related array<string>")
    assert sorted((r.subject, r.code, r.others) for r in audit.collapse(found).collect()) == [("s1", "A", []), ("s1", "B", []), ("s2", "A", [])]
    card = spark.createDataFrame([("EDITED_SHEET_REFERENCE", "INFO", "p"), ("DERIVED_STATE_MISMATCH", "REVIEW", "p"), ("DOUBLE_CLAIM", "CRITICAL", "p"), ("DOUBLE_CLAIM", "CRITICAL", "p")], "code string, severity string, subject string")
    assert sorted((r.code, r.others) for r in audit.collapse(card).collect()) == [("DERIVED_STATE_MISMATCH", ["EDITED_SHEET_REFERENCE"]), ("DOUBLE_CLAIM", [])]
    told = [("CRITICAL", "ACTIVE", "PRIMARY", "x"), ("CRITICAL", "ACTIVE", "PRIMARY", "x"), ("REVIEW", "ACTIVE", "PRIMARY", "x"), ("REVIEW", "ACTIVE", "RELATED", "y"), ("INFO", "LEGACY", "INFO", "z"), ("INFO", "MAINTENANCE", "INFO", "w")]
    assert tuple(audit.audit_summary(spark.createDataFrame(told, "severity string, status string, role string, root_cause string")).first()) == (1, 1, 1, 1, 2, 1)
    hidden = spark.createDataFrame([("A", "s2", "REVIEW"), ("B", "s1", "REVIEW")], "code string, subject string, severity string")
    assert {(r.code, r.subject): r.visible for r in audit.hidden(found, hidden).collect()} == {("A", "s1"): True, ("B", "s1"): True, ("A", "s2"): False}
    rules = audit.invariants(found, {"ONE": ["A"], "TWO": ["Z"], "THREE": ["B"]}, skipped=("THREE",)).collect()
    assert {r.invariant: (r.status, r.findings) for r in rules} == {"ONE": ("FAIL", 2), "TWO": ("PASS", 0), "THREE": ("UNAVAILABLE", 1)}
    assert [r.related for r in export.findings_export(found.orderBy("code")).collect()].count("x / y") == 1
    assert audit.revision(found, found.columns).first() == audit.revision(found.orderBy(F.desc("code")), found.columns).first() != audit.revision(found.limit(2), found.columns).first()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x"), (tmp_path / "b.csv").write_text("x"), (tmp_path / "c.ofx").write_text("y")
    listed = files.listing(spark, str(tmp_path))
    assert sorted((r.name, r.copy_of is not None) for r in files.first_copies(listed).collect()) == [("a.csv", False), ("b.csv", True), ("c.ofx", False)]
    now = spark.createDataFrame([("f1", datetime(2026, 1, 1), 5, None, "k", "d"), ("f2", datetime(2026, 1, 1), 5, "m", "k", "d")], "file_id string, modified_time timestamp, size long, mime_type string, kind string, folder_id string")
    index = now.withColumn("processing_status", F.when(F.col("file_id") == "f1", "PROCESSED").otherwise("ERROR"))
    assert [r.file_id for r in files.changed(now, index).collect()] == ["f2"]


def test_audit_states(spark):
    items = spark.createDataFrame([("a", "MISSING", None, None, None, "EXPENSE", "DEBIT", "x"), ("b", "MISSING", None, None, None, "EXPENSE", "DEBIT", "Gastos cartao de credito"), ("c", "MATCHED", None, None, ["s"], "CARD_PAYMENT", "DEBIT", "x"), ("d", "REVIEW", "DIRECTION_UNCERTAIN", None, None, "EXPENSE", "DEBIT", "x"), ("e", "REVIEW", "ASSIGNMENT_CONFLICT", "s1", None, "EXPENSE", "DEBIT", "x"), ("f", "MISSING", None, None, None, "EXPENSE", "DEBIT", "x")], "bank_id string, status string, review_reason string, sheet_id string, composition array<string>, type string, direction string, text string")
    edges = spark.createDataFrame([("a", "REJECTED_BY_DECISION"), ("a", "AVAILABLE"), ("f", "REJECTED_BY_DECISION")], "bank_id string, disposition string")
    claims = spark.createDataFrame([("x", "s1", True)], "subject string, sheet_id string, confirmed boolean")
    refunds = spark.createDataFrame([("REFUNDED", ["f"]), ("PARTIAL", ["b"])], "status string, original_ids array<string>")
    got = {(r.code, r.subject) for r in audit.state_findings(items, edges, claims, refunds).collect()}
    assert got == {("MISSING_WITH_STRONG_CANDIDATE", "a"), ("CARD_PAYMENT_AS_EXPENSE_MISSING", "b"), ("REVIEW_WITHOUT_CANDIDATES", "d"), ("ASSIGNMENT_CONFLICT", "e"), ("EXPECTED_MANUAL_REJECTION", "f"), ("REFUNDED_BUT_MISSING", "f")}
    rich = audit.enrich(audit.state_findings(items, edges, claims, refunds))
    kept = {(r.code, tuple(r.related_codes)) for r in audit.group_by_cause(rich.withColumn("subject", F.lit("one")).withColumn("root_cause", F.regexp_replace("root_cause", ":.*", ":one"))).collect()}
    assert ("MISSING_WITH_STRONG_CANDIDATE", ("ASSIGNMENT_CONFLICT",)) in kept and ("ASSIGNMENT_CONFLICT", ()) not in kept
    sure = rich.withColumn("confidence", F.lit("HIGH"))
    assert {r.severity for r in audit.finalize(sure, "STALE").filter("code = 'MISSING_WITH_STRONG_CANDIDATE'").collect()} == {"REVIEW"} and audit.finalize(sure, "STALE").count() == rich.count() + 1
    assert {r.confidence for r in audit.finalize(sure, "PARTIAL").collect()} == {"MEDIUM"} and audit.finding_filter(rich, "CRITICAL").count() == 3
    shot = lambda *rows: spark.createDataFrame(list(rows), "source string, revision string, mixed boolean, unavailable boolean")
    state = lambda a, b: tuple(audit.snapshot_state(a, b).first())
    one, other = shot(("bank", "1", False, False), ("drive", "2", False, True)), shot(("bank", "9", False, False), ("drive", "2", False, True))
    assert state(one, other) == ("STALE", ["bank"]) and state(one, one) == ("PARTIAL", []) and state(shot(("a", "1", True, True)), shot(("a", "1", False, False))) == ("MIXED_REVISION", [])


def test_duplicates_by_source_sets(spark):
    rows = [("a", ["1", "2"]), ("b", ["2"]), ("c", ["3"]), ("d", []), ("e", ["2", "1"])]
    df = spark.createDataFrame(rows, "id string, source_ids array<string>").select("*", F.lit("2026-01-01").cast("date").alias("date"), F.lit(1).alias("amount"), F.lit("DEBIT").alias("direction"), F.lit("x").alias("original_description"))
    members = audit.duplicates_across_sources(df)
    assert {r.id for r in members.collect()} == {"a", "b", "c", "e"} and [(r.subject, r.related) for r in audit.duplicate_findings(members).collect()] == [("a", ["b", "c", "e"])]
    assert audit.duplicates_across_sources(df.filter("id in ('a', 'b', 'e')")).count() == 0


def test_exports(spark, tmp_path):
    bank = spark.createDataFrame([("b1", date(2026, 1, 2), "a", 123456, "DEBIT", "EXPENSE", "Pix", 'd"1'), ("b2", date(2026, 1, 3), "bill", -50, "DEBIT", "CARD_PAYMENT", "", None)], "id string, date date, original_description string, amount long, direction string, type string, payment_method string, bank_transaction_id string")
    ledger = spark.createDataFrame([("s1", date(2026, 1, 1), "x", 5, "Pix")], "id string, date date, original_description string, amount long, payment_method string")
    items = spark.createDataFrame([("b1", "MISSING", None, None, None, None, None), ("b2", "CARD_DIVERGENCE", None, None, None, ["s1", "z"], "REVIEW")], "bank_id string, status string, sheet_id string, score int, reasons array<string>, composition array<string>, composition_status string")
    missing = export.missing_export(items, bank)
    assert tuple(missing.first())[1:3] == ("a", "R$ 1234,56") and export.out_of_scope_export(items, bank, ledger).count() == export.review_export(items, bank, ledger).count() == 0
    bills = export.card_payments_export(items, bank, ledger, spark.createDataFrame([("b2", 3, 150)], "bill_id string, candidates int, candidate_total long")).collect()
    assert sorted((r["Valor compra"], r["Total fatura"], r["Diferença pagamento menos compras"]) for r in bills) == [("", "R$ -0,50", "R$ -2,00"), ("R$ 0,05", "R$ -0,50", "R$ -2,00")]
    members = spark.createDataFrame([("s1", date(2026, 1, 1), 5), ("z", date(2026, 1, 1), 5)], "id string, date date, amount long")
    assert [r["Valor"] for r in export.duplicates_export(members, ledger).collect()] == ["R$ 0,05"] * 2
    metrics = {r["Métrica"]: r["Valor"] for r in export.summary_export(items, bank, ledger, ledger, members.withColumn("anchor_id", F.lit("s1"))).collect()}
    assert len(metrics) == 16 and metrics["Possíveis ausências"] == "1" and metrics["Total planilha"] == "R$ 0,05" and metrics["Possíveis duplicidades"] == "1" and metrics["Saldo final"] == ""
    export.write_csv(missing.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert text.startswith('\ufeff"Data";"Descrição original"') and text.endswith('"Pix";"d""1"\r\n') and text.count("\r\n") == 2
    found = spark.createDataFrame([("A", "b1", ["s1", "none"])], "code string, subject string, related array<string>")
    assert sorted((r.kind, r.id) for r in export.diagnostic_json(found, bank, ledger).collect()) == [("bank", "b1"), ("finding", "A:b1"), ("ledger", "s1")]


def test_views(spark):
    two = lambda *ids: spark.createDataFrame([(i,) for i in ids], "bank_id string")
    assert {(r.side, r.bank_id) for r in views.counter_divergence(two("a", "b"), two("b", "c")).collect()} == {("LEFT", "a"), ("RIGHT", "c")}
    entries = spark.createDataFrame([("a", ["f2", "f1"], None), ("b", ["f3"], None), ("c", ["f3"], ["m"])], "name string, drive_ids array<string>, manual_ids array<string>")
    listed = spark.createDataFrame([("f1",), ("f2",)], "file_id string")
    assert {r.name: r.drive_ids for r in views.active_sources(entries, listed).collect()} == {"a": ["f2", "f1"], "c": []}
    row = "date string, amount long, description string, payment_method string"
    pending = spark.createDataFrame([("2026-01-01", 5, "Café  Bar", "Crédito_Bradesco"), ("2026-01-01", 5, "cafe bar", "credito bradesco"), ("2026-01-01", 6, "x", "Pix")], row)
    assert [r.amount for r in views.to_append(pending, spark.createDataFrame([("2026-01-01", 6, "X!", "pix")], row)).collect()] == [5]
    sheet = [(2, "a", "d", "1", "c", "p", "i1"), (3, "", None, " ", "", "", ""), (4, "a", "d", "", "c", "p", "i1"), (5, "a", "d", "1", "c", "p", None)]
    assert {(r.line, r.problem) for r in views.matrix_problems(spark.createDataFrame(sheet, "line int, description string, date string, amount string, category string, payment_method string, id string")).collect()} == {(2, "DUPLICATE_ID"), (4, "DUPLICATE_ID"), (4, "MISSING_AMOUNT"), (5, "MISSING_ID")}
    keys = spark.range(50).select(F.col("id").cast("string").alias("k"))
    first = {r.k: r.new_id for r in views.new_ids(keys, spark.createDataFrame([], "id string"), "k").collect()}
    again = {r.k: r.new_id for r in views.new_ids(keys, spark.createDataFrame([(first["7"].upper(),)], "id string"), "k").collect()}
    assert len(set(first.values())) == 50 and again["7"] != first["7"] and all(len(i) == 8 for i in again.values())


def test_unmatched_view(spark):
    states = spark.createDataFrame([("CARD_MATCHED", "s1", None), ("CARD_GROUP_MATCHED", None, ["s2"]), ("CARD_REVIEW", "s3", None)], "status string, sheet_id string, sheet_ids array<string>")
    left = views.unmatched_view(spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "id string"), states, spark.createDataFrame([("s4",)], "sheet_id string"))
    assert [r.id for r in left.collect()] == ["s3"]
