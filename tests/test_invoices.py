import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog_invoices
from ledgerloom.operators import cards, records
from ledgerloom.sources import invoices

D = datetime.date
ONE_CARD = [
    "Fatura | Data 07/10/2026 - 03:39:06", "Cartao selecionado", "**** **** **** 1271", "Data de vencimento: | 12/06/2026", "Total da fatura: | R$ 827,67", "Forma de pagamento: | Débito em conta", "Melhor data de compra: 30",
    "Data | Lançamentos | Moeda de Origem | Valor (R$)", "Saldo anterior | 191,68", "12", "PAGTO. POR DEB EM C/C | 191,68-", "MAI", "28", "LOJA A 1/4 | 255,99", "SEGURO | 9,99", "ABR", "05/05 | LOJA B | | 561,69", "sem valor", "IOF | 10,00", "LOJA A 2/4 | | | 10,00 | -",
    "Total da fatura (final 1271): R$ 827,67", "DEPOIS | 5,00", "Resumo das Despesas | Real", "Saldo anterior | 191,68", "(-)Pagamentos/Créditos: | 201,68", "(+)Despesas locais: | 837,67",
]
TWO_CARDS = [
    "Fatura | Data 07/10/2026 - 00:00:00", "Cartao selecionado", "Data de vencimento: | 12/01/2026", "Total da fatura: | R$ 20,00", "Gastos referentes ao cartão: Final 1111 | TITULAR | Valor da fatura: | R$ 10,00", "19", "UM | 10,00", "DEZ",
    "Gastos referentes ao cartão: Final 2222 | TITULAR | Valor da fatura: | R$ 10,00", "SEM DATA | 50,00", "22", "PERDIDA | 7,00", "23", "DOIS | 10,00", "DEZ", "01/01", "TRES | 4,00", "QUATRO | 6,00-", "Resumo das Despesas | Real",
]


@pytest.fixture(scope="module")
def parsed(spark):
    pages = [("one", [ONE_CARD]), ("two", [TWO_CARDS[:8], TWO_CARDS[8:]]), ("none", [["Uma carta qualquer"]]), ("null", None), ("empty", [])]
    out = invoices.parse(spark.createDataFrame(pages, "file string, pages array<array<string>>"))
    return {name: getattr(out, name).collect() for name in ("statements", "rows", "adjustments", "subtotals")}


def test_rows_of_one_card(parsed):
    got = [(r.card, r.date, r.description, r.amount, r.direction, r.number, r.total) for r in sorted((r for r in parsed["rows"] if r.file == "one"), key=lambda r: r.place)]
    card = "XXXX XXXX XXXX 1271"
    assert got == [
        (card, D(2026, 4, 28), "LOJA A", 25599, "DEBIT", 1, 4), (card, D(2026, 4, 28), "SEGURO", 999, "DEBIT", None, None), (card, D(2026, 5, 5), "LOJA B", 56169, "DEBIT", None, None), (card, D(2026, 5, 5), "LOJA A", 1000, "CREDIT", 2, 4),
    ]
    assert [(a.kind, a.amount, a.date) for a in parsed["adjustments"]] == [("TAX", 1000, D(2026, 5, 5))]


def test_lines_are_read_once_for_all_results(spark):
    out = invoices.parse(spark.createDataFrame([("two", [TWO_CARDS])], "file string, pages array<array<string>>"))
    assert not any("Window" in df._jdf.queryExecution().executedPlan().toString() for df in (out.statements, out.rows, out.adjustments, out.subtotals))


MOBILE = [
    ["Total da fatura Vencimento", "R$ 30,00 12/01/2026", "Saldo anterior 5,00", "Créditos/Pagamentos 5,00", "Compras/Débitos 30,00"],
    ["Lançamentos", "Numero do Cartao 1234 XXXX XXXX 5678", "Data | Histórico de Lançamentos | Cidade | R$", "20/12 | PAGTO POR DEB EM C/C | | 5,00-", "21/12 | LOJA A (1/3) | RECIFE | 10,00", "05/01 | LOJA B | OLINDA | 2,00-", None, "99/99 | SEM DIA | X | 1,00",
     "Total para FULANO", "8,00", "9,00", "Numero do Cartao 1234 XXXX XXXX 9999", "03/01 | Saldo anterior | X | 4,00", "04/01 | IOF | | 1,00", "06/01 20,00", "06/01 LOJA C 22,00", "Total para BELTRANO 22,00", "Total da fatura em real 30,00", "Limites", "01/01 | FORA | X | 1,00"],
]


def test_rows_and_subtotals_come_from_one_pass_over_the_lines(spark, monkeypatch):
    passes, keep = [], invoices.cut
    monkeypatch.setattr(invoices, "cut", lambda df: passes.append("Window" in df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    out = invoices.parse(spark.createDataFrame([("m", MOBILE), ("one", [ONE_CARD]), ("two", [TWO_CARDS]), ("null", None)], "file string, pages array<array<string>>"))
    assert sum(passes) == 1
    assert sorted((r.file, r.card[-4:], r.amount) for r in out.subtotals.collect()) == [("m", "5678", 800), ("m", "9999", 2200), ("one", "1271", 82767), ("two", "1111", 1000), ("two", "2222", 1000)]
    rows = [(r.place, r.card[-4:], str(r.date), r.description, r.amount, r.direction, r.number, r.total, r.city) for r in out.rows.filter("file = 'm'").orderBy("place").collect()]
    assert rows == [
        (9, "5678", "2025-12-21", "LOJA A", 1000, "DEBIT", 1, 3, "RECIFE"), (10, "5678", "2026-01-05", "LOJA B", 200, "CREDIT", None, None, "OLINDA"), (18, "9999", "2026-01-04", "IOF", 100, "DEBIT", None, None, ""), (20, "9999", "2026-01-06", "LOJA C", 2200, "DEBIT", None, None, ""),
    ]
    assert out.statements.filter("file = 'm'").first().previous_payment == 500


def test_sums_and_identities(parsed):
    s = {r.file: r for r in parsed["statements"]}
    one = s["one"]
    assert (one.layout, one.due_date, one.total, one.previous_balance, one.credits, one.debits, one.difference, one.previous_payment, one.payment_method, one.best_day) == ("INTERNET_BANKING", D(2026, 6, 12), 82767, 19168, 20168, 83767, 0, 19168, "Débito em conta", 30)
    assert one.errors == []
    assert one.statement.startswith("statement-") and one.financial_identity.startswith("invoice-")
    assert {s[f].layout for f in ("none", "null", "empty")} == {"UNKNOWN"} and s["none"].statement.startswith("statement-unsupported-") and s["none"].errors == ["LAYOUT"]


def test_cards_and_dates_stay_apart(parsed):
    got = [(r.card[-4:], r.date, r.description, r.amount, r.direction) for r in sorted((r for r in parsed["rows"] if r.file == "two"), key=lambda r: r.place)]
    assert got == [
        ("1111", D(2025, 12, 19), "UM", 1000, "DEBIT"), ("2222", D(2025, 12, 23), "DOIS", 1000, "DEBIT"), ("2222", D(2026, 1, 1), "TRES", 400, "DEBIT"), ("2222", D(2026, 1, 1), "QUATRO", 600, "CREDIT"),
    ]
    assert sorted((r.card[-4:], r.amount) for r in parsed["subtotals"] if r.file == "two") == [("1111", 1000), ("2222", 1000)]
    assert "CARD_SUBTOTAL" in next(r for r in parsed["statements"] if r.file == "two").errors


def test_placed_pieces(spark):
    heads = [(10.0, "Data"), (50.0, "Histórico"), (55.0, "de"), (60.0, "Lançamentos"), (200.0, "Cidade"), (300.0, "US$"), (350.0, "R$")]
    items = [("f", 1, 1000.0, x, 500.0, t) for x, t in heads] + [("f", 1, 1000.0, 12.0, 480.0, "01/02"), ("f", 1, 1000.0, 48.0, 481.5, "LOJA"), ("f", 1, 1000.0, 349.0, 479.0, "1,00"), ("f", 1, 1000.0, 700.0, 480.0, "fora"), ("f", 1, 1000.0, 1.0, 600.0, "Titulo"), ("f", 1, 1000.0, 1.0, 590.0, " ")]
    lines = [r.text for r in invoices.positioned_lines(spark.createDataFrame(items, "file string, page int, width double, x double, y double, text string")).orderBy("line").collect()]
    assert lines == ["Titulo", "Data | Histórico de Lançamentos | Cidade | US$ | R$", "01/02 | LOJA |  |  | 1,00"]


PURCHASES = "id string, statement string, card string, date string, due_date string, description string, amount long, type string, direction string, number int, total int"
COSTS = "id string, date string, description string, amount long, direction string, type string, payment_method string, number int, total int"


def tables(spark, bought, rows):
    p = spark.createDataFrame([(i, s, "1", "2026-01-01", "2026-02-10", d, a, "PURCHASE", "DEBIT", None, None) for i, s, d, a in bought], PURCHASES).withColumn("date", F.to_date("date")).withColumn("due_date", F.to_date("due_date"))
    c = spark.createDataFrame([(i, day, d, a, "DEBIT", "EXPENSE", "Crédito_Bradesco", None, None) for i, day, d, a in rows], COSTS).withColumn("date", F.to_date("date"))
    return p, c


def test_groups_confirmations_and_refusals(spark):
    p, c = tables(spark, [("a", "s", "padaria sul", 5), ("b", "s", "padaria norte", 5), ("c", "s", "outra", 9), ("d", "s", "outra", 9), ("e", "t", "posto", 7)], [("r1", "2026-02-10", "x", 5), ("r2", "2026-02-10", "y", 5), ("r3", "2026-02-10", "z", 9), ("r4", "2026-01-03", "posto", 7)])
    states = lambda **t: {r.purchase_id: (r.status, r.sheet_id, r.sheet_ids) for r in cards.purchase_states(p, c, **t).collect()}
    assert states() == {"a": ("CARD_GROUP_MATCHED", None, ["r1", "r2"]), "b": ("CARD_GROUP_MATCHED", None, ["r1", "r2"]), "c": ("CARD_REVIEW", None, None), "d": ("CARD_REVIEW", None, None), "e": ("CARD_MATCHED", "r4", None)}
    pair = lambda *rows: spark.createDataFrame(list(rows), "purchase_id string, sheet_id string")
    got = states(confirmed=pair(("d", "r3")), rejected=pair(("e", "r4")), reserved=pair(("b", "r1")))
    assert got["d"] == ("CARD_MATCHED", "r3", None) and got["c"] == ("CARD_MISSING", None, None) and got["e"][0] == "CARD_MISSING" and got["a"][0] == got["b"][0] == "CARD_REVIEW"


def test_pairs_of_a_statement_and_amount_are_dealt_out_once(spark):
    p, c = tables(spark, [("a", "s", "padaria sul", 5), ("b", "s", "padaria norte", 5), ("c", "s", "posto", 5), ("d", None, "outra", 9)], [("r1", "2026-02-10", "x", 5), ("r2", "2026-02-10", "y", 5), ("r3", "2026-01-01", "y", 5), ("r4", "2026-02-10", "z", 9)])
    pairs = cards.plausible_rows(p, c)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    found = cards.candidates(p, c, pairs)
    assert exchanges(found) == 1 and exchanges(cards.statement_candidates(p, c, pairs=pairs)[0]) <= 3
    assert {(r.purchase_id, r.sheet_id) for r in found.collect()} == {(x, r) for x in "abc" for r in ("r1", "r2")} | {("d", "r4")}
    # "c" is like neither of the others and wants their rows too, so they are no group.
    assert {r.purchase_id: r.status for r in cards.purchase_states(p, c, pairs=pairs).collect() if r.statement} == dict.fromkeys("abc", "CARD_REVIEW")


def test_rows_go_to_earlier_invoices(spark):
    states = spark.createDataFrame([("a", "late", "CARD_MATCHED", "r1", None, 1), ("b", "early", "CARD_MATCHED", "r1", None, 1), ("c", "late", "CARD_GROUP_MATCHED", None, ["r2", "r3"], 2), ("d", "last", "CARD_MATCHED", "r3", None, 1), ("e", "last", "CARD_MISSING", None, None, 0), ("f", "last", "CARD_MATCHED", "r1", None, 1)], "purchase_id string, statement string, status string, sheet_id string, sheet_ids array<string>, candidates long")
    due = spark.createDataFrame([("early", "2026-01-01"), ("late", "2026-02-01"), ("last", "2026-03-01")], "statement string, due_date string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "purchase_id string")
    got = {r.purchase_id: r.status for r in cards.consume(states, due, ids("e"), ids("f")).collect()}
    assert got == {"a": "CARD_REVIEW", "b": "CARD_MATCHED", "c": "CARD_GROUP_MATCHED", "d": "CARD_REVIEW", "e": "CARD_IGNORED", "f": "CARD_MATCHED"}


def test_previous_cycle_by_month_and_day(spark):
    days = [("2025-12-30", "2026-02-01"), ("2026-01-30", "2026-02-01"), ("2026-01-03", "2026-02-01"), ("2026-01-31", "2026-02-28")]
    df = spark.createDataFrame(days, "a string, b string").select(cards._previous_cycle(F.to_date("a"), F.to_date("b")).alias("x"))
    assert [r.x for r in df.collect()] == [False, False, True, True]


def test_balances(spark):
    rows = [("s", 1, "2026-01-01", 0, 10, None), ("s", 2, "2026-01-02", 5, 0, 105), ("s", 3, "2026-01-03", 0, 1, 104), ("t", 1, "2026-01-01", 1, 0, None)]
    schema = "statement string, source_row int, date string, credit long, debit long, balance_after long"
    left = spark.createDataFrame([("s", 0, "2026-01-01", 0, 0, 110)], schema)
    got = {r.statement: (r.initial, r.reported, r.calculated, r.difference, r.balanced) for r in records.balance_summary(spark.createDataFrame(rows, schema), left).collect()}
    assert got == {"s": (110, 104, 104, 0, True), "t": (None, None, None, None, None)}


def test_decisions_are_told_beside_pairs_that_are_shuffled_once(spark):
    bought = cards.cut(catalog_invoices._group_purchases(spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in catalog_invoices._group_costs(spark, "/root/testdata/sf0.001", bought)._jdf.queryExecution().executedPlan().toString()
    p, c = tables(spark, [("a", "s", "x", 5), ("b", "s", "x", 5), ("c", None, "x", 5), ("d", "s", "x", 9)], [("r1", "2026-02-10", "x", 5), ("r2", "2026-02-10", "x", 5)])
    made = lambda *rows: spark.createDataFrame(list(rows), "purchase_id string, sheet_id string, decision string")
    args = made(("d", "", "")).select("purchase_id"), made(("a", "r2", "k")), made(("b", "r1", "z"), ("b", "r1", "y"), ("c", "r1", "w"), ("d", "r1", "v")), made(("a", "r1", "o2"), ("a", "r1", "o1"), ("b", "r1", "o3"))
    pure, after, refused, owned = cards.pure_and_decided(p, c, *args)
    assert {r.purchase_id: r.status for r in pure.collect()} == {"a": "CARD_GROUP_MATCHED", "b": "CARD_GROUP_MATCHED", "c": "CARD_REVIEW", "d": "CARD_MISSING"}
    assert {r.purchase_id: (r.status, r.held) for r in after.collect()} == {"a": ("CARD_MATCHED", "r2"), "b": ("CARD_MISSING", None), "c": ("CARD_MATCHED", None), "d": ("CARD_REFUNDED", None)}
    assert {tuple(r) for r in refused.select("purchase_id", "decision").collect()} == {("b", "y"), ("c", "w")}
    assert {tuple(r) for r in owned.select("purchase_id", "owner", "target", "decision").collect()} == {("a", "b", "r1", "o3"), ("b", "a", "r1", "o1"), ("c", "a", "r1", "o1")}


def _odd_tables(spark):
    rng = random.Random(5)
    some = lambda *values: rng.choice(values)
    day = lambda text: datetime.date.fromisoformat(text) if text else None
    bought = [(some(None, *(f"p{k}" for k in range(30))), some("s", "s", "t", None), "1", day(some("2026-01-01", "2026-02-08", None)), day(some("2026-02-10", "2026-02-10", None)), some("loja", "padaria", "padaria sul", None), some(5, 5, 6, 7, 8, 9, None), some("PURCHASE", "PURCHASE", "PURCHASE", "REFUND"), "DEBIT", n := some(None, None, 2), n and 3) for _ in range(60)]
    rows = [(some(None, *(f"r{k}" for k in range(25))), day(some("2026-02-10", "2026-02-07", "2026-01-01")), some("loja", "(2/3) padaria", "x", None), some(5, 6, 7, 8, 9), "DEBIT", "EXPENSE", "Crédito_Bradesco", n := some(None, None, 2), n and 3) for _ in range(40)]
    p = spark.createDataFrame(bought, PURCHASES.replace("date string", "date date").replace("due_date string", "due_date date"))
    c = spark.createDataFrame(rows, COSTS.replace("date string", "date date"))
    made = lambda n: spark.createDataFrame([(some(None, *(f"p{k}" for k in range(31))), some(None, *(f"r{k}" for k in range(25))), f"k{k}") for k in range(n)], "purchase_id string, sheet_id string, decision string")
    return p, c, made(4).select("purchase_id"), made(30), made(20), made(8)


def test_states_of_odd_rows_told_together_equal_those_told_apart(spark):
    p, c, *made = _odd_tables(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    pure, after, refused, owned = cards.pure_and_decided(p, c, *made)
    assert rows(pure) == rows(cards.purchase_states(p, c)) and len({r.status for r in pure.collect()}) > 2
    assert rows(after) == rows(cards.states_and_holds(p, c, *made)) and after.filter("held is not null").count() and after.filter("status = 'CARD_REFUNDED'").count()
    assert refused.count() and owned.count()


def test_purchases_stay_out_of_the_sorts_of_their_pairs(spark, monkeypatch):
    wide, keep = [], cards.cut

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    def kept(df):
        for top in (n for n in nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Aggregate" and "plain_only" in n.output().mkString(",")):
            wide.extend(n.output().mkString(",") for n in nodes(top.children().apply(0)) if n.nodeName() == "Window")
        return keep(df)

    monkeypatch.setattr(cards, "cut", kept)
    p, c, *made = _odd_tables(spark)
    cards.pure_and_decided(p, c, *made)
    assert any("plain_users" in said for said in wide)
    assert not [said for said in wide if any(name in said for name in ("text#", "due_date#", "similarity#", "second#"))]
