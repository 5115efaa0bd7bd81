import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import counterparty, text
from ledgerloom.functions.identity import card_identities, composition_key, decision_key, fingerprint
from ledgerloom.sources import delimited

MOBILE = """﻿Extrato de conta
Data;Histórico;Docto.;Crédito (R$);Débito (R$);Saldo (R$)
05/01/2026;Pix enviado;11;;10,00;90,00
06/01/2026;"Compra; loja ""A"" 2/3";12;;5,00;-85,00
Data;Histórico;Docto.;Crédito (R$);Débito (R$);Saldo (R$)
07/01/2026;Saldo;13;;;85,00
Total;;;0,00;15,00;
Filtro de resultados;Movimentação entre: 01/01/2026 e 10/01/2026;;;;
Últimos Lançamentos;;;;;
05/01/2026;PIX ENVIADO;11;;10,00;
08/01/2026;Pix recebido Des: Maria 08/01;14;7,00;;
08/01/2026;Pix recebido Des: Maria 08/01;14;7,00;;
20/01/2026;Pix enviado;15;;1,00;
"""
INTERNET = """Data;Histórico;Docto.;Crédito (R$);Débito (R$);Saldo (R$);
05/01/26;Pix enviado;7;;-10,00;90,00;
;Joana Silva 05/01;;;;;
;Rem: Casa;;;;;
06/01/26;Pix qr code;7;;-2,00;88,00;
;Total;;;;;
"""
SIGNED = "Date|Description|Amount|Tipo\n2026-01-02|Loja X|-12.50|\n2026-01-03|Loja X|3,00|Entrada\n2026-01-04||1,00|\n2026-01-05|Loja Y|abc|\n||||\n"


def brute_fingerprint(*parts):
    value = "\u001f".join("" if p is None else str(p).strip() for p in parts).encode("utf-16-le")
    a, b = 0x811C9DC5, 0x9E3779B9
    for i in range(len(value) // 2):
        c = int.from_bytes(value[2 * i : 2 * i + 2], "little")
        a, b = (a ^ c) * 0x01000193 % 2**32, (b ^ (c + i)) * 0x85EBCA6B % 2**32
    return f"{a:08x}{b:08x}"


def test_fingerprint_against_brute_force(spark):
    values = [("", None), ("ação", " x "), ("a" * 300, "é😀z"), ("2026-01-01", "12"), ("x\u001fy", "0")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i int, a string, b string")
    got = [r[0] for r in df.select("i", fingerprint(F.col("a"), F.col("b")).alias("f")).orderBy("i").select("f").collect()]
    assert got == [brute_fingerprint(a, b) for a, b in values]


def test_fingerprint_of_odd_texts_makes_one_list_of_units(spark):
    rng = random.Random(3)
    values = [(k, "".join(rng.choice("ab \u00e9\u20ac\U0001f600\U0010ffff\uffff\x00\t") for _ in range(k % 40)), rng.choice((None, "", " ", "\U0001f600"))) for k in range(120)]
    made = spark.createDataFrame(values, "i int, a string, b string").select("i", "a", "b", fingerprint(F.col("a"), F.col("b")).alias("f"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # Characters are neither filtered one by one nor wrapped with their place.
    assert "filter(" not in plan.lower() and "named_struct" not in plan
    plain = lambda x: x.strip(" \t") if x else x
    assert all(r.f == brute_fingerprint(plain(r.a), plain(r.b)) for r in made.collect())



def test_identities(spark):
    row = spark.range(1).select(
        card_identities(F.array(F.lit("s"), F.lit(None), F.lit("s")), F.array(F.lit("2026-01-01"), F.lit(None)), F.lit("9"), F.lit("shop")).alias("cards"),
        decision_key(F.lit("K"), F.array(F.lit("a"), F.lit('b"'))).alias("key"), composition_key(F.array(F.lit("b"), F.lit("a"))).alias("set"),
    ).first()
    assert row.cards == [f"s:{brute_fingerprint('9', '2026-01-01', 'shop')}", f"s:{brute_fingerprint('2026-01-01', 'shop')}"]
    assert (row.key, row.set) == ('K:["a","b\\""]', "a|b")


def parse(spark, **files):
    df = spark.createDataFrame(list(files.items()), "file string, content string")
    return delimited.bank_rows(delimited.companions(delimited.sections(delimited.rows(df)))).orderBy("file", "row_idx").collect()


def test_mobile_statement(spark):
    got = parse(spark, a=MOBILE)
    assert [(r.line, r.section, r.row_class) for r in got] == [
        (3, "MAIN", "TRANSACTION"), (4, "MAIN", "TRANSACTION"), (5, "MAIN", "REPEATED_HEADER"), (6, "MAIN", "NO_MOVEMENT"), (7, "MAIN", "FOOTER_OR_METADATA"),
        (10, "AUXILIARY", "DUPLICATE_AUXILIARY"), (11, "AUXILIARY", "TRANSACTION"), (12, "AUXILIARY", "DUPLICATE_AUXILIARY"), (13, "AUXILIARY", "OUTSIDE_STATEMENT_PERIOD"),
    ]
    first, second, new = got[0], got[1], got[6]
    assert (first.amount, first.direction, first.balance_after, first.bank_transaction_id, first.format, first.direction_known) == (1000, "DEBIT", 9000, "doc:11", "CSV_MOBILE", True)
    assert (second.original_description, second.balance_after, second.installment.number, second.installment.total) == ('Compra; loja "A" 2/3', 8500, 2, 3)
    assert (new.direction, new.type, new.counterparty_name, new.date) == ("CREDIT", "INCOME", "Maria", date(2026, 1, 8))


def test_internet_statement_folds_companions(spark):
    got = [r for r in parse(spark, a=INTERNET) if r.row_class == "TRANSACTION"]
    assert [(r.amount, r.counterparty_name, r.source_description) for r in got] == [(1000, "Casa", "Pix enviado Des: Joana Silva 05/01 Rem: Casa"), (200, None, "Pix qr code")]
    assert all(r.bank_transaction_id.startswith("auto:") and r.bank_transaction_id.endswith(":1") for r in got)


def test_signed_column_and_issues(spark):
    got = parse(spark, a=SIGNED, b="nothing here\nat all", c="", d=None)
    assert [(r.row_class, r.amount, r.direction) for r in got] == [("TRANSACTION", 1250, "DEBIT"), ("TRANSACTION", 300, "CREDIT"), ("ISSUE:DATE_OR_TEXT", 100, "DEBIT"), ("ISSUE:AMOUNT", None, "DEBIT")]


def test_ledger_ids(spark):
    sheet = "ID,Data,Descrição,Custo,Forma de pagamento,É fixo?\nx,01/01/2026,Loja,\"R$ 1.234,56\",Pix,Sim\nx,01/01/2026,Loja,\"R$ 1.234,56\",Crédito_Bradesco,\ny,02/01/2026,Aplicação,5,Investimento,não\nz,bad,Loja,1,,\n"
    df = spark.createDataFrame([("f", sheet)], "file string, content string")
    got = delimited.ledger_rows(delimited.rows(df)).orderBy("row_idx").collect()
    mark = brute_fingerprint("2026-01-01", "Loja", 123456, None, None)
    assert [r.sheet_record_id for r in got] == [f"auto:{mark}:1", f"auto:{mark}:2", "y", None]
    assert [(r.type, r.is_fixed, r.row_class) for r in got] == [("EXPENSE", True, "TRANSACTION"), ("EXPENSE", None, "TRANSACTION"), ("INVESTMENT", False, "TRANSACTION"), ("EXPENSE", None, "ISSUE")]


def test_files_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(MOBILE.encode())
    (tmp_path / "b.csv").write_bytes("Data;Histórico;Valor\n01/01/2026;Pão “bom”;1,00\n".encode("cp1252"))
    (tmp_path / "c.bin").write_bytes(b"Data;Historico;Valor\n")
    lines = delimited.rows(delimited.read_files(spark, str(tmp_path)))
    assert {r.description for r in lines.filter(F.col("file").endswith("b.csv")).collect()} == {"Pão “bom”"}
    assert lines.select("file").distinct().count() == 2


@pytest.mark.parametrize("value,want", [("Des: Ana  Lima 01/02", "Ana Lima"), ("compra visa Padaria -", "Padaria"), ("compra visa", "visa"), ("compra visa pix enviado", None), ("pagamento pix enviado", None), ("", None), (None, None)])
def test_counterparty(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(counterparty.from_description(F.col("v"))).first()[0] == want


def test_preferred_name_and_label(spark):
    kind = "e array<struct<name:string,source:string>>"
    df = spark.createDataFrame([([("ANA", "CSV_MOBILE"), ("Aná", "OFX_NAME")],), ([("Ana", "CSV_MOBILE"), ("Bia", "OFX_NAME")],), ([],), (None,)], kind)
    assert [r[0] for r in df.select(counterparty.preferred(F.col("e"))).collect()] == ["Aná", None, None, None]
    said = spark.createDataFrame([("Pix enviado", "DEBIT"), ("Compra visa", "DEBIT"), ("x", "DEBIT"), ("x", "CREDIT")], "t string, d string")
    assert [r[0] for r in said.select(counterparty.label(F.col("t"), F.col("d"), F.lit("EXPENSE"))).collect()] == ["Para", "Estabelecimento", "Contraparte", "De"]


def test_more_text_functions(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(counterparty.label(F.lit("pix qrcode avulso"), F.lit("DEBIT"), F.lit("EXPENSE"))) == "Contraparte" and one(counterparty.label(F.lit("pix qrcode din loja"), F.lit("DEBIT"), F.lit("EXPENSE"))) == "Para"
    assert one(counterparty.without_name(F.lit("Pix enviado Des: Ana 01/02"), F.lit("Ana"))) == "Pix enviado" and one(counterparty.without_name(F.lit("Compra Padaria Sul"), F.lit("padaria sul"))) == "Compra" and one(counterparty.without_name(F.lit(" Ana "), F.lit("Ana"))) == "Ana"
    assert one(counterparty.displayable(F.lit("Ana"), F.lit("Ana"))) is None and one(counterparty.displayable(F.lit("Compra Ana"), F.lit("Ana"))) == "Ana" and one(counterparty.displayable(F.lit("x"), F.lit(" "))) is None
    assert one(text.friendly_label(F.lit("PIX QRCODE EST loja"))).asDict() == {"label": "Pix QR Code Estático", "payment": "Pix"}
    assert one(text.ledger_type(F.lit("Pix para minha conta"), F.lit("Crédito_Bradesco"))) == "TRANSFER"
    assert [one(text.invoice_amount(F.lit(v))) for v in ("1.234,56-", "- 7,00", "8,10", "x")] == [-123456, -700, 810, None]
    assert [one(text.is_timestamp(F.lit(v))) for v in ("2026-01-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-01-01", "2026-01-01T00:00:00+03:00")] == [True, False, False, True]
    assert one(text.installment_similarity(F.lit("mercado livre"), F.lit("merc livre sul"))) == pytest.approx(0.92)
    assert one(text.installment_similarity(F.lit("a"), F.lit(None).cast("string"))) == 0.0


def test_companions_are_gathered_in_one_reading(spark):
    """The lines are parsed and shuffled once: a movement's companions come by a window, not by a join with a second reading."""
    content = "Extrato;;;;;\nData;Histórico;Docto.;Crédito (R$);Débito (R$);Saldo (R$);\n05/01/2026;Pix enviado;1;;10,00;90,00;\n;Des: Ana Lima;;;;;\n;Rem: Rui;;;;;\n06/01/2026;Compra;2;;5,00;85,00;\n"
    out = delimited.companions(delimited.sections(delimited.rows(spark.createDataFrame([("f", content)], "file string, content string"))))
    assert [(r.description, r.added) for r in out.orderBy("row_idx").collect()] == [("Pix enviado", "Des: Ana Lima Rem: Rui"), ("Compra", None)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
