"""Exports as semicolon-separated text with a byte order mark: every cell quoted, quotes doubled, CRLF line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mark at the start of a file, and the metrics of the summary that count items by status.
MARK = "﻿"
STATUS_METRICS = {"Conciliadas": "MATCHED", "Para revisão": "REVIEW", "Possíveis ausências": "MISSING", "Divergências de cartão": "CARD_DIVERGENCE", "Fora do escopo": "OUT_OF_SCOPE", "Ignoradas": "IGNORED"}


def csv_line(cells: list[Column]) -> Column:
    """One line of text of quoted cells; null is an empty cell."""
    return F.concat_ws(";", *(F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells))


def write_csv(rows: DataFrame, path: str) -> None:
    """Write all columns as text files, one per partition, each with the mark and a header line."""
    header = MARK + ";".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    lines = rows.select(csv_line([F.col(f"`{c}`") for c in rows.columns]).alias("value"))

    def with_header(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [header]})
        yield from batches

    lines.mapInPandas(with_header, "value string").write.option("lineSep", "\r\n").text(path)


def money(cents: Column) -> Column:
    """Cents as R$ 1234,56, without marks between thousands."""
    whole = F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(F.abs(cents) / 100).cast("string"), F.lit(","), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return F.concat(F.lit("R$ "), whole)


def _bank(items: DataFrame, bank: DataFrame) -> DataFrame:
    """items with their bank row as b. bank: id, date, original_description, amount, direction, type, payment_method, bank_transaction_id."""
    return items.join(bank.select(F.col("id").alias("bank_id"), F.struct("date", "original_description", "amount", "direction", "type", "payment_method", "bank_transaction_id").alias("b")), "bank_id")


def _sheet(items: DataFrame, ledger: DataFrame) -> DataFrame:
    return items.join(ledger.select(F.col("id").alias("sheet_id"), F.struct("date", "original_description", "amount", "payment_method").alias("s")), "sheet_id", "left")


def missing_export(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank rows that no ledger row answers."""
    rows = _bank(items.filter("status = 'MISSING'"), bank)
    return rows.select(F.col("b.date").alias("Data"), F.col("b.original_description").alias("Descrição original"), money(F.col("b.amount")).alias("Valor"), F.col("b.direction").alias("Direção"), F.col("b.payment_method").alias("Forma de pagamento"), F.col("b.bank_transaction_id").alias("ID bancário"))


def review_export(items: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows to review with their candidate and its reasons in one cell. items: also sheet_id, score, reasons."""
    rows = _sheet(_bank(items.filter("status = 'REVIEW'"), bank), ledger)
    return rows.select(
        F.lit("REVIEW").alias("Estado"), F.col("b.date").alias("Data banco"), F.col("b.original_description").alias("Descrição banco"), money(F.col("b.amount")).alias("Valor"), F.col("s.date").alias("Data planilha"),
        F.col("s.original_description").alias("Descrição planilha"), F.col("score").alias("Pontuação"), F.array_join("reasons", " / ").alias("Motivos"),
    )


def out_of_scope_export(items: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    rows = _sheet(_bank(items.filter("status = 'OUT_OF_SCOPE'"), bank), ledger)
    side = F.when(F.col("b.direction") == "DEBIT", "Saída").otherwise("Entrada")
    return rows.select(F.col("b.date").alias("Data"), F.col("b.original_description").alias("Descrição"), side.alias("Direção"), F.col("b.type").alias("Tipo"), money(F.col("b.amount")).alias("Valor"), F.coalesce("s.original_description", F.lit("")).alias("Correspondência planilha"))


def card_payments_export(items: DataFrame, bank: DataFrame, ledger: DataFrame, options: DataFrame) -> DataFrame:
    """One row per item of a bill's confirmed composition, or one without item, with what its search found. items: also composition, composition_status; options: bill_id, candidates, candidate_total."""
    found = options.groupBy(F.col("bill_id").alias("bank_id")).agg(F.max("candidates").alias("n"), F.max("candidate_total").alias("sum"))
    rows = _bank(items, bank).filter("b.type = 'CARD_PAYMENT'").join(found, "bank_id", "left").withColumn("sheet_id", F.explode_outer("composition"))
    rows = _sheet(rows, ledger)
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    difference = F.when(F.col("n").isNotNull(), F.col("b.amount") - F.col("sum")).otherwise(0)
    return rows.select(
        F.col("b.date").alias("Data pagamento"), F.col("b.original_description").alias("Descrição banco"), money(F.col("b.amount")).alias("Total fatura"), F.coalesce("composition_status", F.lit("NO_MATCH")).alias("Estado"), part(F.col("s.date")).alias("Data compra"),
        part(F.col("s.original_description")).alias("Descrição compra"), F.coalesce(money(F.col("s.amount")), F.lit("")).alias("Valor compra"), part(F.col("s.payment_method")).alias("Forma de pagamento"), F.coalesce("n", F.lit(0)).alias("Compras elegíveis encontradas"),
        money(F.coalesce("sum", F.lit(0))).alias("Total compras elegíveis"), money(difference).alias("Diferença pagamento menos compras"),
    )


def duplicates_export(members: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per member of a duplicate group, with the group's date and amount where the ledger no longer holds it. members: id, date, amount."""
    rows = members.join(ledger.select("id", F.struct("date", "original_description", "amount").alias("s")), "id", "left")
    return rows.select(F.lit("SHEET").alias("Origem"), F.coalesce("s.date", "date").alias("Data"), F.col("s.original_description").alias("Descrição original"), money(F.coalesce("s.amount", "amount")).alias("Valor"), F.col("id").alias("Identificador interno"))


def summary_export(items: DataFrame, bank: DataFrame, ledger: DataFrame, unmatched: DataFrame, duplicates: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    """The sixteen metrics of a reconciliation as (Métrica, Valor). duplicates: anchor_id of each member; balance: one row as balance_summary() gives, where the rows come from one statement."""
    count = lambda df, *c: df.agg(*c)
    by_status = count(items, *(F.count_if(F.col("status") == s).cast("string").alias(name) for name, s in STATUS_METRICS.items()))
    totals = count(bank, F.count_if(F.col("type") == "CARD_PAYMENT").cast("string").alias("Pagamentos de cartão"), *(money(F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0))).alias(name) for d, name in (("DEBIT", "Total de débitos"), ("CREDIT", "Total de créditos"))))
    others = [count(ledger, money(F.coalesce(F.sum("amount"), F.lit(0))).alias("Total planilha")), count(unmatched, F.count("*").cast("string").alias("Não encontrados no extrato")), count(duplicates, F.count_distinct("anchor_id").cast("string").alias("Possíveis duplicidades"))]
    names = {"initial": "Saldo inicial", "reported": "Saldo final", "calculated": "Saldo calculado", "difference": "Diferença de saldo"}
    if balance is not None:
        others.append(count(balance, *(F.coalesce(F.max(money(F.col(c))), F.lit("")).alias(name) for c, name in names.items())))
    else:
        others.append(items.sparkSession.range(1).select(*(F.lit("").alias(name) for name in names.values())))
    long = lambda df: df.unpivot([], df.columns, "Métrica", "Valor")
    out = long(by_status)
    for df in (totals, *others):
        out = out.unionByName(long(df))
    return out


def summary_long(rows: DataFrame, metrics: dict) -> DataFrame:
    """One row (metric, value) per named aggregate, in one pass over the rows."""
    wide = rows.agg(*(m.cast("long").alias(name) for name, m in metrics.items()))
    return wide.unpivot([], list(metrics), "metric", "value")


def findings_export(findings: DataFrame, longest: int = 500) -> DataFrame:
    """Findings but related ones as text cells of at most `longest` characters, a limit of the spreadsheet cell. Of category, invariant, role, root_cause, confidence, current, expected and diagnosis those that findings have."""
    kept = findings.filter("role <> 'RELATED'") if "role" in findings.columns else findings
    more = [c for c in ("category", "invariant", "role", "root_cause", "confidence", "current", "expected", "diagnosis") if c in findings.columns]
    return kept.select("code", "severity", F.substring("subject", 1, longest).alias("subject"), F.substring(F.array_join("related", " / "), 1, longest).alias("related"), *(F.substring(F.col(c).cast("string"), 1, longest).alias(c) for c in more))


def diagnostic_json(findings: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """(kind, id, json): findings, and every bank and ledger row that any of them names, once; findings hold references only. The raw columns `original` and `raw` are left out."""
    plain = lambda df: df.drop("original", "raw")
    named = findings.select(F.explode(F.concat(F.array("subject"), F.coalesce("related", F.array().cast("array<string>")))).alias("id")).distinct()
    entities = [plain(df).join(named, "id", "left_semi").select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*plain(df).columns)).alias("json")) for kind, df in (("bank", bank), ("ledger", ledger))]
    return plain(findings).select(F.lit("finding").alias("kind"), F.concat_ws(":", "code", "subject").alias("id"), F.to_json(F.struct(*plain(findings).columns)).alias("json")).unionByName(entities[0]).unionByName(entities[1])
