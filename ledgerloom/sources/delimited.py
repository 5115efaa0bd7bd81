"""Bank statements and ledgers as delimited text of unknown delimiter, header place and encoding.

A file is a statement of one account, so its text is one value; all its rows are classified by columns and windows within the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import counterparty, text
from ..functions.identity import fingerprint

DELIMITERS = [",", ";", "\t", "|"]
# Header names of each logical column, without accents and punctuation.
HEADERS = {
    "date": ["data", "data da compra", "data lancamento", "data transacao", "dt lancamento", "date"],
    "description": ["descricao", "historico", "estabelecimento", "lancamento", "description", "merchant", "favorecido"],
    "amount": ["custo", "valor", "valor da transacao", "valor lancamento", "amount", "valor r"],
    "debit": ["debito", "debitos", "debito r", "saida", "saidas"],
    "credit": ["credito", "creditos", "credito r", "entrada", "entradas"],
    "direction": ["tipo", "natureza", "operacao", "debito credito"],
    "id": ["id", "identificador", "id transacao", "codigo transacao", "transaction id", "nsu", "docto", "documento"],
    "balance": ["saldo", "saldo apos lancamento", "saldo final", "saldo r", "balance"],
    "payment_method": ["forma de pagamento", "meio de pagamento", "pagamento", "payment method"],
    "category": ["categoria"], "month": ["mes"], "year": ["ano"], "is_fixed": ["e fixo", "fixo"], "is_essential": ["e essencial", "essencial"],
}
#: Lines of a file in which its header is looked for.
SNIFFED = 80
# Bytes 0x80 to 0x9F where windows-1252 differs from ISO-8859-1; the former isn't offered by decode().
_C1 = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]


def plain(value: Column) -> Column:
    """Lower case without accents and punctuation."""
    return F.trim(F.regexp_replace(F.lower(F.translate(value, text.ACCENTED, text.PLAIN)), "[^a-z0-9]+", " "))


def decoded(content: Column) -> Column:
    """Text of bytes in UTF-8, else in windows-1252; without byte order mark."""
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, _C1)), bytes(_C1).decode("cp1252"))
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), western), "^﻿", "")


def cells(line: Column, delimiter: str) -> Column:
    """Trimmed cells of a line; quoted cells may hold delimiters and doubled quotes."""
    d = "\\" + delimiter if delimiter in "|" else delimiter
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}(\s*"(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(F.trim(c).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))


def _any_cells(line: Column, delimiter: Column) -> Column:
    out = cells(line, DELIMITERS[0])
    for d in DELIMITERS[1:]:
        out = F.when(delimiter == d, cells(line, d)).otherwise(out)
    return out


def _first_of(names: Column, wanted: list[str]) -> Column:
    """Place of the first wanted name, 0 if there is none."""
    return F.array_position(F.transform(names, lambda h: h.isin(wanted)), True).cast("int")


def header_score(names: Column) -> Column:
    """8 and more for a line that names a date, a text and a value; else 0."""
    has = {k: F.arrays_overlap(names, F.array(*map(F.lit, v))) for k, v in HEADERS.items()}
    points = sum((F.when(has[k], n).otherwise(0) for k, n in (("amount", 2), ("debit", 2), ("credit", 2), ("balance", 1), ("id", 1))), F.lit(8))
    return F.when(has["date"] & has["description"] & (has["amount"] | has["debit"] | has["credit"]), points).otherwise(0)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files under a path that are delimited text."""
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.(csv|txt)$"))
    return files.select(F.col("path").alias("file"), decoded(F.col("content")).alias("content"))


def rows(files: DataFrame) -> DataFrame:
    """One row per line below the header that isn't blank: file, row_idx (from 0), line (in the file, from 1), delimiter, header_line, header, cells, and a column per logical name.

    files: file, content. Of the candidate headers the highest score wins, then the first line, then the delimiter's order; a file without one gives no rows.
    A line break inside quotes ends the row.
    """
    lines = files.select("file", F.split("content", r"\r\n|\n|\r").alias("lines"))
    scored = lambda d, k: F.transform(
        # A header holds the delimiter and names a date, so other lines are not cut up; the names are read once for all that is asked of them.
        F.slice("lines", 1, SNIFFED), lambda line, i: F.struct(F.when(line.contains(d) & plain(line).rlike("|".join(HEADERS["date"])), text.let(F.transform(cells(line, d), plain), header_score)).otherwise(0).alias("score"), (-i).alias("up"), F.lit(-k).alias("order"))
    )
    best = F.array_max(F.flatten(F.array(*(scored(d, k) for k, d in enumerate(DELIMITERS)))))
    # A filter, also the one of an inner explode, would be moved below what it filters, and that computed twice; an outer explode computes it once.
    once = lambda value: F.explode_outer(F.array(value))
    found = lines.select("*", once(best).alias("best")).filter("best.score >= 8")
    found = found.select("file", "lines", F.element_at(F.array(*map(F.lit, DELIMITERS)), 1 - F.col("best.order")).alias("delimiter"), (1 - F.col("best.up")).alias("header_line"))
    found = found.withColumn("header", _any_cells(F.element_at("lines", F.col("header_line")), F.col("delimiter")))
    found = found.withColumn("names", F.transform("header", plain))
    spots = [_first_of(F.col("names"), v).alias(f"at_{k}") for k, v in HEADERS.items()]
    below = found.select("*", *spots).select("*", F.posexplode("lines").alias("place", "value")).filter("place >= header_line").drop("lines", "names")
    used = F.exists(F.zip_with("cells", "header", lambda c, h: (F.coalesce(c, F.lit("")) != "") & (F.coalesce(h, F.lit("")) != "")), lambda x: x)
    below = below.select("*", once(_any_cells(F.col("value"), F.col("delimiter"))).alias("cells"))
    below = below.filter(used).withColumn("row_idx", F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1)
    value = lambda k: F.when(F.col(f"at_{k}") > 0, F.coalesce(F.get("cells", F.col(f"at_{k}") - 1), F.lit(""))).alias(k)
    return below.select("file", "row_idx", (F.col("place") + 1).alias("line"), "delimiter", "header_line", "header", "cells", *map(value, HEADERS))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sections(lines: DataFrame) -> DataFrame:
    """rows() with format, section (MAIN, AUXILIARY or null for rows of neither) and the period that a statement names.

    The first row that names a period or the latest movements ends the main section; the auxiliary one starts after the last row that names latest movements.
    """
    split = (F.col("date").isNotNull()) & F.col("description").isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull()) & F.col("balance").isNotNull()
    whole = Window.partitionBy("file")
    shape = r"(?i)movimentacao\s+entre\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})\s+e\s+(\d{1,2}/\d{1,2}/\d{4})"
    said = F.translate(F.array_join("cells", "\n"), text.ACCENTED, text.PLAIN)
    marked = lines.withColumn("split", split).withColumn("said", F.when(F.col("split"), said))
    period = F.when(F.col("said").rlike(shape), F.struct(text.normalize_date(F.regexp_extract("said", shape, 1)).alias("start"), text.normalize_date(F.regexp_extract("said", shape, 2)).alias("end")))
    latest = F.col("split") & F.exists("cells", lambda c: plain(c) == "ultimos lancamentos")
    bare = F.col("split") & (plain(_blank("date")) == "") & (_blank("description") != "") & (_blank("debit") == "") & (_blank("credit") == "")
    marked = marked.select("*", period.alias("named"), latest.alias("latest"), bare.alias("bare"))
    internet = F.exists("header", lambda h: h == "") & F.max("bare").over(whole)
    marked = marked.select(
        "*", F.max_by("named", F.when(F.col("named").isNotNull(), F.col("row_idx"))).over(whole).alias("period"), F.min(F.when(F.col("named").isNotNull() | F.col("latest"), F.col("row_idx"))).over(whole).alias("main_end"),
        F.max(F.when(F.col("latest"), F.col("row_idx"))).over(whole).alias("latest_at"), F.when(F.col("split"), F.when(internet, "CSV_INTERNET_BANKING").otherwise("CSV_MOBILE")).alias("format"),
    )
    section = F.when(F.col("row_idx") < F.coalesce("main_end", F.lit(1 << 30)), "MAIN").when(F.col("row_idx") > F.col("latest_at"), "AUXILIARY")
    return marked.withColumn("section", section).drop("said", "named", "latest", "bare", "split", "main_end", "latest_at")


def companions(lines: DataFrame) -> DataFrame:
    """sections() in which undated text rows below a movement are folded into it as counterparty and source_description (internet banking only)."""
    order = Window.partitionBy("file", "section").orderBy("row_idx")
    dated = text.normalize_date(_blank("date")).isNotNull()
    moves = dated & (_blank("description") != "") & sum((F.coalesce(text.normalize_amount(_blank(k)), F.lit(0)) != 0).cast("int") for k in ("debit", "credit", "amount")).cast("boolean")
    above = F.last(F.when(dated, F.when(moves, F.col("row_idx")).otherwise(-1)), ignorenulls=True).over(order)
    lone = F.size(F.filter("cells", lambda c: c != "")) == 1
    footer = plain(_blank("description")).rlike("^(total|data|historico|saldo|filtro|ultimos lancamentos)( |$)")
    companion = (F.col("format") == "CSV_INTERNET_BANKING") & F.col("section").isNotNull() & ~dated & (_blank("description") != "") & lone & ~footer & (above >= 0)
    marked = lines.select("*", above.alias("above"), F.coalesce(companion, F.lit(False)).alias("companion"))
    shown = F.when(F.col("description").rlike(r"(?i)^(des|rem|fav|orig)\s*:"), F.col("description")).otherwise(F.concat(F.lit("Des: "), F.col("description")))
    # A movement and its companions share what is above them, so a window gathers them where they are.
    parts = F.sort_array(F.collect_list(F.when(F.col("companion"), F.struct(F.col("row_idx").alias("at"), shown.alias("said")))).over(Window.partitionBy("file", "section", "above")))
    marked = marked.withColumn("parts", F.when(F.col("row_idx") == F.col("above"), parts)).filter("not companion")
    added = F.when(F.size("parts") > 0, F.array_join("parts.said", " "))
    return marked.withColumn("added", added).withColumn("companion_name", F.when(F.col("added").isNotNull(), counterparty.from_description(F.element_at("parts.said", -1)))).drop("above", "companion", "parts")


def bank_rows(lines: DataFrame, strict_balance_sign: bool = False) -> DataFrame:
    """Every row of companions() with its row_class: TRANSACTION, ISSUE, or the reason why it's excluded.

    Reasons: REPEATED_HEADER, EMPTY, OUTSIDE_STATEMENT_PERIOD, NO_MOVEMENT, FOOTER_OR_METADATA, DUPLICATE_AUXILIARY. Issues: DATE_OR_TEXT, BOTH_SIDES, AMOUNT. Rows of no section,
    and auxiliary rows of statements without a period, are left out. A balance with a leading minus comes out positive, as statements have
    been imported so far; strict_balance_sign keeps its sign.
    """
    said = {k: F.trim(_blank(k)) for k in ("date", "description", "debit", "credit", "amount", "id", "balance", "direction", "payment_method")}
    day, debit, credit, general = text.normalize_date(said["date"]), *(text.normalize_amount(said[k]) for k in ("debit", "credit", "amount"))
    header = F.lit(True)
    for k in ("date", "description", "id", "credit", "debit", "balance"):
        header = header & ((said[k] == "") | plain(said[k]).isin(HEADERS[k]))
    balance = text.normalize_amount(said["balance"])
    balance = balance if strict_balance_sign else F.when(said["balance"].rlike(r"^[-(]"), -balance).otherwise(balance)
    base = lines.filter("section = 'MAIN' or section = 'AUXILIARY' and period is not null").select(
        "file", "row_idx", "line", "section", "format", "period", "companion_name", "added", day.alias("day"), said["description"].alias("said"), debit.alias("debit_cents"), credit.alias("credit_cents"), general.alias("general"),
        (said["debit"] != "").alias("has_debit"), (said["credit"] != "").alias("has_credit"), (said["amount"] != "").alias("has_amount"), (F.col("debit").isNotNull() | F.col("credit").isNotNull()).alias("split"),
        header.alias("repeated"), said["id"].alias("document"), balance.alias("balance_after"), plain(said["direction"]).alias("way"), said["payment_method"].alias("payment_method"),
    )
    no_day, no_text = F.col("day").isNull(), F.col("said") == ""
    valued = F.col("has_debit") | F.col("has_credit")
    both = F.col("split") & F.col("has_debit") & F.col("has_credit")
    zero = (F.coalesce("debit_cents", F.lit(0)) == 0) & (F.coalesce("credit_cents", F.lit(0)) == 0)
    amount = F.abs(F.when(F.col("split") & valued, F.when(F.col("has_debit"), F.col("debit_cents")).otherwise(F.col("credit_cents"))).otherwise(F.col("general")))
    reason = (
        F.when(F.col("repeated") & ~(no_text & ~valued & ~F.col("has_amount") & no_day), "REPEATED_HEADER").when(no_day & no_text & ~valued & ~F.col("has_amount"), "EMPTY")
        .when((F.col("day") < F.col("period.start")) | (F.col("day") > F.col("period.end")), "OUTSIDE_STATEMENT_PERIOD")
        .when(F.col("split") & ~valued & ~F.col("has_amount"), F.when(~no_day & ~no_text, "NO_MOVEMENT").otherwise("FOOTER_OR_METADATA")).when(no_day & ~valued & ~F.col("has_amount"), "EMPTY")
        .when(no_day & (F.col("said").rlike(r"(?i)^total(?:\s|$)") | no_text), "FOOTER_OR_METADATA").when(no_day | no_text, "ISSUE:DATE_OR_TEXT").when(both & ~zero, "ISSUE:BOTH_SIDES").when(both, "NO_MOVEMENT").when(amount.isNull(), "ISSUE:AMOUNT").otherwise("TRANSACTION")
    )
    base = base.select("*", text.transaction_type(F.col("said"), F.col("payment_method")).alias("kind"), text.transaction_type(F.col("said")).alias("told"), text.investment_action(F.col("said")).alias("action"))
    told, action = F.col("told"), F.col("action")
    incoming, outgoing = F.col("way").rlike("credit|entrada|receb"), F.col("way").rlike("debit|saida|pag")
    earned = told.isin("INCOME", "REFUND", "INVESTMENT_INCOME") | (told == "INVESTMENT") & F.coalesce(action == "RESCUE", F.lit(False))
    direction = F.when(F.col("split") & valued, F.when(F.col("has_debit"), "DEBIT").otherwise("CREDIT")).when(incoming, "CREDIT").when(outgoing, "DEBIT").when(earned, "CREDIT").otherwise("DEBIT")
    known = F.col("split") & valued | incoming | outgoing | told.isin("INCOME", "REFUND", "INVESTMENT_INCOME", "EXPENSE") | (told == "INVESTMENT") & action.isNotNull()
    party = F.coalesce("companion_name", counterparty.named(counterparty.from_description(F.col("said"))))
    parsed = base.select(
        "file", "row_idx", "line", "section", "format", F.col("day").alias("date"), F.col("said").alias("original_description"), F.concat_ws(" ", "said", "added").alias("source_description"), amount.alias("amount"), direction.alias("direction"),
        known.alias("direction_known"), F.col("kind").alias("type"), action.alias("investment_action"), "payment_method", "balance_after", "document", party.alias("counterparty_name"), text.installment(F.col("said")).alias("installment"), reason.alias("row_class"),
    )
    return _identified(_without_copies(parsed))


def _without_copies(parsed: DataFrame) -> DataFrame:
    """Auxiliary transactions that the main section or an earlier auxiliary row holds become DUPLICATE_AUXILIARY."""
    same = Window.partitionBy("file", "row_class", "date", F.lower("document"), plain(F.col("original_description")), "direction", "amount").orderBy(F.col("section").desc(), "row_idx")
    again = (F.col("row_class") == "TRANSACTION") & (F.col("section") == "AUXILIARY") & (F.row_number().over(same) > 1)
    return parsed.withColumn("row_class", F.when(again, "DUPLICATE_AUXILIARY").otherwise(F.col("row_class")))


def _identified(parsed: DataFrame) -> DataFrame:
    """bank_transaction_id: doc:<document> where a file's transactions of a section hold the document once, else a fingerprint with its occurrence."""
    here = ["file", "section", "row_class"]
    mark = fingerprint(F.col("date"), F.col("original_description"), F.col("amount"), F.col("direction"), F.col("balance_after"), F.col("type"), F.col("document"))
    marked = parsed.withColumn("mark", F.when(F.col("row_class") == "TRANSACTION", mark))
    single = (F.col("document") != "") & (F.count("*").over(Window.partitionBy(*here, "document")) == 1)
    nth = F.row_number().over(Window.partitionBy(*here, "mark").orderBy("row_idx")).cast("string")
    known = F.when(F.col("mark").isNotNull(), F.when(single, F.concat(F.lit("doc:"), "document")).otherwise(F.concat_ws(":", F.lit("auto"), "mark", nth)))
    out = marked.withColumn("bank_transaction_id", known).drop("mark")
    id_ = F.concat(F.lit("bank-"), fingerprint(F.col("date"), F.col("original_description"), F.col("amount"), F.col("direction"), F.col("bank_transaction_id")))
    return out.withColumn("id", F.when(F.col("row_class") == "TRANSACTION", id_))


def ledger_rows(lines: DataFrame) -> DataFrame:
    """Every row of rows() as a ledger row: row_class TRANSACTION, or ISSUE without a valid date, text and amount. Ids that repeat in a file give way to a fingerprint."""
    said = {k: F.trim(_blank(k)) for k in ("id", "date", "description", "amount", "payment_method", "category", "month", "year", "is_fixed", "is_essential")}
    part = text.installment(said["description"])
    base = lines.select(
        "file", "row_idx", "line", said["id"].alias("own_id"), text.normalize_date(said["date"]).alias("date"), said["description"].alias("original_description"), F.abs(text.normalize_amount(said["amount"])).alias("amount"),
        F.lit("DEBIT").alias("direction"), text.ledger_type(said["description"], said["payment_method"]).alias("type"), text.investment_action(said["description"]).alias("investment_action"),
        *(said[k].alias(k) for k in ("payment_method", "category", "month", "year")), text.parse_boolean(said["is_fixed"]).alias("is_fixed"), text.parse_boolean(said["is_essential"]).alias("is_essential"), part.alias("installment"),
    )
    good = F.col("date").isNotNull() & (F.col("original_description") != "") & F.col("amount").isNotNull()
    marked = base.withColumn("row_class", F.when(good, "TRANSACTION").otherwise("ISSUE"))
    marked = marked.withColumn("mark", F.when(good, fingerprint(F.col("date"), F.col("original_description"), F.col("amount"), F.col("installment.number"), F.col("installment.total"))))
    single = (F.col("own_id") != "") & (F.count("*").over(Window.partitionBy("file", "own_id")) == 1)
    nth = F.row_number().over(Window.partitionBy("file", "mark").orderBy("row_idx")).cast("string")
    out = marked.withColumn("sheet_record_id", F.when(F.col("mark").isNotNull(), F.when(single, F.col("own_id")).otherwise(F.concat_ws(":", F.lit("auto"), "mark", nth))))
    return out.withColumn("id", F.when(F.col("mark").isNotNull(), F.concat(F.lit("sheet-"), fingerprint(F.col("sheet_record_id"))))).drop("mark", "own_id")


def movement_period(parsed: DataFrame) -> DataFrame:
    """First and last day with a transaction, and their number, per file."""
    return parsed.filter("row_class = 'TRANSACTION'").groupBy("file").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("transactions"))


def exclusion_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("row_class").agg(F.count("*").alias("n"))
