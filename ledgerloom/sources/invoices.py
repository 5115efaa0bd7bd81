"""Card invoices: the lines of an invoice's pages to purchases, refunds, adjustments, subtotals and the sums it reports.

An invoice is one row (file, pages: lists of lines) of a few hundred lines. What it says once is read off its lines by expressions; what depends on the lines before or after, such as the card in force, a day
printed above a row and its month below, comes from windows over the lines of a file. Two layouts are known; any other gives an invoice without rows and an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import SEPARATOR, fingerprint
from ..functions.text import ACCENTED, PLAIN, normalize_description
from ..plans.shared import cut

# Money, marks of the two layouts, titles that open and close the list of purchases, rows that are no purchases, words of taxes, fees and payments, months.
MONEY = r"(?:R\$\s*)?-?\d{1,3}(?:\.\d{3})*,\d{2}\s*-?"
BANKING_MARKS = [r"fatura\s+data\s+\d{2}/\d{2}/\d{4}", "cartao selecionado", "data de vencimento:", r"gastos referentes ao cartao:\s*final\s+\d{4}", r"\bdata\s*\|?\s*lancamentos\b", r"total da fatura\s*:"]
MOBILE_MARKS = [r"total da fatura\s+vencimento", r"numero do cartao\s+\d{4}\s+x{4}\s+x{4}\s+\d{4}", "historico de lancamentos", "total da fatura em real"]
SECTION_END = r"^(?:limites?\b|opcoes de pagamento\b|opcoes de parcelamento\b|parcelado facil\b|parcelamento da fatura\b|pagamento minimo\b|parcelas futuras\b|total parcelado\b|juros\b|taxas?\b|cet\b|iof\b|programa de pontos\b|fidelidade\b|informacoes legais\b)"
NO_PURCHASE = r"^(?:data\b|lancamentos\b|moeda\b|valor da fatura\b|forma de pagamento\b|melhor data de compra\b|total\b|resumo\b|saldo anterior\b|despesas locais\b|despesas no exterior\b|\(-\)\s*pagamentos?\s*/\s*creditos\b|\(\+\)\s*despesas\b|\(=\)\s*total\b|gastos referentes\b|cet\b|informacoes legais\b)"
TAX, FEE, PAYMENT = r"\b(?:iof|imposto|tributo|taxa tributaria)\b", r"\b(?:tarifa|taxa|juros|encargos?)\b", r"\b(?:pagto\.?|pagamento da fatura|pagto por deb)\b"
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
DATE, CARD, PART = r"\d{2}/\d{2}(?:/\d{4})?", r"(?i)(\d{4})\s+XXXX\s+XXXX\s+(\d{4})", r"(?:^|\s)\(?\s*(\d{1,2})\s*/\s*(\d{1,2})\s*\)?(?=\s|$)"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cents_of(money: Column) -> Column:
    """Cents of a text that MONEY fits; a minus on either side makes it negative. Null where there is none."""
    digits = F.regexp_replace(money, "[^0-9]", "").try_cast("long")
    return F.when(money.contains("-"), -digits).otherwise(digits)


def cells_of(line: Column) -> Column:
    """Cells of a row, parted by bars or tabs."""
    bar = F.when(line.contains("|"), F.split(line, r"\|")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.array(line))
    return F.when(line.contains("|") | line.contains("\t"), F.transform(bar, lambda c: F.trim(c))).otherwise(bar)


def with_money(lines: DataFrame) -> DataFrame:
    """lines (line) with low (folded), cells and money: cents of a row, the first money from its fourth cell on, else the last one; a lone minus in the cells behind it makes it negative.

    Each step is a column of its own, so that no expression is repeated inside another.
    """
    lines = lines.withColumn("low", folded(F.col("line"))).withColumn("cells", cells_of(F.col("line")))
    late = F.get(F.filter(F.transform(F.slice("cells", 4, 1 << 20), lambda c: F.regexp_extract(c, MONEY, 0)), lambda m: m != ""), F.lit(0))
    last = F.try_element_at(F.regexp_extract_all("line", F.lit(MONEY), F.lit(0)), F.lit(-1))
    lines = lines.withColumn("chosen", F.coalesce(F.when(F.size("cells") > 1, late), last)).withColumn("value", cents_of(F.col("chosen")))
    behind = F.regexp_replace(F.call_function("substring_index", F.col("line"), F.col("chosen"), F.lit(-1)), r"[|\s]", "")
    return lines.withColumn("money", F.when((F.col("value") >= 0) & (behind == "-"), -F.col("value")).otherwise(F.col("value"))).drop("chosen", "value")


def labelled_money(lines: Column, label: str) -> Column:
    """The last money of the first line that the label fits and that has any."""
    found = F.filter(lines, lambda line: folded(line).rlike(label) & line.rlike(MONEY))
    return cents_of(F.try_element_at(F.regexp_extract_all(F.get(found, F.lit(0)), F.lit(MONEY), F.lit(0)), F.lit(-1)))


def _first(lines: Column, pattern: str) -> Column:
    """The first line that a pattern fits."""
    return F.get(F.filter(lines, lambda line: folded(line).rlike(pattern)), F.lit(0))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def layout(text: Column) -> Column:
    """INTERNET_BANKING, MOBILE_APP or UNKNOWN by the marks in the whole text."""
    hits = lambda marks: sum((folded(text).rlike(m).cast("int") for m in marks), F.lit(0))
    return F.when(hits(BANKING_MARKS) >= 3, "INTERNET_BANKING").when(hits(MOBILE_MARKS) >= 2, "MOBILE_APP").otherwise("UNKNOWN")


def whole_date(text: Column) -> Column:
    """Date of a day/month/year text; null for days that don't exist."""
    return F.try_to_date(text, "dd/MM/yyyy")


def day_of(text: Column, due: Column) -> Column:
    """Date of day/month with or without a year; without one, a month after that of the due date lies in the year before."""
    short = F.concat(F.substring(text, 1, 5), F.lit("/"), (F.year(due) - (F.substring(text, 4, 2).try_cast("int") > F.month(due)).cast("int")).cast("string"))
    return whole_date(F.when(F.length(text) == 10, text).otherwise(short))


def month_day(day: Column, month: Column, due: Column) -> Column:
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(folded(month), 1, 3)).cast("string")
    return day_of(F.concat(F.lpad(day, 2, "0"), F.lit("/"), F.lpad(number, 2, "0")), due)


def parted(text: Column) -> Column:
    """(number, total, rest) of a purchase text: the first `n/m` and the text without it; nulls where there is none."""
    whole = F.regexp_extract(text, PART, 0)
    before = F.call_function("substring_index", text, whole, F.lit(1))
    rest = squeezed(F.concat(before, F.lit(" "), F.substring(text, F.length(before) + F.length(whole) + 1, F.length(text))))
    number = lambda i: F.regexp_extract(text, PART, i).try_cast("int")
    return F.struct(number(1).alias("number"), number(2).alias("total"), F.when(whole == "", F.trim(text)).otherwise(rest).alias("rest"))


def _with_text(rows: DataFrame) -> DataFrame:
    """Rows with said: what an Internet Banking row describes, the first filled cell before the money, else the line without date and money."""
    dated = F.get("cells", F.lit(0)).rlike(rf"^{DATE}(?:\s|$)")
    rows = rows.withColumn("relevant", F.slice("cells", F.when(dated, 2).otherwise(1), F.greatest(F.size("cells"), F.lit(1))))
    rows = rows.withColumn("money_at", F.array_position(F.transform("relevant", lambda c: c.rlike(MONEY)), True).cast("int"))
    before = F.when(F.col("money_at") > 0, F.slice("relevant", F.lit(1), F.col("money_at") - 1)).otherwise(F.col("relevant"))
    rows = rows.withColumn("cell", F.when(F.size("cells") > 1, F.get(F.filter(before, lambda c: c != ""), F.lit(0))))
    undated = lambda t: F.regexp_replace(t, rf"^\s*{DATE}\s*", "")
    plain = F.regexp_replace(F.regexp_replace(undated(F.col("line")), MONEY, " "), r"[|\t]", " ")
    return rows.withColumn("said", squeezed(F.coalesce(undated(F.col("cell")), plain))).drop("relevant", "money_at", "cell")


@dataclass(frozen=True)
class Invoices:
    statements: DataFrame  # one row per file: layout, dates, reported sums, identities, errors
    rows: DataFrame  # purchases and refunds
    adjustments: DataFrame  # fees and taxes
    subtotals: DataFrame  # what the invoice reports per card


def _banking_header(s: DataFrame) -> DataFrame:
    lines, text = F.col("lines"), F.array_join("lines", "\n")
    due = whole_date(_found(text, r"(?i)data de vencimento:[^\d\n]*(\d{2}/\d{2}/\d{4})"))
    total = F.coalesce(_found(text, r"(?i)total da fatura:[^\d\n]*R\$\s*([\d.]+,\d{2})"), _found(text, r"(?i)total da fatura\s*\(final[^\n]*\):\s*R\$\s*([\d.]+,\d{2})"))
    blocks = F.exists(lines, lambda x: folded(x).rlike(r"gastos referentes ao cartao:\s*final\s+\d{4}"))
    table = F.exists(lines, lambda x: folded(x).rlike(r"^data\b") & folded(x).rlike(r"\blancamentos\b"))
    place = F.array_position(F.transform(lines, lambda x: folded(F.trim(x)) == "cartao selecionado"), True).cast("int")
    beside = F.transform(F.slice(lines, place + 1, 4), lambda x: _found(x, r"(?i)^(?:\*{4}|x{4})(?:\s+(?:\*{4}|x{4})){2}\s+(\d{4})$"))
    picked = F.when((place > 0) & ~blocks, F.get(F.filter(beside, lambda x: x.isNotNull()), F.lit(0)))
    local, foreign = labelled_money(lines, r"\(\+\)\s*despesas locais"), labelled_money(lines, "despesas no exterior")
    paid = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(_first(lines, "^forma de pagamento:"), "^[^:]*:", ""), r"\|", " ")), F.lit(""))
    s = s.select(
        "*", due.alias("due_date"), cents_of(total).alias("total"), table.alias("table"), picked.alias("picked"), labelled_money(lines, "saldo anterior").alias("previous_balance"), labelled_money(lines, r"pagamentos?\s*/\s*creditos").alias("credits"),
        F.when(local.isNotNull() | foreign.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(foreign, F.lit(0))).alias("debits"), paid.alias("payment_method"), _found(_first(lines, "^melhor data de compra:"), r"(\d{1,2})\s*$").cast("int").alias("best_day"),
        F.lit(None).cast("date").alias("next_closing"),
    )
    fits = F.col("table") & F.col("due_date").isNotNull() & (F.col("total") > 0)
    return s.withColumn("fallback", F.when(F.coalesce(fits, F.lit(False)), F.concat(F.lit("XXXX XXXX XXXX "), "picked"))).drop("table", "picked")


def _mobile_header(s: DataFrame) -> DataFrame:
    front, text = F.get("pages", F.lit(0)), F.array_join(F.get("pages", F.lit(0)), "\n")
    place = F.array_position(F.transform(front, lambda x: folded(x).rlike("total da fatura.*vencimento")), True).cast("int")
    due = whole_date(F.when(place > 0, _found(F.array_join(F.slice(front, F.greatest(place, F.lit(1)), 4), " "), r"(\d{2}/\d{2}/\d{4})")))
    closing = whole_date(_found(text, r"(?i)previs[aã]o de fechamento da pr[oó]xima fatura\s*:?\s*(\d{2}/\d{2}/\d{4})"))
    return s.select(
        "*", due.alias("due_date"), labelled_money(F.col("lines"), "total da fatura em real").alias("total"), labelled_money(front, "saldo anterior").alias("previous_balance"), labelled_money(front, r"creditos\s*/\s*pagamentos").alias("credits"),
        labelled_money(front, r"compras\s*/\s*debitos").alias("debits"), F.lit(None).cast("string").alias("payment_method"), F.lit(None).cast("int").alias("best_day"), closing.alias("next_closing"), F.lit(None).cast("string").alias("fallback"),
    )


def _before(order: Window, value: Column) -> Column:
    """The last value before a line."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


# Roles of what _banking_rows() and _mobile_rows() find (file, place, card, role, date, description, money, number, of, city): rows, and the sums of a card, of which the first of those at the end of a list (CLOSING) counts.
ROWS, SUMS = ["ROW", "TAX", "FEE", "PAYMENT"], ["SUBTOTAL", "CLOSING"]


def _banking_rows(lines: DataFrame) -> DataFrame:
    """Rows as read and subtotals, in one pass. lines: file, due_date, fallback, place, line."""
    lines = with_money(lines)
    low = F.col("low")
    block, closing, summary = _found(F.col("line"), r"(?i)gastos referentes ao cart[aã]o:\s*final\s+(\d{4})"), low.rlike(r"total da fatura\s*\(final"), low.rlike(r"^resumo das despesas\b")
    event = F.when(block.isNotNull(), F.concat(F.lit("XXXX XXXX XXXX "), block)).when(closing | summary, F.lit(""))
    file = Window.partitionBy("file").orderBy("place")
    marked = lines.withColumn("event", event).withColumn("card", F.coalesce(_before(file, F.col("event")), "fallback", F.lit(""))).withColumn("part", F.count("event").over(file))
    reported = cents_of(_found(F.col("line"), r"(?i)valor da fatura:[^\d\n]*R\$\s*([\d.]+,\d{2})"))
    at_block = F.col("event").isNotNull() & (F.col("event") != "") & F.col("reported").isNotNull()
    own = F.col("fallback").isNotNull() & (F.col("card") != "") & (_found(F.col("line"), r"(?i)total da fatura\s*\(final\s+(\d{4})\)") == F.substring("card", -4, 4))
    at_end = (F.col("event") == "") & own & F.col("money").isNotNull()
    marked = marked.withColumn("reported", F.when(F.col("event") != "", reported)).withColumn("sums", F.when(at_block, "SUBTOTAL").when(at_end, "CLOSING"))
    marked = marked.withColumn("card", F.when(F.col("sums") == "SUBTOTAL", F.col("event")).otherwise(F.col("card"))).withColumn("money", F.when(F.col("sums") == "SUBTOTAL", F.col("reported")).otherwise(F.col("money")))
    inside = F.col("event").isNull() & (F.col("card") != "")
    only_date, any_date = _found(F.col("line"), rf"^\s*({DATE})\s*$"), _found(F.col("line"), rf"^\s*({DATE})\b")
    months = "|".join(MONTHS)
    kind = (
        F.when(only_date.isNotNull(), "E").when(F.col("line").rlike(r"^\d{1,2}$"), "D").when(low.rlike(f"^(?:{months})$"), "M").when(any_date.isNotNull(), "X").when(F.coalesce(F.col("money"), F.lit(0)) != 0, "R")
    )
    body = marked.withColumn("kind", F.when(inside, kind)).filter("kind is not null or sums is not null").drop("event", "reported", "fallback")
    part = Window.partitionBy("file", "part").orderBy("place")
    step = F.when(F.col("kind").isin("D", "M", "X"), F.struct("kind", "line"))
    ahead = F.first(step, ignorenulls=True).over(part.rowsBetween(1, Window.unboundedFollowing))
    body = body.withColumn("above", _before(part, step)).withColumn("below", ahead)
    body = body.withColumn("waits", (F.col("kind") == "R") & F.coalesce(F.col("above.kind") == "D", F.lit(False)))
    mark = F.when(F.col("kind").isin("E", "D", "X") | (F.col("kind") == "R") & ~F.col("waits"), F.struct("kind", only_date.alias("date")))
    body = body.withColumn("mark", _before(part, mark))
    own_date = (
        F.when(F.col("kind") == "X", day_of(any_date, F.col("due_date"))).when(F.col("waits") & (F.col("below.kind") == "M"), month_day(F.col("above.line"), F.col("below.line"), F.col("due_date")))
        .when(~F.col("waits") & (F.col("mark.kind") == "E"), day_of(F.col("mark.date"), F.col("due_date")))
    )
    rows = body.filter("sums is not null or kind in ('X', 'R')").withColumn("own", F.when(F.col("kind").isNotNull(), own_date))
    rows = _with_text(rows.filter(F.col("sums").isNotNull() | ~F.col("waits") | F.coalesce(F.col("below.kind") == "M", F.lit(False)))).withColumn("low", folded(F.col("said")))
    pays = F.col("low").rlike(PAYMENT)
    adjusts = F.when(F.col("low").rlike(TAX), "TAX").when(F.col("low").rlike(FEE), "FEE")
    plain = ~pays & ~F.col("low").rlike(r"^saldo anterior\b") & (F.coalesce(F.col("money"), F.lit(0)) != 0) & (F.col("said") != "")
    role = F.when(pays, "PAYMENT").when(plain & adjusts.isNotNull(), adjusts).when(plain & ~F.col("low").rlike(NO_PURCHASE), "ROW")
    rows = rows.withColumn("role", F.coalesce("sums", role)).filter("role is not null")
    dated = F.when((F.col("role") != "PAYMENT") & F.col("own").isNotNull(), F.col("own"))
    inherits = (F.col("kind") == "R") & ~F.col("waits")
    rows = rows.withColumn("date", F.coalesce("own", F.when(inherits, _before(part, dated)))).filter("sums is not null or role = 'PAYMENT' or date is not null")
    split = parted(F.col("said"))
    return rows.withColumn("p", split).select("file", "place", "card", "role", "date", F.when(F.col("role") == "ROW", F.col("p.rest")).otherwise(F.col("said")).alias("description"), "money", "p.number", F.col("p.total").alias("of"), F.lit("").alias("city"))


def _mobile_rows(lines: DataFrame) -> DataFrame:
    """Rows as read and subtotals, in one pass. lines: file, due_date, place, line."""
    lines = with_money(lines)
    low, line = F.col("low"), F.col("line")
    file = Window.partitionBy("file").orderBy("place")
    card = F.when(line.rlike(CARD), F.concat(F.regexp_extract(line, CARD, 1), F.lit(" XXXX XXXX "), F.regexp_extract(line, CARD, 2)))
    opens, closes = low.rlike(r"^lancamentos\b"), low.rlike(SECTION_END)
    marked = lines.withColumn("step", F.when(opens, "ON").when(closes, "OFF").when(card.isNotNull(), "CARD")).withColumn("named", card)
    marked = marked.withColumn("open", _before(file, F.when(F.col("step").isin("ON", "OFF"), F.col("step")))).withColumn("card", F.coalesce(_before(file, F.when(F.col("step") == "CARD", F.col("named")).when(F.col("step") == "OFF", "")), F.lit("")))
    inside = F.col("step").isNull() & F.coalesce(F.col("open") == "ON", F.lit(False))
    pays, sums, starts = low.rlike(PAYMENT), low.rlike("total para") & (F.col("card") != ""), line.rlike(r"^\d{2}/\d{2}")
    marked = marked.withColumn("role", F.when(~inside, None).when(pays, "PAYMENT").when(sums, F.when(F.col("money").isNotNull(), "SUBTOTAL").otherwise("ASK")).when(~starts & F.col("money").isNotNull(), "ANSWER").when(starts, "DATED"))
    turn = F.when(F.col("step").isin("OFF", "CARD"), F.lit("")).when(F.col("role") == "ASK", F.col("card"))
    marked = marked.withColumn("asked", F.coalesce(_before(file, turn), F.lit(""))).withColumn("round", F.count(turn).over(file))
    round_ = Window.partitionBy("file", "round").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("answered", F.count_if(F.col("role") == "ANSWER").over(round_)).withColumn("waiting", (F.col("asked") != "") & (F.coalesce("answered", F.lit(0)) == 0))
    answers = (F.col("role") == "ANSWER") & F.col("waiting")
    reads = F.col("role").isin("ANSWER", "DATED") & (F.col("card") != "") & line.rlike(rf"^\s*{DATE}\b")
    found = marked.withColumn("card", F.when(answers, F.col("asked")).otherwise(F.col("card"))).withColumn("role", F.when(answers, "SUBTOTAL").when(F.col("role").isin("SUBTOTAL", "PAYMENT"), F.col("role")).when(reads, "ROW")).filter("role is not null")
    cells = F.col("cells")
    found = found.withColumn("whole", F.array_join(cells, " "))
    whole = F.col("whole")
    history = F.when(F.size(cells) > 2, F.get(cells, F.lit(1))).otherwise(whole)
    undated = lambda t: F.trim(F.regexp_replace(t, rf"^\s*{DATE}\s*", ""))
    tail = F.trim(F.regexp_replace(undated(whole), MONEY, ""))
    cut_out = squeezed(F.regexp_replace(tail, r"^(.*?)(?:^|\s)\d{1,2}/\d{1,2}(?=\s|$)", "$1 "))
    text = F.when((F.size(cells) > 2) & (F.get(cells, F.lit(1)) != ""), undated(F.get(cells, F.lit(1)))).otherwise(cut_out)
    first = F.coalesce(F.when(F.size(cells) > 1, _found(F.get(cells, F.lit(0)), f"({DATE})")), _found(whole, rf"^\s*({DATE})\b"))
    city = F.when(F.size(cells) > 3, squeezed(F.get(cells, F.lit(2)))).otherwise("")
    row = F.col("role") == "ROW"
    found = found.filter(~row | ~folded(history).rlike("pagto|pagamento da fatura|saldo anterior") & (F.coalesce("money", F.lit(0)) != 0))
    found = found.select("file", "place", "card", "role", day_of(first, F.col("due_date")).alias("date"), parted(text).alias("p"), "money", city.alias("city"))
    found = found.select("file", "place", "card", "role", "date", F.col("p.rest").alias("description"), "money", "p.number", F.col("p.total").alias("of"), "city")
    return found.filter("role <> 'ROW' or date is not null and description <> ''")


def parse(documents: DataFrame) -> Invoices:
    """Invoices of documents (file, pages array<array<string>>).

    statements: file, layout, statement, financial_identity, due_date, total, previous_balance, credits, debits, difference, previous_payment, payment_method, best_day, next_closing, errors. rows: file,
    statement, place, id, card, date, due_date, description, amount, direction, type, number, total, city. adjustments: file, place, card, date, description, amount, direction, kind.
    subtotals: file, card, amount. A null or empty list of pages is an unknown layout.
    """
    pages = documents.select("file", F.coalesce("pages", F.array().cast("array<array<string>>")).alias("pages"))
    pages = pages.withColumn("lines", F.transform(F.flatten("pages"), lambda x: F.trim(F.coalesce(x, F.lit(""))))).withColumn("layout", layout(F.array_join("lines", "\n")))
    pages = cut(pages)
    known = {name: cut(header(pages.filter(F.col("layout") == name))) for name, header in (("INTERNET_BANKING", _banking_header), ("MOBILE_APP", _mobile_header))}
    shape = ["file", "layout", "due_date", "total", "previous_balance", "credits", "debits", "payment_method", "best_day", "next_closing"]
    parts = []
    for name, read in (("INTERNET_BANKING", _banking_rows), ("MOBILE_APP", _mobile_rows)):
        parts.append(read(known[name].select("file", "due_date", "fallback", F.posexplode("lines").alias("place", "line"))))
    # Sums, cards and identities all read the rows, which are found once, together with the subtotals.
    found = cut(parts[0].unionByName(parts[1]))
    read, stated = found.filter(F.col("role").isin(ROWS)), found.filter(F.col("role").isin(SUMS)).select("file", "place", "card", "role", F.col("money").alias("amount"))
    closing = stated.filter("role = 'CLOSING'").groupBy("file", "card").agg(F.min(F.struct("place", "amount")).alias("first")).select("file", "first.place", "card", "first.amount")
    subtotals = cut(stated.filter("role = 'SUBTOTAL'").drop("role").unionByName(closing))
    heads = known["INTERNET_BANKING"].select(*shape).unionByName(known["MOBILE_APP"].select(*shape))
    unknown = pages.filter("layout = 'UNKNOWN'").select("file", F.concat(F.lit("statement-unsupported-"), fingerprint(F.array_join("lines", "\n"))).alias("statement"))

    signed = read.filter("role <> 'PAYMENT'").select("*", F.abs("money").alias("amount"), F.when(F.col("money") < 0, "CREDIT").otherwise("DEBIT").alias("direction"))
    adjustments = signed.filter("role <> 'ROW'").select("file", "place", "card", "date", "description", "amount", "direction", F.col("role").alias("kind"))
    side = lambda test, column="amount": F.coalesce(F.sum(F.when(F.expr(test), F.col(column))), F.lit(0))
    sums = signed.groupBy("file").agg(
        side("direction = 'DEBIT'").alias("debit_sum"), side("role = 'ROW' and direction = 'DEBIT'").alias("bought"), side("direction = 'CREDIT'").alias("credit_sum"), side("role = 'ROW' and direction = 'CREDIT'").alias("returned"),
        F.count_if(F.expr("role = 'ROW' and direction = 'DEBIT'")).alias("purchases"), F.count("*").alias("lines"),
    )
    paid = read.filter("role = 'PAYMENT' and money <> 0").groupBy("file").agg(F.max_by(F.abs("money"), "place").alias("previous_payment"), F.sum(F.abs("money")).alias("paid"))
    per_card = signed.groupBy("file", "card").agg((side("direction = 'DEBIT'") - side("direction = 'CREDIT'")).alias("net"))
    checked = subtotals.join(per_card, ["file", "card"], "left").groupBy("file").agg(F.sum("amount").alias("card_sum"), F.max(F.col("amount") != F.coalesce("net", F.lit(0))).alias("card_off"))
    cards = signed.select("file", "card", "role").unionByName(subtotals.select("file", "card", F.lit("SUBTOTAL").alias("role"))).join(heads.select("file", "layout"), "file")
    mobile = F.col("layout") == "MOBILE_APP"
    cards = cards.filter(~mobile | (F.col("role") == "ROW")).groupBy("file").agg(F.array_sort(F.collect_set(F.when(mobile, F.col("card")).otherwise(F.substring("card", -4, 4)))).alias("cards"))
    full = heads.join(sums, "file", "left").join(paid, "file", "left").join(checked, "file", "left").join(cards, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    difference = F.col("previous_balance") - F.col("credits") + F.col("debits") - F.col("total")
    banking = ~mobile
    code = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    errors = F.array_compact(F.array(
        code(banking & F.col("due_date").isNull(), "DUE_DATE"), code(F.col("total").isNull() | banking & (F.col("total") <= 0), "TOTAL"), code(banking & F.col("cards").isNull(), "CARD"), code(banking & (zero("lines") == 0), "LINES"),
        code(banking & (F.col("card_sum") != F.col("total")), "SUBTOTALS"), code(F.col("card_off"), "CARD_SUBTOTAL"), code(F.col("debits") != F.when(mobile, zero("bought")).otherwise(zero("debit_sum")), "DEBITS"),
        code(banking & (F.col("credits") != zero("paid") + zero("credit_sum")), "CREDITS"), code(mobile & F.col("previous_balance").isNotNull() & (zero("returned") + F.col("previous_payment") > F.col("credits")), "CREDITS"), code(difference != 0, "EQUATION"), code(mobile & (zero("purchases") == 0), "PURCHASES"),
    ))
    shown = F.array_join(F.concat(F.array(F.coalesce(F.col("due_date").cast("string"), F.lit("")), F.coalesce(F.col("total").cast("string"), F.lit(""))), F.coalesce("cards", F.array().cast("array<string>"))), SEPARATOR)
    statements = full.select(*shape, difference.alias("difference"), "previous_payment", errors.alias("errors"), F.concat(F.lit("statement-"), fingerprint(shown)).alias("statement"))
    rows = signed.filter("role = 'ROW'").join(statements.select("file", "statement", "due_date"), "file")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = fingerprint(*(F.col(c) for c in ("card", "date", "description", "amount", "direction")), blank("number"), blank("of"))
    rows = rows.select(
        "file", "statement", "place", F.concat_ws("-", F.lit("card"), "statement", number).alias("id"), "card", "date", "due_date", "description", "amount", "direction", F.when(F.col("direction") == "CREDIT", "REFUND").otherwise("PURCHASE").alias("type"),
        "number", F.col("of").alias("total"), "city",
    )
    text = F.concat_ws(":", F.substring("card", -4, 4), "date", normalize_description(F.col("description")), "amount", "direction", "type", blank("number"), blank("total"))
    listed = rows.groupBy("file").agg(F.array_sort(F.collect_list(text)).alias("texts"), F.array_sort(F.collect_set(F.substring("card", -4, 4))).alias("ends"))
    nets = subtotals.groupBy("file").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.substring("card", -4, 4), "amount"))).alias("nets"))
    key = F.concat(F.array(F.col("due_date").cast("string"), F.col("total").cast("string"), F.array_join("ends", ","), F.coalesce(F.array_join("nets", ","), F.lit(""))), F.col("texts"))
    identity = F.when(F.col("due_date").isNotNull() & F.col("total").isNotNull() & F.col("texts").isNotNull(), F.concat(F.lit("invoice-"), fingerprint(F.array_join(key, SEPARATOR))))
    statements = statements.join(listed, "file", "left").join(nets, "file", "left").withColumn("financial_identity", identity).drop("texts", "ends", "nets")
    lost = unknown.select("file", F.lit("UNKNOWN").alias("layout"), "statement", F.array(F.lit("LAYOUT")).alias("errors"))
    return Invoices(statements.unionByName(lost, allowMissingColumns=True), rows, adjustments, subtotals.select("file", "card", "amount"))


def positioned_lines(items: DataFrame, near: float = 2.5, left: float = 3.0, width_share: float = 0.62) -> DataFrame:
    """Lines of pages given as placed pieces of text: (file, page, line, text).

    items: file, page, width, x, y, text. Pieces whose heights differ by at most `near` from the first of a line form it, from the top; below the heading of the purchase table, pieces left of `width_share` of the page go to
    the column whose heading starts last at or before them, `left` units allowed, and columns are parted by bars. A page is a few thousand pieces.
    """
    page = Window.partitionBy("file", "page").orderBy(F.desc("y"), "x")
    rows = items.filter(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("n", F.row_number().over(page))
    held = rows.groupBy("file", "page").agg(F.max("width").alias("width"), F.sort_array(F.collect_list(F.struct("n", "x", "y", "text"))).alias("pieces"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("line"), F.array().cast("array<struct<line:int,x:double,text:string>>").alias("out"))

    def place(state: Column, piece: Column) -> Column:
        fresh = state["top"].isNull() | (state["top"] - piece["y"] > near)
        line = F.when(fresh, state["line"] + 1).otherwise(state["line"])
        one = F.struct(line.alias("line"), piece["x"].cast("double").alias("x"), piece["text"].alias("text"))
        return F.struct(F.when(fresh, piece["y"].cast("double")).otherwise(state["top"]).alias("top"), line.alias("line"), F.concat(state["out"], F.array(one)).alias("out"))

    placed = held.select("file", "page", "width", F.explode(F.aggregate("pieces", start, place, lambda s: s["out"])).alias("p")).select("file", "page", "width", "p.*")
    lines = placed.groupBy("file", "page", "width", "line").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("cells"))
    words = F.array_join(F.transform("cells", lambda c: c["text"]), " ")
    # The headings of the purchase table.
    titles = ["^data$", "^historico", "^cidade$", r"^us\$", "^cotacao", r"^r\$$"]
    anchor = lambda title: F.get(F.transform(F.filter("cells", lambda c: folded(c["text"]).rlike(title)), lambda c: c["x"]), F.lit(0))
    heads = folded(words).rlike(r"\bdata\b") & folded(words).rlike("historico de lancamentos") & folded(words).rlike("cidade")
    lines = lines.withColumn("words", words).withColumn("own", F.when(heads, F.array_compact(F.array(*map(anchor, titles)))))
    lines = lines.withColumn("anchors", F.last(F.when(F.size("own") >= 4, F.col("own")), ignorenulls=True).over(Window.partitionBy("file", "page").orderBy("line")))
    inside = F.filter("cells", lambda c: c["x"] <= F.col("width") * width_share)
    column = lambda c: F.greatest(F.aggregate(F.transform("anchors", lambda a, i: F.when((i > 0) & (c["x"] >= a - left), i).otherwise(0)), F.lit(0), lambda m, i: F.greatest(m, i)), F.lit(0))
    table = F.array_join(F.transform(F.sequence(F.lit(0), F.size("anchors") - 1), lambda k: F.array_join(F.transform(F.filter(inside, lambda c: column(c) == k), lambda c: c["text"]), " ")), " | ")
    return lines.select("file", "page", "line", F.when(F.col("anchors").isNotNull(), table).otherwise(F.col("words")).alias("text"))
