"""Names of the other side of a bank movement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import friendly_label, normalize_description

# Labels before a name, texts that are no names, sources by priority.
LABEL = r"(?i)(?:^|\s)(?:des|rem|fav|orig)\s*:\s*(.+)$"
GENERIC_NAMES = ["pix recebido", "pix enviado", "pix qr code estatico", "pix qr code dinamico", "compra visa", "gasto c credito", "rent inv facil", "devolucao pix", "transferencia"]
MERCHANT = r"(?i)^\s*(?:compra\s+visa|compra\s+debito|debito|compra|pagamento)\s+(.+)$"
# A label at the start, a date at the end, and marks at the end of a name; texts after which a name is a payee or a shop.
LABEL_START, DATE_END, MARKS_END = r"(?i)^\s*(?:des|rem|fav|orig)\s*:\s*", r"\s+\d{1,2}[/.\-]\d{1,2}(?:[/.\-]\d{2,4})?\s*$", r"[\s\-–—:;,|]+$"
PAYEE, SHOP = "^(?:pix enviado|pix qr code)", "^(?:compra no debito|compra)"
PRIORITY = {"OFX_NAME": 4, "OFX_MEMO": 3, "CSV_INTERNET_BANKING": 2, "CSV_MOBILE": 1}


def clean_name(text: Column) -> Column:
    """A name without label, trailing date and punctuation; null if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(text, LABEL_START, ""), DATE_END, "")
    name = F.regexp_replace(F.regexp_replace(name, MARKS_END, ""), r"\s+", " ")
    return F.nullif(F.trim(name), F.lit(""))


def named(text: Column) -> Column:
    """A cleaned name, null if it's a generic bank text."""
    name = clean_name(text)
    return F.when(~normalize_description(name).isin(GENERIC_NAMES), name)


def from_description(text: Column) -> Column:
    """The labelled name in a text, else what follows a purchase word."""
    return F.coalesce(clean_name(F.regexp_extract(text, LABEL, 1)), named(F.regexp_extract(text, MERCHANT, 1)))


def preferred(evidence: Column) -> Column:
    """Of array<struct<name, source>> the name of the best source, the longest among equals; null if the names disagree."""
    kept = F.filter(evidence, lambda e: clean_name(e["name"]).isNotNull())
    distinct = F.array_distinct(F.transform(kept, lambda e: normalize_description(clean_name(e["name"]))))
    rank = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    ranked = F.transform(kept, lambda e: F.struct(F.coalesce(F.element_at(rank, e["source"]), F.lit(0)).alias("rank"), F.length(e["name"]).alias("size"), clean_name(e["name"]).alias("name")))
    return F.when(F.size(distinct) == 1, F.array_max(ranked)["name"])


def without_name(text: Column, name: Column) -> Column:
    """A text without its labelled part, or without the name at its end; never empty unless the text is."""
    at = F.regexp_instr(text, F.lit(r"(?i)(?:^|\s)(?:des|rem|fav|orig)\s*:"))
    known = clean_name(F.coalesce(name, F.lit("")))
    ends = F.lower(F.trim(text)).endswith(F.concat(F.lit(" "), F.lower(known)))
    bare = F.trim(F.substring(F.trim(text), F.lit(1), F.length(F.trim(text)) - F.length(known)))
    return F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).when(known.isNotNull() & ends & (bare != ""), bare).otherwise(F.trim(text))


def displayable(text: Column, name: Column) -> Column:
    """The name to show beside a text: null if there's none or the rest of the text says the same."""
    shown = F.nullif(F.trim(name), F.lit(""))
    return F.when(normalize_description(without_name(text, shown)) != normalize_description(shown), shown)


def label(text: Column, direction: Column, kind: Column) -> Column:
    """How a name is introduced: De, Para, Estabelecimento or Contraparte, by the friendly name of the text."""
    said = normalize_description(friendly_label(text)["label"])
    return F.when((direction == "CREDIT") | kind.isin("REFUND", "INCOME"), "De").when(said.rlike(PAYEE), "Para").when(said.rlike(SHOP), "Estabelecimento").otherwise("Contraparte")
