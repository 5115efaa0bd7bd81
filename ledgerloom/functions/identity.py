"""Stable identities of rows: fingerprints and keys that don't depend on row numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Start and factor of each of the two 32-bit hashes, and the separator of the parts.
FIRST, FIRST_FACTOR = 0x811C9DC5, 0x01000193
SECOND, SECOND_FACTOR = 0x9E3779B9, 0x85EBCA6B
SEPARATOR = "\u001f"
LOW32 = 0xFFFFFFFF


def _units(text: Column) -> Column:
    """UTF-16 code units; a character beyond the basic plane gives two."""
    points = F.transform(F.array_remove(F.split(text, ""), ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda p: F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(0x3FF))
    # Few texts have such characters; the others' points are their units.
    return let(points, lambda all_: F.when(F.array_max(all_) > 0xFFFF, F.flatten(F.transform(all_, lambda p: F.when(p > 0xFFFF, pair(p)).otherwise(F.array(p))))).otherwise(all_))


def _hashed(units: Column, start: int, factor: int) -> Column:
    """8 hexadecimal digits: each unit is joined by exclusive or, then the whole is multiplied modulo 2^32. A factor from 2^31 on counts as the negative number of the same low 32 bits, so that no product leaves 64 bits."""
    times = F.lit(factor - (LOW32 + 1) if factor > LOW32 >> 1 else factor).cast("long")
    return F.aggregate(units, F.lit(start).cast("long"), lambda h, u: (h.bitwiseXOR(u) * times).bitwiseAND(LOW32), lambda h: F.lower(F.lpad(F.hex(h), 8, "0")))


def fingerprint(*parts: Column) -> Column:
    """16 hexadecimal digits over the trimmed parts; null counts as empty."""
    cells = [F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"^\s+|\s+$", "") for p in parts]
    return let(_units(F.concat_ws(SEPARATOR, *cells)), lambda units: F.concat(_hashed(units, FIRST, FIRST_FACTOR), _hashed(F.transform(units, lambda u, i: u + i), SECOND, SECOND_FACTOR)))


def sheet_identity(record_id: Column, *content: Column) -> Column:
    """The record's own id, else a fingerprint of date, text, amount, direction and instalment."""
    return F.coalesce(F.nullif(record_id, F.lit("")), F.concat(F.lit("sheet:"), fingerprint(*content)))


def bank_identity(transaction_id: Column, *content: Column) -> Column:
    return F.coalesce(F.nullif(transaction_id, F.lit("")), F.concat(F.lit("bank:"), fingerprint(*content)))


def card_identities(statements: Column, dates: Column, card: Column, *content: Column) -> Column:
    """Every identity under which a card purchase may be stored: each statement identity with each date, with and without the card."""
    known = lambda values: F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    prints = F.flatten(F.transform(known(dates), lambda d: F.array(fingerprint(card, d, *content), fingerprint(d, *content))))
    return F.array_distinct(F.flatten(F.transform(known(statements), lambda s: F.transform(prints, lambda p: F.concat_ws(":", s, p)))))


def decision_key(kind: Column, identities: Column) -> Column:
    return F.concat_ws(":", kind, F.to_json(identities))


def composition_key(ids: Column) -> Column:
    """The same text for the same set of rows in any order."""
    return F.array_join(F.array_sort(ids), "|")
