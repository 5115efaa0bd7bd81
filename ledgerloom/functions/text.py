"""Normalisation and classification of Brazilian bank text as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one plain letter and combining marks U+0300 to U+036F, with that letter; the marks alone go."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    found = []
    for letter in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150)]):
        first, *rest = unicodedata.normalize("NFD", letter)
        if first != letter and first.isascii() and all(m in marks for m in rest):
            found.append((letter, first))
    return "".join(a for a, _ in found) + marks, "".join(b for _, b in found)


#: Accented Latin letters followed by the combining marks, and the base letters; what has no counterpart is removed.
ACCENTED, PLAIN = _accents()
# Phrases of card approvals, which say nothing about a purchase.
APPROVALS = r"\b(?:compra aprovada|pagamento aprovado|cartao final \d+)\b"
# Month names, words for yes and no, generic bank texts.
MONTHS = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
YES = ["sim", "s", "true", "verdadeiro", "1", "yes", "y"]
NO = ["não", "nao", "n", "false", "falso", "0", "no"]
GENERIC = ["pix enviado", "pix recebido", "pix qr code dinamico", "pix qr code estatico", "pix qrcode din", "pix qrcode est", "compra cartao visa", "cod lanc 0", "conta de telefone"]
# The patterns of transaction types, first match first.
OWN_ACCOUNT = r"pix enviado .{0,40}(?:conta propria|contas proprias|minha (?:outra )?conta|conta de minha titularidade|mesma titularidade)"
TYPE_PATTERNS = [
    ("CARD_PAYMENT", r"^gastos? (?:cartao(?: de)?|c|com) credito(?: |$)"),
    ("REFUND", r"\b(?:devolucao|estorno|reembolso)\b"),
    ("INVESTMENT_INCOME", r"^rentab invest facilcred(?: |$)"),
    ("INVESTMENT", r"resg|venc(?:imento)? cdb"),
    ("INVESTMENT", r"aplicacao"),
    ("TRANSFER", r"transferencia|ted|\bdoc\b|movimentacao interna|entre contas|transf\b|pix (?:para|entre) contas proprias|pix para minha conta|pix para conta propria|" + OWN_ACCOUNT),
    ("INCOME", r"pix recebido|recebimento pix|credito pix"),
    ("EXPENSE", r"pix enviado|envio pix|pix (?:qr code|qrcode) (?:din(?:amico)?|est(?:atico)?)(?: |$)|compra|comp cartao|seguro cart(?:ao)? deb(?:ito)?(?: bradesco)?(?: |$)|conta de telefone|mercado|farmacia|drogaria|posto de combustivel"),
]
PIX_PAYMENT = r"^(?:pix enviado|pix (?:qr code|qrcode) (?:din(?:amico)?|est(?:atico)?)|envio pix)(?: |$)"


def normalize_description(text: Column) -> Column:
    """Lower case without accents, approval phrases and punctuation, single spaces."""
    plain = F.lower(F.translate(text, ACCENTED, PLAIN))
    plain = F.regexp_replace(plain, APPROVALS, " ")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def normalize_amount(text: Column) -> Column:
    """Signed cents of a money text, or null. The later of comma and point is the decimal mark; a lone point before three digits groups thousands."""
    raw = F.regexp_replace(text, r"(?i)[\s\u00A0\uFEFF]|R\$|BRL", "")
    return let(raw, _cents)


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once; nested text expressions would otherwise be repeated at every use."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _cents(raw: Column) -> Column:
    negative = raw.startswith("-") | (raw.startswith("(") & raw.endswith(")"))
    unsigned = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[()]", ""), r"^[+-]", ""), r"[^0-9.,]", "")
    return F.when(negative, -1).otherwise(1) * let(unsigned, lambda digits: let(_decimal_mark(digits), lambda mark: _unsigned_cents(digits, mark)))


def _decimal_mark(digits: Column) -> Column:
    """Characters before the decimal mark, or null if there is none."""
    comma, point = (F.length(digits) - F.instr(F.reverse(digits), c) for c in ",.")
    has_comma, has_point = digits.contains(","), digits.contains(".")
    return F.when(has_comma & has_point, F.greatest(comma, point)).when(has_comma, comma).when(has_point & (F.length(digits) - point != 4), point)


def _unsigned_cents(digits: Column, mark: Column) -> Column:
    whole = F.regexp_replace(F.when(mark.isNotNull(), F.substring(digits, F.lit(1), mark)).otherwise(digits), r"[.,]", "")
    part = F.when(mark.isNotNull(), F.regexp_replace(F.substring(digits, mark + 2, F.length(digits)), r"[.,]", "")).otherwise("")
    value = F.concat(F.lit("0"), whole, F.lit("."), part, F.lit("0")).try_cast("double")
    return F.when(digits.rlike("[0-9]"), F.floor(value * 100 + 0.5).cast("long"))


def normalize_date(text: Column) -> Column:
    """Date of an ISO, day/month/year or written-out Portuguese date at the start of a text; null for anything else and for impossible dates."""
    raw = F.regexp_replace(text, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")
    pad = lambda year, month, day: F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    part = lambda pattern, i: F.regexp_extract(raw, pattern, i)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    br = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2}(?!\d))"
    long = r"(?i)^(\d{1,2})\s+(?:de\s+)?([a-záéíóúãõç]+)\s+(?:de\s+)?(\d{4})$"
    year = part(br, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(year >= "70", "19").otherwise("20"), year)).otherwise(year)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.translate(part(long, 2), ACCENTED, PLAIN)))
    return F.when(raw.rlike(iso), pad(part(iso, 1), part(iso, 2), part(iso, 3))).when(raw.rlike(br), pad(full, part(br, 2), part(br, 1))).when(
        raw.rlike(long) & (month > 0), pad(part(long, 3), month.cast("string"), part(long, 1))
    )


def parse_boolean(text: Column) -> Column:
    """True, false, or null for unknown."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(YES), True).when(word.isin(NO), False)


def transaction_type(description: Column, payment: Column | None = None) -> Column:
    """Type of a transaction from its text; a payment method 'investimento' counts like an application."""
    paid = normalize_description(payment) == "investimento" if payment is not None else F.lit(False)

    def first_fitting(value: Column) -> Column:
        out = F.lit("OTHER")
        for kind, pattern in reversed(TYPE_PATTERNS):
            fits = value.rlike(pattern)
            out = F.when(fits | paid if pattern == "aplicacao" else fits, kind).otherwise(out)
        return out

    return let(normalize_description(description), first_fitting)


def investment_action(description: Column) -> Column:
    value = normalize_description(description)
    return F.when(value.rlike(r"resg|venc(?:imento)? cdb"), "RESCUE").when(value.rlike("aplicacao"), "APPLICATION")


def is_generic(description: Column) -> Column:
    return normalize_description(description).isin(GENERIC)


def is_pix_payment(description: Column) -> Column:
    return normalize_description(description).rlike(PIX_PAYMENT)


# Letters from which containment, a long and a short prefix and letters in order count, the scores of each, the least share of the longer word
# that letters in order make up, and the weight of containment in a text.
CONTAINED, LONG_PREFIX, SHORT_PREFIX, IN_ORDER = (5, 0.85), (4, 0.8), (2, 0.55), (4, 0.72)
ORDER_SHARE, CONTAINMENT = 0.5, 0.92


def _token_score(a: Column, b: Column) -> Column:
    """How well two tokens fit: equal, contained, prefix, or the shorter one's letters in order within the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    in_order = F.aggregate(F.split(long, ""), F.lit(1), lambda at, c: F.when(c == F.substring(short, at, F.lit(1)), at + 1).otherwise(at)) > F.length(short)
    return (
        F.when(a == b, 1.0)
        .when((F.length(short) >= CONTAINED[0]) & long.contains(short), CONTAINED[1])
        .when((F.length(short) >= SHORT_PREFIX[0]) & long.startswith(short), F.when(F.length(short) >= LONG_PREFIX[0], LONG_PREFIX[1]).otherwise(SHORT_PREFIX[1]))
        .when((F.length(short) >= IN_ORDER[0]) & (F.length(short) >= ORDER_SHARE * F.length(long)) & in_order, IN_ORDER[1])
        .otherwise(0.0)
    )


def description_similarity(left: Column, right: Column) -> Column:
    """0 to 1: tokens of both texts are paired greedily, best pair first; the larger of dice and 0.92 times containment."""
    return normalized_similarity(normalize_description(left), normalize_description(right))


def normalized_similarity(a: Column, b: Column) -> Column:
    """description_similarity of texts that are normalised already, so that a join can normalise each side once per row."""
    tokens = lambda text: F.filter(F.split(text, " "), lambda t: F.length(t) > 1)
    pairs = F.flatten(F.transform(tokens(a), lambda x, i: F.transform(tokens(b), lambda y, j: F.struct((-_token_score(x, y)).alias("s"), i.alias("i"), j.alias("j")))))
    ranked = F.array_sort(F.filter(pairs, lambda p: p.s < 0))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("is"), F.array().cast("array<int>").alias("js"))
    taken = F.aggregate(
        ranked,
        start,
        lambda acc, p: F.when(F.array_contains(acc["is"], p.i) | F.array_contains(acc["js"], p.j), acc).otherwise(
            F.struct((acc["sum"] - p.s).alias("sum"), F.concat(acc["is"], F.array(p.i)).alias("is"), F.concat(acc["js"], F.array(p.j)).alias("js"))
        ),
        lambda acc: acc["sum"],
    )
    na, nb = F.size(tokens(a)), F.size(tokens(b))
    score = F.greatest(2 * taken / (na + nb), taken / F.least(na, nb) * CONTAINMENT)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(score)


# Friendly names and suggested payment methods of common bank texts, first match first.
FRIENDLY = [
    (r"^pix (?:qrcode|qr code) din(?:amico)?(?: |$)", "Pix QR Code Dinâmico", "Pix"),
    (r"^pix (?:qrcode|qr code) est(?:atico)?(?: |$)", "Pix QR Code Estático", "Pix"),
    (r"^pix enviado(?: |$)", "Pix Enviado", "Pix"),
    (r"^compra (?:cartao )?visa(?: |$)", "Compra no débito", "Débito"),
    (r"^seguro cart deb(?:ito)?(?: bradesco)?(?: |$)", "Seguro cartão de débito", "Débito automático"),
    (r"^gastos? (?:cartao(?: de)?|c|com) credito(?: |$)", "Pagamento de fatura", ""),
    (r"^conta de telefone(?: |$)", "Conta de telefone", "Débito automático"),
    (r"^aplicacao cdb(?: |$)", "Aplicação em CDB", "Investimento"),
]


def friendly_label(description: Column) -> Column:
    """A readable name for display (label) with a suggested payment method (payment); the trimmed text itself if none fits."""
    value = normalize_description(description)
    out = F.struct(F.trim(description).alias("label"), F.lit("").alias("payment"))
    for pattern, label, payment in reversed(FRIENDLY):
        out = F.when(value.rlike(pattern), F.struct(F.lit(label).alias("label"), F.lit(payment).alias("payment"))).otherwise(out)
    return out


def ledger_type(description: Column, payment: Column) -> Column:
    """Type of a ledger row: card payments, investments and income by their text, then the payment method, else an expense."""
    kind, paid = transaction_type(description), normalize_description(F.coalesce(payment, F.lit("")))
    own = normalize_description(description).rlike(r"transferencia entre contas(?: proprias)?|movimentacao interna|pix entre contas proprias|pix para minha conta|pix para conta propria|" + OWN_ACCOUNT)
    return (
        F.when(kind.isin("CARD_PAYMENT", "INVESTMENT", "INVESTMENT_INCOME", "INCOME"), kind).when(paid == "investimento", "INVESTMENT").when(paid.isin("transferencia", "transfer"), "TRANSFER")
        .when(paid == "credito bradesco", F.when(own, "TRANSFER").otherwise("EXPENSE")).when(kind == "OTHER", "EXPENSE").otherwise(kind)
    )


def installment(description: Column) -> Column:
    """(number, total) of a text like 'loja 2/10'; nulls if there is none."""
    pattern = r"\b(\d{1,2})\s*/\s*(\d{1,2})\b"
    part = lambda i: F.regexp_extract(description, pattern, i).try_cast("int")
    return F.struct(part(1).alias("number"), part(2).alias("total"))


def invoice_amount(text: Column) -> Column:
    """Cents of an invoice amount; a minus before or after it makes it negative."""
    bare = F.regexp_replace(text, r"^[\s-]+|[\s-]+$", "")
    return F.when(text.rlike(r"^\s*-|-\s*$"), -F.abs(normalize_amount(bare))).otherwise(normalize_amount(bare))


def is_timestamp(text: Column) -> Column:
    """Whether a text is a full ISO timestamp with offset that exists in the calendar."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(shape & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def installment_similarity(left: Column, right: Column) -> Column:
    """0 to 1: tokens of the left text in order each take the first free right token that equals, starts or continues it; larger of dice and 0.92 times containment."""
    tokens = lambda text: F.filter(F.split(normalize_description(text), " "), lambda t: F.length(t) > 1)

    def score(both: Column) -> Column:
        a, b = both["a"], both["b"]
        start = F.struct(b.alias("free"), F.lit(0).alias("hits"))

        def take(state: Column, token: Column) -> Column:
            place = F.array_position(F.transform(state["free"], lambda t: (t != "") & (t.startswith(token) | token.startswith(t))), True).cast("int")
            left_over = F.transform(state["free"], lambda t, i: F.when(i + 1 == place, F.lit("")).otherwise(t))
            return F.struct(F.when(place > 0, left_over).otherwise(state["free"]).alias("free"), (state["hits"] + (place > 0).cast("int")).alias("hits"))

        hits = F.aggregate(a, start, take, lambda state: state["hits"])
        shared = lambda h: F.greatest(2 * h / (F.size(a) + F.size(b)), CONTAINMENT * h / F.least(F.size(a), F.size(b)))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(hits, shared))

    blank = lambda text: F.coalesce(text, F.lit(""))
    return let(F.struct(tokens(blank(left)).alias("a"), tokens(blank(right)).alias("b")), score)
