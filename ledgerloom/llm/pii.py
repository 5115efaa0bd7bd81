"""Personal data by weak supervision.

Candidates are spans that a few wide patterns find. Labelers look at a candidate and vote for it, against it or not at all: patterns with their checks, gazetteers of domains, names and
streets, and the words before and after it. How often each labeler is right is estimated by expectation-maximisation over the votes of all candidates of the corpus, which Spark
counts by vote pattern. The posteriors of the patterns then teach a classifier on the features of a span. What it is sure of is added to the base spans, which always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the method adds, in the order in which spans of one start are listed after the base kinds.
ADDED = ("written_email", "local_phone", "iban", "national_id", "person", "street")
KINDS = BASE + ADDED

#: Characters looked at before and after a candidate.
NEAR = 48
#: Hashed features of the final classifier, candidates it is fitted on at most (by kind and vote pattern), and the score from which a span is added.
FEATURES, FIT_ROWS, SURE = 512, 20_000, 0.9

# Words that announce a kind of personal data in English, German, French and Spanish.
CONTEXT = {
    "email": "email e-mail mail contact contacto kontakt courriel correo write schreiben",
    "ip": "ip address adresse host server login logged client from dirección",
    "card": "card karte carte tarjeta visa mastercard amex credit credito kredit payment paid",
    "phone": "phone tel telephone telefon téléphone teléfono mobile handy móvil call fax cell whatsapp anrufen llamar appeler",
    "iban": "iban account konto compte cuenta bank banque banco",
    "national_id": "ssn social security cpf dni nif passport passnummer passeport pasaporte id ausweis identity identité identidad",
    "person": "name named mr mrs ms dr herr frau monsieur madame mme señor señora signed sincerely",
    "street": "address adresse dirección lives living wohnt habite vive street ship shipping",
}
CONTEXT |= {"written_email": CONTEXT["email"], "local_phone": CONTEXT["phone"]}
WORDS_OF = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
# Endings of domains, and first names and street words in the four languages.
ENDINGS = frozenset("com org net edu gov io info biz eu us uk de fr es it nl ch at be pt br mx ar ca au".split())
NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah anna peter hans klaus jürgen sabine ursula monika "
    "wolfgang jean marie pierre michel jacques nathalie isabelle françois sophie luc josé maría juan carmen antonio ana manuel pilar francisco lucía carlos laura emma paul martin maria".split()
)
STREETS = frozenset("street st avenue ave road rd lane ln drive dr boulevard blvd straße strasse weg platz allee rue chemin place calle avenida plaza paseo".split())
# Words that mark a number as something else.
OTHERWISE = frozenset("version v order invoice isbn issn rfc section chapter page pages total price eur usd token key hash commit build serial sku part no nr figure table".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_WRITTEN = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?[\[({<]\s?(?:at|arroba|arobase|ät)\s?[\])}>]\s?[\w-]{1,63}(?:\s?(?:\.|[\[({<]\s?(?:dot|punkt|point|punto)\s?[\])}>])\s?[\w-]{1,63}){1,4}", re.I)
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
_NATIONAL = re.compile(r"(?<![\w.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}|[0-9]{8}-?[A-Z])(?![\w-])")
_PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Mme|Señora?|name is|heiße|appelle|llamo)\b\.?\x20([A-ZÀ-Þ][\w'-]{1,30}\x20[A-ZÀ-Þ][\w'-]{1,30})")
_STREET = re.compile(r"(?<!\w)(?:[0-9]{1,5}\x20(?:[A-ZÀ-Þ][\w'-]{1,30}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd)\b|(?:[A-ZÀ-Þ][\w-]{1,30}(?:straße|strasse|weg|platz|allee)|(?:[Rr]ue|[Cc]alle|[Aa]venida)\x20(?:\w{1,20}\x20){0,3}[A-ZÀ-Þ][\w-]{1,30},?)\x20[0-9]{1,4}\b)")


def _small(digits: str, most: int) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= most


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def found(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes the kind's check) of all leftmost matches of the base patterns, in linear time: no run of characters is looked at again for each of its starts."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email", True))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        begin, groups = m.start(), m.group().split(".")
        for n in range(0, len(groups) - 3, 4):
            four = groups[n : n + 4]
            end = begin + sum(map(len, four)) + 3
            out.append((begin, end, "ip", all(_small(g, 255) for g in four)))
            begin = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            out.append((m.start(), m.end(), "card", 14 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        out.append((m.start(), m.end(), "phone", 10 <= len(_digits(m.group())) <= 15))
    return out


def _mod97(span: str) -> bool:
    text = span.replace(" ", "")
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _check(kind: str, span: str) -> int:
    """1 if the span passes a checksum or form of its kind, -1 if it fails, 0 where the kind has none."""
    if kind == "iban":
        return 1 if _mod97(span) else -1
    if kind == "national_id":
        d = _digits(span)
        if span[-1].isalpha():
            return 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == span[-1] else -1
        if "." in span:
            ok = all((sum(int(c) * w for c, w in zip(d, range(n + 1, 1, -1), strict=False)) * 10 % 11) % 10 == int(d[n]) for n in (9, 10))
            return 1 if ok and len(set(d)) > 1 else -1
        return 1 if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else -1
    if kind == "local_phone":
        d = _digits(span)
        return -1 if not 9 <= len(d) <= 12 or len(set(d)) < 3 else 0
    return 0


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """Base matches (passing or not) and the wider candidates that touch no passing base match, in order of start and kind."""
    out = found(text) if "@" in text or re.search(r"[0-9]", text) else []
    held = sorted((s, e) for s, e, _, ok in out if ok)
    more = []
    if "at" in text or "AT" in text or "arroba" in text or "arobase" in text or "ät" in text:
        if re.search(r"[\[({<]\s?(?:at|arroba|arobase|ät)\s?[\])}>]", text, re.I):
            more += [(m.start(), m.end(), "written_email") for m in _WRITTEN.finditer(text)]
    if out or re.search(r"[0-9]", text):
        more += [(m.start(), m.end(), k) for k, p in (("local_phone", _LOCAL_PHONE), ("iban", _IBAN), ("national_id", _NATIONAL), ("street", _STREET)) for m in p.finditer(text)]
    more += [(m.start(1), m.end(1), "person") for m in _PERSON.finditer(text)]
    starts = np.array([s for s, _ in held])
    reach = np.maximum.accumulate(np.array([e for _, e in held])) if held else starts
    for s, e, kind in more:
        n = int(np.searchsorted(starts, e, "left")) if held else 0
        if n == 0 or reach[n - 1] <= s:
            out.append((s, e, kind, False))
    return sorted(out, key=lambda c: (c[0], KINDS.index(c[2]), c[1]))


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    return [w.lower() for w in _WORD.findall(before)][-6:], [w.lower() for w in _WORD.findall(after)][:4]


def votes(text: str, start: int, end: int, kind: str, passes: bool) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing. Labelers: pattern, checksum, gazetteer, words before, words after, words that speak against it, repeated digits."""
    span = text[start:end]
    before, after = _around(text, start, end)
    d = _digits(span)
    pattern = (1 if passes else -1) if kind in BASE else 0
    check = (1 if passes else -1) if kind in ("card", "ip") else _check(kind, span)
    inside = [w.lower() for w in _WORD.findall(span)]
    gazetteer = 0
    if kind in ("email", "written_email"):
        gazetteer = 1 if inside and inside[-1].rpartition("-")[2] in ENDINGS else -1
    elif kind == "person":
        gazetteer = 1 if NAMES & set(inside) else 0
    elif kind == "street":
        gazetteer = 1 if STREETS & set(inside) or re.search(r"(?:straße|strasse|weg|platz|allee)\x20", span) else 0
    words = WORDS_OF[kind]
    against = -1 if OTHERWISE & set(before[-2:]) or (start and text[start - 1] in "#$€£=") else 0
    dull = -1 if kind in ("card", "phone", "local_phone", "national_id") and len(set(d)) < 3 else 0
    return pattern, check, gazetteer, (1 if words & set(before) else 0), (1 if words & set(after) else 0), against, dull


LABELERS = 7


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Numbers of the features that a span has: its kind, shape, length, the words around it and the characters beside it."""
    span = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 6)}", span))[:24]
    before, after = _around(text, start, end)
    told = [f"k {kind}", f"s {kind} {shape}", f"n {kind} {min(len(span) // 4, 8)}", f"c {kind} {_check(kind, span)}", f"l {text[start - 1] if start else ''}", f"r {text[end : end + 1]}"]
    told += [f"w {kind} {bool(WORDS_OF[kind] & set(before))}", f"a {kind} {bool(WORDS_OF[kind] & set(after))}", f"o {bool(OTHERWISE & set(before[-2:]))}"]
    told += [f"g {kind} {bool((NAMES | STREETS | ENDINGS) & {w.lower() for w in _WORD.findall(span)})}"]
    return sorted({zlib.crc32(t.encode()) % FEATURES for t in told})


CANDIDATE = "kind string, votes array<int>, features array<int>"


def _gathered(batches):
    for batch in batches:
        rows = [(k, votes(t, s, e, k, ok), features(t, s, e, k)) for t in (batch.column(0).to_pylist()) if t for s, e, k, ok in candidates(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([list(r[n]) for r in rows], pa.list_(pa.int32())) for n in (1, 2))], names=["kind", "votes", "features"])


class Labelers:
    """How often each labeler is right on personal and on other candidates, and how frequent personal ones are in each kind, from counted vote patterns."""

    def __init__(self, patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30):
        kinds = {k: n for n, k in enumerate(KINDS)}
        self.share = np.full(len(KINDS), 0.5)
        # A labeler starts better than a coin, as its author meant it: votes for are likelier on personal candidates, votes against on others.
        self.rates = np.tile(np.array([[0.1, 0.4, 0.5], [0.5, 0.4, 0.1]]), (LABELERS, 1, 1))
        if not patterns:
            return
        kind = np.array([kinds[k] for k, _, _ in patterns])
        vote = np.array([v for _, v, _ in patterns]) + 1
        n = np.array([c for _, _, c in patterns], np.float64)
        for _ in range(rounds):
            p = self._posterior(kind, vote)
            for k in range(len(KINDS)):
                at = kind == k
                if at.any():
                    self.share[k] = (n[at] @ p[at] + 1) / (n[at].sum() + 2)
            for j in range(LABELERS):
                for side, w in ((1, n * p), (0, n * (1 - p))):
                    told = np.bincount(vote[:, j], w, 3) + np.array([[0.1, 0.4, 0.5], [0.5, 0.4, 0.1]])[1 - side] * 4
                    self.rates[j, 1 - side] = told / told.sum()

    def _posterior(self, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        """Silence counts as well; row 0 of a labeler's rates is for personal candidates."""
        yes, no = np.log(self.share[kind]), np.log(1 - self.share[kind])
        for j in range(LABELERS):
            yes, no = yes + np.log(self.rates[j, 0, vote[:, j]]), no + np.log(self.rates[j, 1, vote[:, j]])
        return 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))

    def posterior(self, kind: str, vote: tuple[int, ...]) -> float:
        return float(self._posterior(np.array([KINDS.index(kind)]), np.array([vote]) + 1)[0])


def _learnt(rows: list[tuple[list[int], float, float]], steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant) on (features, posterior, weight), by full gradient steps."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        w[-1] = -10
        return w
    x = np.zeros((len(rows), FEATURES + 1))
    for n, (f, _, _) in enumerate(rows):
        x[n, f] = 1
    x[:, -1] = 1
    y, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    weight, momentum = weight / weight.sum(), np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        momentum = 0.9 * momentum + x.T @ (weight * (p - y)) + 1e-5 * w
        w = w - 2.0 * momentum
    return w


def fit(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The span classifier's weights: votes of all candidates counted by pattern, reliabilities from the counts, then at most about `fit_rows` candidates to learn from, drawn by hash from each pattern."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    held = scratch.keep(docs.select(F.col(text_col).cast("string")).mapInArrow(_gathered, CANDIDATE))
    # At most kinds times three to the number of labelers; a handful in practice.
    patterns = [(r.kind, tuple(r.votes), r.n) for r in held.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    labelers = Labelers(sorted(patterns))
    kept = scratch.keep(held.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")))
    share = max(1, fit_rows // max(1, len(patterns)))
    distinct = {(r.kind, tuple(r.votes)): r.n for r in kept.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    rows = []
    if distinct:
        limits = spark.createDataFrame([(k, list(v), min(2**31 - 1, int(2**31 * share / n))) for (k, v), n in distinct.items()], "kind string, votes array<int>, below long")
        drawn = kept.join(F.broadcast(limits), ["kind", "votes"]).filter(F.pmod(F.xxhash64("features"), F.lit(2**31)) <= F.col("below")).collect()
        rows = sorted((list(r.features), labelers.posterior(r.kind, tuple(r.votes)), float(np.sqrt(r.n))) for r in drawn)
    scratch.drop()
    return _learnt(rows)


def spans(text: str | None, weights: np.ndarray) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) of a text: the base spans, and the wider candidates of which the classifier is sure; of those that overlap the one scored highest, then the first."""
    every = candidates(text) if text else []
    out = [c for c in every if c[3]]
    sure, taken = [], []
    for s, e, kind, _ in (c for c in every if c[2] in ADDED):
        score = 1 / (1 + np.exp(-np.clip(weights[features(text, s, e, kind)].sum() + weights[-1], -30, 30)))
        if score >= SURE:
            sure.append((-score, s, e, kind))
    for _, s, e, kind in sorted(sure):
        n = bisect.bisect_left(taken, (s, e))
        if (n == 0 or taken[n - 1][1] <= s) and (n == len(taken) or e <= taken[n][0]):
            taken.insert(n, (s, e))
            out.append((s, e, kind, False))
    return sorted(out, key=lambda c: (c[0], KINDS.index(c[2])))


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _judged(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                every = spans(text, weights)
                base = [c for c in every if c[3]]
                told = [",".join(f"{k}:{s}:{e}" for s, e, k, _ in part) for part in (base, every)]
                out.append((*(sum(c[2] == k for c in base) for k in BASE), hashlib.sha256(told[0].encode()).hexdigest(), told[1]))
            cols = [pa.array([r[n] for r in out], pa.int64() if n < 4 else pa.string()) for n in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", *(c.split()[0] for c in RESULT.split(", "))])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Personal data in every whole text: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    The counts and base_sha256 are those of the base patterns; spans (kind:start:end, code points, end exclusive, by start, then kind) also holds what the method adds, under kinds of its own.
    Null and empty texts have no spans. Rows are judged one by one, so null and repeated ids and repeated rows don't matter; texts of any length are searched whole, in linear
    time. Without any candidate in the corpus nothing is added. Other columns are left out. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    weights = fit(docs, text_col, fit_rows)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_judged(weights), f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with every span of personal data replaced by its kind in square brackets; null texts stay null, all other columns and rows stay as they are."""
    small_batches(docs.sparkSession)
    weights = fit(docs, text_col, fit_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                last, parts = 0, []
                for s, e, kind, _ in spans(text, weights):
                    if s >= last:
                        parts += [text[last:s], f"[{kind}]"]
                    last = max(last, e)
                out.append(None if text is None else "".join(parts) + text[last:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == at else c for n, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
