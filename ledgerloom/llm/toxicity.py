"""Toxicity by a weighted finite-state grammar over clauses.

Words fall into classes: insult, threat, target, negation, reported speech, family, other. Transducers for reported speech, negation and
target each add a mark to the insults and threats that they govern; two of them read a clause forwards and one reads it backwards, and their
composition turns a clause into the pattern of each insult and threat: plain, aimed, quoted (negated or reported), a threat at someone, or an idle one.
A document's score is a logistic function of its patterns. Weights keep the order of the grammar: aiming adds, a threat at someone weighs no
less than an insult, quoted insults and idle threats weigh little, and one plain insult suffices for the threshold.

Besides a fixed list of insults, whole words and stems are learnt from labels. A stem is a family of inflected forms; as any word may begin with it by chance, a family
speaks only in texts that hold several of its forms densely.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches

# Word lists of the grammar.
INSULTS = ["bastard", "clown", "disgusting", "dumbass", "idiot", "idiotic", "idiots", "imbecile", "jackass", "loser", "losers", "lowlife", "moron", "moronic", "morons", "pathetic", "retard", "scum", "scumbag", "stupid", "trash", "vermin", "worthless"]
THREATS = ["hurt", "kill", "murder", "slaughter", "strangle", "umbringen", "töten", "tuer", "matar"]
TARGETS = ["you", "your", "you're", "yourself", "u", "they", "them", "he", "she", "him", "her", "du", "dich", "ihr", "tu", "toi", "vous", "usted", "ustedes"]
NEGATIONS = ["not", "never", "no", "isn't", "aren't", "wasn't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"]
REPORTED = ["said", "says", "called", "calls", "wrote", "quoted", "claimed", "alleged", "sagte", "dit", "dijo"]

#: Words after a negation, after a target and before a target that they govern.
NEGATION_REACH, TARGET_REACH, TARGET_AHEAD = 3, 4, 2
PATTERNS = ("plain", "aimed", "quoted", "threat", "idle", "family")
#: Weights before any label is seen: base, then insults (plain and aimed), what aiming adds, quoted ones, threats, idle threats, family forms after the first.
PRIOR = np.array([-3.0, 6.0, 2.0, 0.8, 6.5, 0.8, 6.0])
#: Score that one plain insult reaches at least, and share of an insult's weight that quoted insults and idle threats reach at most.
LEAST, FAINT = 0.72, 0.15
#: Labelled rows that words, stems and weights are learnt from, at most; near copies among them count once.
SAMPLE = 8000
#: Toxic texts that a learnt word or stem needs, and the largest share of clean ones among its texts.
WORD_SUPPORT, WORD_CLEAN, STEM_SUPPORT, STEM_CLEAN = 6, 0.05, 3, 0.1
#: Share of toxic texts among those with any form of a learnt stem.
STEM_TOXIC = 0.3
#: A text holds a family if it has so many forms of it and one for so many words at least; letters of a stem.
FORMS, WORDS_A_FORM, STEMS = 2, 150, (3, 4, 5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;:,\n]+")


def marker(mark: str, trigger: str, reach: int | None, once: bool = False):
    """A transducer that marks insults (I) and threats (T) among the `reach` words after a trigger class (None: all to the clause's end), or only the first of them."""

    def step(state: int, symbol: str) -> tuple[int, str]:
        if symbol == trigger:
            return (reach or 1), ""
        governed = symbol in "IT" and state > 0
        left = state if reach is None else max(state - 1, 0)
        return (0 if governed and once else left), mark if governed else ""

    return step


def compose(*machines) -> dict:
    """The product of deterministic transducers: (states, symbol) -> (states, marks), built from the reachable states."""
    start = (0,) * len(machines)
    table, todo = {}, [start]
    while todo:
        states = todo.pop()
        if (states, "O") in table:
            continue
        for symbol in "OITYNR":
            moves = [m(s, symbol) for m, s in zip(machines, states, strict=True)]
            table[states, symbol] = (tuple(s for s, _ in moves), "".join(x for _, x in moves))
            todo.append(table[states, symbol][0])
    return table


FORWARDS = compose(marker("q", "R", None), marker("q", "N", NEGATION_REACH, once=True), marker("y", "Y", TARGET_REACH))
BACKWARDS = compose(marker("y", "Y", TARGET_AHEAD))


def patterns(symbols: str) -> list[str]:
    """The pattern of each insult and threat of a clause, in order, given the classes of its words."""
    found, state = [], (0, 0, 0)
    for i, symbol in enumerate(symbols):
        state, marks = FORWARDS[state, symbol]
        if symbol in "IT":
            found.append((i, symbol, marks))
    ahead, state = {}, (0,)
    for i in range(len(symbols) - 1, -1, -1):
        state, marks = BACKWARDS[state, symbols[i]]
        ahead[i] = marks
    out = []
    for i, symbol, marks in found:
        aimed = "y" in (ahead[i] if symbol == "T" else marks + ahead[i])
        out.append(("idle" if symbol == "T" else "quoted") if "q" in marks else ("threat" if aimed else "idle") if symbol == "T" else "aimed" if aimed else "plain")
    return out


class Matcher:
    """Counts the patterns of texts. learnt: words that insult, and stems of families, which end in a hyphen."""

    def __init__(self, learnt: list[str]):
        import ahocorasick

        self.stems = {s[:-1] for s in learnt if s.endswith("-")}
        insults = {*INSULTS, *(w for w in learnt if not w.endswith("-"))}
        self.classes = {w: c for c, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTED), ("T", THREATS), ("I", insults)) for w in words}
        self.finder = ahocorasick.Automaton()
        for word in {*insults, *THREATS, *self.stems}:
            self.finder.add_word(word, (len(word), word in self.classes and word not in self.stems))
        self.finder.make_automaton()

    def counts(self, text: str) -> list[int]:
        low, out = text.lower(), dict.fromkeys(PATTERNS, 0)
        for end, (n, whole) in self.finder.iter(low):
            first = end - n + 1
            if (not first or not low[first - 1].isalpha()) and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                break
        else:
            return [0] * len(PATTERNS)
        forms, words = set(), 0
        for clause in _CLAUSE.split(low):
            said = _WORD.findall(clause)
            words += len(said)
            for pattern in patterns("".join([self.classes.get(w, "O") for w in said])):
                out[pattern] += 1
            forms.update(w for w in said if any(len(w) > n and w[:n] in self.stems for n in STEMS))
        if len(forms) >= FORMS and len(forms) * WORDS_A_FORM >= words:
            out["family"] = len(forms)
        return list(out.values())


def features(counts: np.ndarray) -> np.ndarray:
    """What the weights apply to, from rows of pattern counts."""
    plain, aimed, quoted, threat, idle, family = np.asarray(counts, float).reshape(-1, len(PATTERNS)).T
    return np.column_stack([np.ones(len(plain)), *map(np.log1p, (plain + aimed, aimed, quoted, threat, idle, np.maximum(family - 1, 0)))])


def _evidence(batches):
    """(word or stem, signature, toxic) of every text: its words, and with a hyphen the stems of which it holds a family. Texts that share their least word hash are mostly near copies."""
    for batch in batches:
        names, signs, bad = [], [], []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            said = _WORD.findall((text.as_py() or "").lower())
            words, forms = set(said), {}
            for w in words:
                for n in STEMS:
                    if len(w) > n:
                        forms[w[:n]] = forms.get(w[:n], 0) + 1
            held = [w for w in words if len(w) > 2] + [s + "-" for s, n in forms.items() if n >= FORMS and n * WORDS_A_FORM >= len(said)]
            names += held
            signs += [min((zlib.crc32(w.encode()) for w in words), default=0)] * len(held)
            bad += [toxic] * len(held)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(signs, pa.int64()), pa.array(bad, pa.int32())], names=["name", "sign", "toxic"])


def _touched(stems: list[str]):
    """(stem, toxic) for every text that holds any form of a stem."""

    def run(batches):
        for batch in batches:
            names, bad = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                held = [s for s in stems if any(len(w) > len(s) and w.startswith(s) for w in words)]
                names += held
                bad += [toxic] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bad, pa.int32())], names=["name", "toxic"])

    return run


def _counted(learnt: list[str]):
    def run(batches):
        matcher = Matcher(learnt)
        for batch in batches:
            rows = np.array([matcher.counts(t.as_py() or "") for t in batch.column(1)], np.int32).reshape(-1, len(PATTERNS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], names=["id", *PATTERNS])

    return run


def distinct_stems(stems: dict[str, int]) -> list[str]:
    """Of stems that begin one another the one with most texts, of equal ones the longest. stems: stem -> toxic texts."""
    kept: list[str] = []
    for s in sorted(stems, key=lambda s: (-stems[s], -len(s), s)):
        if not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept.append(s)
    return kept


def ordered(w: np.ndarray) -> np.ndarray:
    """The nearest weights that keep the order of the grammar."""
    w = w.copy()
    w[0] = min(w[0], -2.0)
    enough = (np.log(LEAST / (1 - LEAST)) - w[0]) / np.log(2)
    w[1], w[2], w[6] = max(w[1], enough), max(w[2], 0.5), max(w[6], enough)
    w[4] = max(w[4], w[1])
    w[3], w[5] = np.clip(w[[3, 5]], 0, FAINT * w[1])
    return w


def fit_weights(rows: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """Newton steps, halved until they help, of a logistic regression drawn towards PRIOR, then put in order. rows: (pattern counts, label, how often)."""
    w = PRIOR.copy()
    if rows:
        x = features(np.array([r[0] for r in rows]))
        y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        loss = lambda v: (n * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + ((v - PRIOR) ** 2).sum() / 2
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (p - y)) + (w - PRIOR)
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
    return ordered(w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(learnt words and stems, weights) from at most SAMPLE labelled ids, taken in the order of a hash of the id, one row of each; none from held-out rows.

    Support is counted and filtered in Spark; only words and stems that qualify and the counts of pattern rows reach the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("id")))
    sample = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(sample), "id")
    one = rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = scratch.keep(one.select("toxic", "text").repartition(max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    seen = rows.mapInArrow(_evidence, "name string, sign long, toxic int").groupBy("name", "sign").agg(F.max("toxic").alias("toxic")).groupBy("name").agg(F.sum("toxic").cast("int").alias("bad"), F.count("*").cast("int").alias("n"))
    stem = F.col("name").endswith("-")
    enough = F.when(stem, (F.col("bad") >= STEM_SUPPORT) & (F.col("n") - F.col("bad") <= STEM_CLEAN * F.col("n"))).otherwise((F.col("bad") >= WORD_SUPPORT) & (F.col("n") - F.col("bad") <= WORD_CLEAN * F.col("n")))
    found = {r.name: r.bad for r in seen.filter(enough).collect()}
    stems = distinct_stems({s[:-1]: n for s, n in found.items() if s.endswith("-")})
    share = rows.mapInArrow(_touched(stems), "name string, toxic int").groupBy("name").agg(F.avg("toxic").alias("share"))
    stems = sorted(r.name for r in share.filter(F.col("share") >= STEM_TOXIC).collect())
    learnt = sorted(w for w in found if not w.endswith("-") and not w.startswith(tuple(stems))) + [s + "-" for s in stems]
    counted = rows.mapInArrow(_counted(learnt), "id int, " + ", ".join(f"{p} int" for p in PATTERNS)).groupBy("id", *PATTERNS).count()
    weights = fit_weights([(np.array(r[1:-1]), r[0], r[-1]) for r in counted.orderBy("id", *PATTERNS).collect()])
    scratch.drop()
    return learnt, weights


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score every text from 0 to 1.

    Returns (id, held_out, score, predicted) and the count of each clause pattern, one row per row of docs, repeated rows too. Null and empty texts match nothing and get the base score; labels
    that are null are left out; without labels the prior weights hold; a null id is not held out; texts of any length are read whole; an empty table gives no rows.
    """
    out = scores(docs, *fit(docs, labels, id_col, text_col), id_col, text_col, threshold)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted", *PATTERNS)


def scores(docs: DataFrame, learnt: list[str], w: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) and the count of each clause pattern per row, by what fit() gives."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInArrow(_counted(learnt), "id long, " + ", ".join(f"{p} int" for p in PATTERNS))
    parts = (F.col("plain") + F.col("aimed"), F.col("aimed"), F.col("quoted"), F.col("threat"), F.col("idle"), F.greatest(F.col("family") - 1, F.lit(0)))
    total = F.lit(float(w[0]))
    for part, weight in zip(parts, w[1:], strict=True):
        total = total + float(weight) * F.log1p(part)
    score = F.round(1 / (1 + F.exp(-total)), 9)
    return rows.select(F.col("id").alias(id_col), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *PATTERNS)


def mild_rows(docs: DataFrame, learnt: list[str], w: np.ndarray, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score lies below the threshold, in one pass."""
    place = docs.columns.index(text_col)

    def run(batches):
        matcher = Matcher(learnt)
        for batch in batches:
            counts = np.array([matcher.counts(t.as_py() or "") for t in batch.column(place)], np.int32).reshape(-1, len(PATTERNS))
            score = np.round(1 / (1 + np.exp(-features(counts) @ w)), 9)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
