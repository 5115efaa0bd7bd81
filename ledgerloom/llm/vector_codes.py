"""Codes of vectors by parts: Lloyd's rounds in integers, with Hamerly's two bounds per part kept between rounds.

Every part of every row keeps the distance to its entry from above and to its second-nearest entry from below. A round adds to the one how far the entry moved, and takes from the other how
far any other entry moved. While the upper bound is strictly smaller than the lower one, or than half the way to the entry's nearest neighbour, the entry stays, with no other at
the same distance; only else are all entries compared, in integers, the lower index first among equals. Bounds are rounded away from each other, so they never decide wrongly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .vectors import product, scaled, usable

#: Rows of one label that one task takes when label sums are joined back.
PART = 1_000_000
STATE = "id long, label {label}, q array<int>, code binary, upper binary, lower binary, error long, scanned int"
SUMS = "part int, entry int, pos int, total long, n long"


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """A list column of equal lengths as rows x parts x width."""
    ends = np.asarray(column.offsets)
    values = np.asarray(column.values)[ends[0] : ends[-1]].astype(np.int64)
    n = len(column)
    out = np.zeros((n, parts * width), np.int64)
    if n:
        out[:, : len(values) // n] = values.reshape(n, -1)
    return out.reshape(n, parts, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact."""
    return (x * x).sum(1)[:, None] - 2 * product(x, entries) + (entries * entries).sum(1)[None, :]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


class Codebook:
    """Entries (parts x entries x width) and what the bounds need of them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        between = np.stack([distances(e, e) for e in entries]).astype(np.float64)
        between[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
        self.half = _down(np.sqrt(between.min(2)) / 2)
        if before is not None:
            self.moved = _up(np.sqrt(((entries - before) ** 2).sum(2).astype(np.float64)))
            first = self.moved.argmax(1)
            rest = self.moved.copy()
            rest[np.arange(len(rest)), first] = 0
            #: How far the farthest other entry moved, for each entry.
            self.others = np.repeat(self.moved.max(1)[:, None], entries.shape[1], 1)
            self.others[np.arange(len(rest)), first] = rest.max(1)

    def scan(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, squared distance, lower bound to all others) by comparing all entries of part p."""
        d = distances(x, self.entries[p])
        code = d.argmin(1)  # the first among equals
        at = np.arange(len(x))
        error = d[at, code]
        if d.shape[1] == 1:
            return code, error, np.full(len(x), np.inf, np.float32)
        d = d.astype(np.float64)
        d[at, code] = np.inf
        return code, error, _down(np.sqrt(d.min(1)))

    def assign(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        """(code, upper, lower, squared distances, parts scanned) of rows x parts."""
        n, parts = x.shape[:2]
        code, upper, lower = state if state else (np.zeros((n, parts), np.int64), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts), np.float32))
        scanned, error = np.zeros(n, np.int64), np.zeros((n, parts), np.int64)
        for p in range(parts):
            open_ = np.ones(n, bool)
            if state:
                upper[:, p] = _up(upper[:, p] + self.moved[p, code[:, p]].astype(np.float64))
                lower[:, p] = _down(lower[:, p] - self.others[p, code[:, p]].astype(np.float64))
                limit = np.maximum(lower[:, p], self.half[p, code[:, p]])
                open_ = ~(upper[:, p] < limit)
                near = np.flatnonzero(open_)
                exact = ((x[near, p] - self.entries[p, code[near, p]]) ** 2).sum(1)
                upper[near, p] = _up(np.sqrt(exact.astype(np.float64)))
                open_[near] = ~(upper[near, p] < limit[near])
            at = np.flatnonzero(open_)
            if len(at):
                code[at, p], found, lower[at, p] = self.scan(x[at, p], p)
                upper[at, p] = _up(np.sqrt(found.astype(np.float64)))
                scanned[at] += 1
            error[:, p] = ((x[:, p] - self.entries[p, code[:, p]]) ** 2).sum(1)
        return code, upper, lower, error, scanned

    def sha256(self, length: int) -> str:
        """All entries' components in order of part, entry and position; positions beyond the vectors' length are left out."""
        parts, _, width = self.entries.shape
        told = (str(v) for p in range(parts) for e in self.entries[p] for v in e[: max(0, min(width, length - p * width))])
        return hashlib.sha256(",".join(told).encode()).hexdigest()


def _assigned(book: Codebook):
    parts, _, width = book.entries.shape

    def run(batches):
        for batch in batches:
            x, n = _parts(batch.column("q"), parts, width), batch.num_rows
            state = None
            if "code" in batch.schema.names:
                held = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, parts) for c, t in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))]
                state = held[0].astype(np.int64), held[1].copy(), held[2].copy()
            code, upper, lower, error, scanned = book.assign(x, state)
            rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            out = [batch.column("id"), batch.column("label"), batch.column("q"), rows(code.astype(np.uint8)), rows(upper), rows(lower), pa.array(error.sum(1)), pa.array(scanned.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "label", "q", "code", "upper", "lower", "error", "scanned"])

    return run


def _sums(shape: tuple[int, int, int]):
    """Per task: sums of components and numbers of parts for every entry."""
    parts, entries, width = shape

    def run(batches):
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _parts(batch.column("q"), parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            at = (code + np.arange(parts) * entries).ravel()
            np.add.at(total, at, x.reshape(-1, width))
            n += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(n)
        flat = np.repeat(used, width)
        cols = [flat // entries, flat % entries, np.tile(np.arange(width), len(used)), total[used].ravel(), np.repeat(n[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int32, np.int64, np.int64), strict=True)], names=["part", "entry", "pos", "total", "n"])

    return run


def vector_codes(
    rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """Codes of all usable vectors: (id, code, error, label_error, codebooks_sha256, scanned).

    Components are scaled by 256 and rounded down, vectors cut into `parts` consecutive parts (the last filled with zeros where the length isn't a multiple). The codebooks start as
    the parts of the rows with the `entries` (256 at most) smallest ids, rows of one id in the order of their vectors, null ids last; each round assigns all parts and replaces each
    entry by the mean of its parts, rounded down. code holds two hex digits per part, error the sum of squared distances, label_error its sum over equal labels (nulls together), scanned the number of parts for
    which the last assignment had to compare all entries.
    Rows with a null vector or a null, non-finite or huge (2**18) component are dropped. Repeated rows are coded alike. The length of the smallest id's vector is the table's; rows of
    another length stay with a null code and error. With fewer rows than entries the codebooks are smaller. Other columns are left out. An empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    label_type = rows.schema[label_col].dataType.simpleString()
    usable_rows = rows.filter(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), scaled(rows, vec_col).alias("q"))
    source = Scratch(spark)
    kept = source.keep(usable_rows)
    first = kept.orderBy(F.asc_nulls_last("id"), "q").limit(1).collect()
    length = len(first[0].q) if first else 0
    width = max(1, math.ceil(length / parts))
    fits, state_type = kept.filter(F.size("q") == length), STATE.format(label=label_type)
    start = fits.orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
    book = np.zeros((max(len(start), 1), parts * width), np.int64)
    for n, r in enumerate(start):
        book[n, :length] = r.q
    codebook, state, held = Codebook(book.reshape(-1, parts, width).swapaxes(0, 1)), fits, None
    for _ in range(rounds):
        scratch = Scratch(spark)
        state = scratch.keep(state.mapInArrow(_assigned(codebook), state_type))
        if held:
            held.drop()
        held = scratch
        fresh, shape = codebook.entries.copy(), codebook.entries.shape
        # One row per component of the codebooks, however many rows there are.
        for r in state.select("q", "code").mapInArrow(_sums(shape), SUMS).groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            fresh[r.part, r.entry, r.pos] = r.total // r.n
        codebook = Codebook(fresh, codebook.entries)
    result = Scratch(spark)
    coded = state.mapInArrow(_assigned(codebook), state_type).select("id", "label", F.lower(F.hex("code")).alias("code"), "error", "scanned")
    odd = kept.filter(F.size("q") != length).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("int").alias("scanned"))
    coded = result.keep(coded.unionByName(odd))
    source.drop()
    if held:
        held.drop()
    sums = result.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    salts = max(1, math.ceil((sums.agg(F.max("n")).first()[0] or 0) / PART))
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = coded.withColumn("of_salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
    joined = dealt.join(salted, dealt.label.eqNullSafe(salted.of) & (dealt.of_salt == salted.salt))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebook.sha256(length)).alias("codebooks_sha256"), "scanned")
