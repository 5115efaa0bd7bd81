"""Exact deduplication through counting quotient filters.

Each partition builds one filter per block of the fingerprint space: a fingerprint splits into quotient and remainder, the
remainders of a quotient form a sorted run, and runs are laid out in slots found from an occupied bit per quotient
and a run-end bit per slot, with a count in each slot. As the runs are sorted, filters of the same block merge without loss. Fingerprints
with a count above one send their rows to byte-for-byte comparison; all other rows are unique for certain.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Fingerprints that a block of the merged filter holds on average.
PER_BLOCK = 50_000
#: Rows of one fingerprint that one task takes; a larger group of copies is dealt to as many parts as its count in the filter asks for.
PART = 5_000


class CountingQuotientFilter:
    """A filter over 64-bit fingerprints that share their top `block_bits` bits; `quotient_bits` bits follow."""

    def __init__(self, block: int, block_bits: int, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.block, self.block_bits, self.quotient_bits = block, block_bits, quotient_bits
        self.occupied, self.run_ends, self.remainders, self.counts = occupied, run_ends, remainders, counts

    @classmethod
    def build(cls, block: int, block_bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """fingerprints: sorted and distinct."""
        n = len(fingerprints)
        quotient_bits = max(1, math.ceil(math.log2(max(n, 1) / 0.75)))
        shift = np.uint64(64 - block_bits - quotient_bits)
        quotients = ((fingerprints >> shift) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
        # A slot is the quotient or the one after the slot before it, whichever is later.
        order = np.arange(n)
        slots = np.maximum.accumulate(quotients - order) + order
        size = max(1 << quotient_bits, int(slots[-1]) + 1 if n else 0)
        occupied, run_ends = np.zeros(1 << quotient_bits, bool), np.zeros(size, bool)
        remainders, held = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied[quotients] = True
        if n:
            run_ends[slots[np.append(quotients[1:] != quotients[:-1], True)]] = True
        remainders[slots], held[slots] = fingerprints & np.uint64((1 << int(shift)) - 1), counts
        return cls(block, block_bits, quotient_bits, occupied, run_ends, remainders, held)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts: the k-th run belongs to the k-th occupied quotient."""
        used = np.flatnonzero(self.counts)
        runs = np.cumsum(self.run_ends[used]) - self.run_ends[used]
        quotients = np.flatnonzero(self.occupied)[runs].astype(np.uint64) if len(used) else np.zeros(0, np.uint64)
        shift = 64 - self.block_bits - self.quotient_bits
        top = np.uint64((self.block << (64 - self.block_bits)) if self.block_bits else 0)
        return top | (quotients << np.uint64(shift)) | self.remainders[used], self.counts[used]

    def row(self) -> tuple:
        return self.block, self.quotient_bits, len(self.run_ends), np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def of_row(cls, block_bits: int, block: int, quotient_bits: int, size: int, occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        bits = lambda b, n: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        return cls(block, block_bits, quotient_bits, bits(occupied, 1 << quotient_bits), bits(run_ends, size), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64))


FILTER = "block long, quotient_bits int, slots long, occupied binary, run_ends binary, remainders binary, counts binary"


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    if not len(prints):
        return prints, counts
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _build(block_bits: int):
    names = [c.split()[0] for c in FILTER.split(", ")]

    def run(batches):
        held, fresh, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            fresh.append(np.asarray(batch.column(0)).view(np.uint64))
            waiting += batch.num_rows
            if waiting > max(500_000, len(held[0])):
                new = np.concatenate(fresh)
                held = _summed(np.concatenate((held[0], new)), np.concatenate((held[1], np.ones(len(new), np.int64))))
                fresh, waiting = [], 0
        new = np.concatenate([np.zeros(0, np.uint64), *fresh])
        prints, counts = _summed(np.concatenate((held[0], new)), np.concatenate((held[1], np.ones(len(new), np.int64))))
        if len(prints):
            blocks = (prints >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(prints), np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(prints))
            rows = [CountingQuotientFilter.build(int(blocks[a]), block_bits, prints[a:b], counts[a:b]).row() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=names)

    return run


def _merge(block_bits: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        lists = [CountingQuotientFilter.of_row(block_bits, *r).entries() for r in parts.itertuples(index=False)]
        prints, counts = _summed(np.concatenate([p for p, _ in lists]), np.concatenate([c for _, c in lists]))
        merged = CountingQuotientFilter.build(int(parts.block.iloc[0]), block_bits, prints, counts)
        prints, counts = merged.entries()
        many = counts > 1
        return pd.DataFrame({"fp": prints[many].view(np.int64), "seen": counts[many]})

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows with byte-identical texts.

    Returns (id, keep_id, group_size, kept, text_sha256) per row. Null texts count as empty. Of equal texts the largest id stays.
    Rows that repeat an id and text are all marked alike; rows with a null id stay only where no row of their group has an id, and then all of
    them do. Texts of any length are compared whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    block_bits = max(0, math.ceil(math.log2(max(docs.count(), 1) / PER_BLOCK)))
    parts = source.select("fp").mapInArrow(_build(block_bits), FILTER)
    routed = cut(parts.groupBy("block").applyInPandas(_merge(block_bits), "fp long, seen long").withColumn("parts", F.ceil(F.col("seen") / PART)))
    large = routed.filter("parts > 1").select("fp", F.col("parts").alias("of"))
    # By row, so that copies without an id, or with one id, are dealt out as well; any part finds its group.
    salted = source.join(large, "fp", "left").withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("of", F.lit(1)))).drop("of")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")
    compared = salted.join(routed.select("fp", every), ["fp", "salt"], "left_semi").groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(compared.filter("group_size > 1").select("fp", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))
    groups = groups.join(routed.select("fp", "parts"), "fp").select("fp", "sha", "keep_id", "group_size", every)
    narrow = salted.select("id", "fp", "salt", F.sha2("text", 256).alias("sha"))
    out = narrow.join(groups, ["fp", "sha", "salt"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
