"""Helpers shared by the corpus operators: table access, shared scratch space and vectorised hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import Scratch, cut

__all__ = ["CHUNK_BYTES", "Scratch", "Shingler", "WordHasher", "chunks", "cut", "each_chunk", "held_out", "mix", "small_batches", "stream", "table", "text_bytes", "written"]

#: Bytes of text that one vectorised step handles at a time inside a task.
CHUNK_BYTES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 500 rows and 8 MB, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


written = cut


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model may learn from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 on an array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % 2**64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of about `limit` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class WordHasher:
    """Hashes of all words in a byte buffer at once.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's blocks of eight bytes are mixed in one after the other, each step a bijection of the block, so words of one length of up to
    eight bytes never share a hash and no sum or product of letters makes longer ones meet; words of more than LONG bytes take a cryptographic digest. Another seed gives independent hashes.
    """

    LONG = 64

    def __init__(self, seed: int = 0):
        self._key, self._steps = stream(2, 11 + seed), stream(self.LONG // 8, 13 + seed)
        self._lower = np.arange(256, dtype=np.uint8)
        self._lower[65:91] += 32
        self._space = np.zeros(256, bool)
        self._space[[9, 10, 11, 12, 13, 32]] = True
        self._digest_key = self._key.tobytes()
        #: Bits of a block that belong to a word of which so many bytes are left.
        self._bits = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, n+1 offsets of the rows into those hashes)."""
        if not len(raw):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        space = self._space[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        solid = ~space
        starts = np.flatnonzero(solid & np.concatenate(([True], space[:-1] | edge[1:-1])))
        ends = np.flatnonzero(solid & np.concatenate((space[1:] | edge[1:-1], [True]))) + 1
        lower = np.concatenate((self._lower[raw], np.zeros(8, np.uint8)))
        lengths = ends - starts
        # Every eight bytes in a row as one number.
        blocks = np.lib.stride_tricks.as_strided(lower[:8].view(np.uint64), (len(raw) + 1,), (1,)) if len(lower) >= 8 else None
        hashes = mix(lengths.astype(np.uint64) * self._key[1] + self._key[0])
        open_ = np.flatnonzero(lengths <= self.LONG)
        for k, step in enumerate(self._steps):
            open_ = open_[lengths[open_] > 8 * k] if k else open_
            if not len(open_):
                break
            block = blocks[starts[open_] + 8 * k] & self._bits[np.minimum(lengths[open_] - 8 * k, 8)]
            hashes[open_] = mix((hashes[open_] ^ block) + step)
        for i in np.flatnonzero(lengths > self.LONG):
            digest = hashlib.blake2b(lower[starts[i] : ends[i]].tobytes(), digest_size=8, key=self._digest_key)
            hashes[i] = int.from_bytes(digest.digest(), "little")
        return hashes, np.searchsorted(starts, offsets).astype(np.int64)


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes.

    A text with fewer words than the shingle is long gives its whole sequence as one; a text without words gives none.
    """

    def __init__(self, size: int, seed: int = 0):
        self.size, self._words, self._salts = size, WordHasher(seed), stream(size + 1, 23 + seed) | np.uint64(1)

    def sets(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        hashes, at = self._words.words(raw, offsets)
        k, out = self.size, []
        grams = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
        for j in range(k if len(grams) else 0):
            grams += hashes[j : j + len(grams)] * self._salts[j]
        grams = mix(grams)
        for first, last in zip(at[:-1], at[1:], strict=True):
            n = last - first
            if n >= k:
                out.append(np.unique(grams[first : last - k + 1]))
            elif n:
                out.append(mix((hashes[first:last] * self._salts[:n]).sum(dtype=np.uint64, keepdims=True) + self._salts[k : k + 1] * np.uint64(n)))
            else:
                out.append(grams[:0])
        return out


def each_chunk(column: pa.Array):
    """(first row, last row, bytes, offsets) of pieces of a text column."""
    raw, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
