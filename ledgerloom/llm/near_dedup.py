"""MinHash near-duplicate detection whose candidates are checked with odd sketches before exact verification.

Every text becomes a set of word shingles. Texts with the same set form one class. Of each class, MinHash values
are cut into bands; classes that share a band value are candidates. The MinHash sample is also folded into an odd
sketch, a bitmap holding the parity of how many samples fall on each bit: the XOR of two sketches holds the parity of
the samples' symmetric difference, so its population count estimates high similarities closely. Candidates within
five standard deviations of the threshold are verified on their full sets. A second bitmap folds the whole set in the same way: its XOR never has more
bits than the sets' symmetric difference has members, so more bits than the threshold allows rule a pair out for certain.

To avoid all pairs within a bucket, each class is first linked to the best-matching bucket leader, then to the best of other leaders;
only buckets that still hold several components are searched for links between different components, block by block, and only pairs that pass both bitmap tests leave a block.

Texts are read twice: once for the MinHash values, once to pick those that share a bucket with another class; only these are ever shuffled, and a leader with many followers is dealt to several tasks with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Shingler, each_chunk, mix, small_batches, stream
from .components import components

#: At similarity 0.8 one pair in 20 million shares none of 32 bands of 4 values.
BANDS, ROWS = 32, 4
SKETCH_WORDS, PARITY_WORDS = 8, 32  # of 64 bits
#: Rows of a block when a large bucket is compared block by block; followers of a leader that one task takes.
BLOCK, FOLLOWERS = 2000, 500
#: Standard deviations of the estimate (samples and sketch) that a candidate may lie below the threshold.
SLACK = 5


def _folded(spots: np.ndarray, rows: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n bitmaps with the parity of how often each spot of a row occurs."""
    parity = np.bincount((spots + rows * np.uint64(bits)).astype(np.int64).ravel(), minlength=n * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(-1, bits), axis=1).view(np.uint64)


def _features(size: int):
    samples = BANDS * ROWS
    factors, offsets = stream(samples, 31) | np.uint64(1), stream(samples, 37)
    salts = stream(BANDS, 41)[:, None]
    bits = SKETCH_WORDS * 64

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            columns = [[], [], [], [], []]
            for _, _, raw, at in each_chunk(batch.column(1)):
                sets = shingler.sets(raw, at)
                counts = np.array([len(s) for s in sets], np.int64)
                n, full = len(sets), np.flatnonzero(counts)
                bands, sketch = (np.zeros((n, w), np.uint64) for w in (BANDS, SKETCH_WORDS))
                sums = np.zeros((n, 2), np.uint64)
                if len(full):
                    shingles = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                    least = np.empty((samples, len(full)), np.uint64)
                    for j in range(samples):
                        least[j] = np.minimum.reduceat(shingles * factors[j] + offsets[j], starts)
                    key = np.zeros((BANDS, len(full)), np.uint64) + salts
                    for r in range(ROWS):
                        key = mix(key + least[r::ROWS])
                    bands[full] = key.T
                    spot = mix(least ^ np.arange(samples, dtype=np.uint64)[:, None]) % np.uint64(bits)
                    sketch[full] = _folded(spot, np.arange(len(full), dtype=np.uint64), len(full), bits)
                    sums[full, 0] = np.add.reduceat(mix(shingles), starts)
                    sums[full, 1] = np.bitwise_xor.reduceat(shingles * np.uint64(0x9E3779B97F4A7C15), starts)
                for c, x in zip(columns, (counts, sums[:, 0].view(np.int64), sums[:, 1].view(np.int64), bands.view(np.int64), sketch.view(np.int64)), strict=True):
                    c.append(x)
            join = lambda c, shape: np.concatenate(c) if c else np.zeros(shape, np.int64)
            n = batch.num_rows
            counts, s1, s2 = (join(c, 0) for c in columns[:3])
            bands, sketch = (join(c, (0, w)) for c, w in zip(columns[3:], (BANDS, SKETCH_WORDS), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(s1), pa.array(s2), _listed(bands), _listed(sketch)], names=["id", "n", "s1", "s2", "bands", "sketch"])

    return run


def _listed(x: np.ndarray) -> pa.ListArray:
    n, w = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _parities(size: int):
    """Texts with the parity bitmap of their whole set."""

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            maps = [np.zeros((0, PARITY_WORDS), np.int64)]
            for _, _, raw, at in each_chunk(batch.column(1)):
                sets = shingler.sets(raw, at)
                counts = np.array([len(s) for s in sets], np.int64)
                spots = mix(np.concatenate(sets)) % np.uint64(64 * PARITY_WORDS) if len(sets) else np.zeros(0, np.uint64)
                maps.append(_folded(spots, np.repeat(np.arange(len(sets), dtype=np.uint64), counts), len(sets), 64 * PARITY_WORDS).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _listed(np.concatenate(maps))], names=["id", "text", "parity"])

    return run


def _verified(size: int, percent: int):
    """Pairs whose full sets link, under hashes that share nothing with those by which the pairs were found."""

    def run(batches):
        shingler = Shingler(size, seed=1000)
        for batch in batches:
            sides = []
            for c in (2, 3):
                sides.append([s for _, _, raw, at in each_chunk(batch.column(c)) for s in shingler.sets(raw, at)])
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*sides, strict=True)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = shared and 100 * shared >= percent * (len(a) + len(b) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def most_flips(threshold: float) -> int:
    """Set bits in the XOR of two sketches beyond which a pair is taken to lie below the threshold."""
    samples, bits = BANDS * ROWS, SKETCH_WORDS * 64
    far = threshold - SLACK * (threshold * (1 - threshold) / samples) ** 0.5
    odd = bits / 2 * (1 - np.exp(-4 * samples * (1 - max(far, 0)) / bits))
    return int(np.ceil(odd + SLACK * (odd * (1 - odd / bits)) ** 0.5))


def _flips(a: str, b: str, words: int) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _open_pairs(percent: int):
    """Pairs of rows of different components in each bucket block that pass the size and both bitmap tests."""
    limit = most_flips(percent / 100)

    def tested(own, rep, n, c, sketch, parity, split):
        found = []
        left, right = (np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())) if split else (np.arange(len(rep)),) * 2
        for r in left:
            others = right if split else right[r + 1 :]
            others = others[(c[others] != c[r]) & (100 * np.minimum(n[others], n[r]) >= percent * np.maximum(n[others], n[r]))]
            others = others[np.bitwise_count(sketch[others] ^ sketch[r]).sum(axis=1) <= limit]
            apart = np.bitwise_count(parity[others] ^ parity[r]).sum(axis=1).astype(np.int64)
            found += [(min(rep[r], rep[o]), max(rep[r], rep[o])) for o in others[apart * (100 + percent) <= (n[others] + n[r]) * (100 - percent)]]
        return found

    def run(batches):
        kept = None
        for batch in _and_end(batches):
            if batch is None:
                rows, last = kept, True
            else:
                table = pa.Table.from_batches([batch])
                rows, last = (pa.concat_tables([kept, table]) if kept is not None else table), False
            if rows is None or not len(rows):
                continue
            key, i, j, own, rep, n, c = (rows.column(x).to_numpy() for x in range(7))
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            cuts = [0, *edge.tolist(), *([len(key)] if last else [])]
            done = cuts[-1]
            kept = rows.slice(done) if not last else None
            if done:
                sketch, parity = (np.asarray(pc.list_flatten(rows.column(x).slice(0, done))).view(np.uint64).reshape(done, w) for x, w in ((7, SKETCH_WORDS), (8, PARITY_WORDS)))
                found = []
                for f, t in zip(cuts[:-1], cuts[1:], strict=True):
                    if t - f > 1:
                        found += tested(own[f:t], rep[f:t], n[f:t], c[f:t], sketch[f:t], parity[f:t], i[f] != j[f])
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose ends lie in different components."""
    pairs = pairs.join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left")
    pairs = pairs.join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Group texts whose shingle sets have a Jaccard similarity of `percent` or more.

    Returns (id, n_shingles, component_id, kept) per row, other columns are left out. component_id is the smallest id
    reachable over links. Null and empty texts and texts without words have no shingles and stand alone; rows with a null id
    have a null component and are kept; rows that repeat an id count as one document; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep(source.mapInArrow(_features(shingle), "id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"))
    worded = rows.filter("n > 0 and id is not null")
    classes = scratch.keep(worded.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    leaders = worded.join(classes.withColumnRenamed("rep", "id"), ["id", "n", "s1", "s2"], "left_semi").withColumnRenamed("id", "rep")
    keyed = leaders.select("rep", F.explode("bands").alias("key"))
    buckets = scratch.keep(keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high"))
    shared = scratch.keep(keyed.join(buckets, "key").distinct())
    wanted = scratch.keep(shared.select(F.col("rep").alias("id")).distinct())
    texts = scratch.keep(source.join(wanted, "id", "left_semi").distinct().mapInArrow(_parities(shingle), "id long, text string, parity array<long>"))
    features = scratch.keep(leaders.select("rep", "n", "sketch").join(texts.select(F.col("id").alias("rep"), "parity"), "rep").distinct())
    one = features.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"), F.col("parity").alias("pa"))
    two = features.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"), F.col("parity").alias("pb"))
    apart = _flips("pa", "pb", PARITY_WORDS)
    near = (
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (_flips("ka", "kb", SKETCH_WORDS) <= most_flips(percent / 100))
        & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    )

    def beside(rows: DataFrame, pairs: DataFrame, side: DataFrame) -> DataFrame:
        """rows (a, b, ...) of the pairs (a, b) with the columns of side by a; those of an `a` with many pairs are dealt to parts, each of which gets its row of side."""
        parts = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("parts")))
        dealt = rows.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
        return dealt.join(side.join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts"), ["a", "part"]).drop("part")

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> those that link on their full sets."""
        pairs = scratch.keep(pairs)
        mine = lambda c, text: texts.join(pairs.select(F.col(c).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(c), F.col("text").alias(text))
        whole = beside(pairs.join(mine("b", "tb"), "b"), pairs, mine("a", "ta"))
        return whole.select("a", "b", "ta", "tb").mapInArrow(_verified(shingle, percent), "a long, b long")

    links, labels = None, None
    for lead in ("low", "high"):
        stars = shared.select(F.col(lead).alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
        if labels is not None:
            stars = _across(stars, labels)
        stars = scratch.keep(stars)
        tested = beside(stars.join(two, "b"), stars, one).filter(near)
        best = tested.groupBy("b").agg(F.min_by("a", F.struct((apart / (F.col("na") + F.col("nb"))).alias("x"), "a")).alias("a"))
        linked = scratch.keep(verify(best.select("a", "b")))
        links = linked if links is None else links.unionByName(linked)
        labels = components(links, scratch)

    # links between different components of one bucket
    marked = scratch.keep(shared.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c")))
    mixed = scratch.keep(marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"))
    open_rows = scratch.keep(marked.join(mixed, "key", "left_semi").join(features, "rep"))
    sizes = open_rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = open_rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "c", "sketch", "parity")
    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = sorted_rows.mapInArrow(_open_pairs(percent), "a long, b long").distinct()
    labels = components(links.unionByName(verify(pairs)), scratch)

    named = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("c", "rep").alias("component_id"))
    grouped = worded.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"]).select("id", "n", "component_id")
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = grouped.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
    out = Scratch(spark).keep(out)
    scratch.drop()
    return out
