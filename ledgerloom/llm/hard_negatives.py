"""Hard negatives by a two-dimensional block matrix multiply.

The score matrix of anchors by rows is cut into tiles of anchor blocks by row blocks, and the dimensions into chunks. Each (anchor block, row block, chunk) is one product of two small
matrices; the partial tiles of all chunks meet in a shuffle and are added. Blocks are filled label bucket by label bucket, so the tiles that can hold positives are known: these are
multiplied first, each reduced to the best few of an anchor. The second multiplication goes over all tiles and knows the positives: a tile is reduced to the best few negatives in
the window of each anchor and positive. What leaves a tile never grows with its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, small_batches
from .vectors import narrow, product, scaled, usable, widened

#: Rows and anchors of a block, dimensions of a chunk.
ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 4096, 256, 32
#: Stands for a null id inside tiles; it's the last in the order of ids.
NO_ID = 2**63 - 1

BLOCK = "block long, chunk int, is_first long, is_parts long, n int, ids binary, labels binary, data binary"
TILE = "i long, j long, chunk int, tile binary, rows int, columns int, anchor_ids binary, anchor_labels binary, ids binary, labels binary, wanted array<struct<row:int,rank:int,id:long,score:long>>"
POSITIVE = "i long, row int, anchor_id long, id long, score long"
NEGATIVE = "i long, row int, anchor_id long, rank int, positive_id long, positive_score long, id long, score long"


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(schema)], schema=schema)


def _pack(chunk: int):
    """Rows of one block to one row per chunk of dimensions; shorter vectors are filled up with zeros."""
    schema = _schema(BLOCK)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        q = rows.column("q").combine_chunks()
        n, ends = len(rows), np.asarray(q.offsets)
        lengths = np.diff(ends)
        values = np.asarray(q.values)[ends[0] : ends[-1]] if n else np.zeros(0, np.int64)
        width = max(1, math.ceil(lengths.max(initial=0) / chunk)) * chunk
        matrix = np.zeros((n, width), np.int64)
        matrix[np.arange(width)[None, :] < lengths[:, None]] = values
        meta = [narrow(np.asarray(rows.column(c)).astype(np.int64)).tobytes() for c in ("id", "label")]
        head = [rows.column(c)[0].as_py() for c in ("block", "is_first", "is_parts")]
        out = [(head[0], k, *head[1:], n, *meta, narrow(matrix[:, k * chunk : (k + 1) * chunk]).tobytes()) for k in range(width // chunk)]
        return pa.Table.from_batches([_batch(schema, out)])

    return run


def _multiply(chunk: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for r in range(batch.num_rows):
                at = lambda c, r=r, batch=batch: batch.column(c)[r].as_py()
                shape = at("anchor_n"), at("n")
                a, b = widened(at("anchor_data"), (shape[0], chunk)), widened(at("data"), (shape[1], chunk))
                wanted = batch.column("wanted").slice(r, 1) if "wanted" in names and at("chunk") == 0 else pa.nulls(1, _WANTED)
                # What names the rows of a tile travels with one chunk.
                meta = [batch.column(c).slice(r, 1) if at("chunk") == 0 else pa.nulls(1, pa.binary()) for c in ("anchor_ids", "anchor_labels", "ids", "labels")]
                scores = product(a, b)
                # A row's product with itself is the largest by far and counts for nothing; without it a tile fits a narrower type.
                scores[widened(at("anchor_ids"), (shape[0], 1)) == widened(at("ids"), (shape[1], 1)).T] = 0
                head = [pa.array([x], t) for x, t in zip((at("i"), at("j"), at("chunk"), narrow(scores).tobytes(), *shape), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*head, *meta, wanted.cast(_WANTED)], names=[c.split()[0] for c in TILE.split(", ")[:10]] + ["wanted"])

    return run


_WANTED = pa.list_(pa.struct([("row", pa.int32()), ("rank", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))


def _summed(parts: pa.Table) -> tuple:
    """(block of anchors, anchor ids, anchor labels, ids, labels, scores, wanted) of one tile: the sum of its partial tiles."""
    chunks = parts.column("chunk").to_pylist()
    head = chunks.index(0)
    shape = parts.column("rows")[0].as_py(), parts.column("columns")[0].as_py()
    longs = [widened(parts.column(c)[head].as_py(), (n, 1))[:, 0] for c, n in zip(("anchor_ids", "anchor_labels", "ids", "labels"), (shape[0], shape[0], shape[1], shape[1]), strict=True)]
    scores = np.zeros(shape, np.int64)
    for tile in parts.column("tile"):
        scores += widened(tile.as_py(), shape)
    return parts.column("i")[0].as_py(), *longs, scores, parts.column("wanted")[head]


def _ordered(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows of one id and score are the same to all that follows, so their order doesn't matter."""
    return np.lexsort((ids, -scores))


def _positives(most: int):
    """The first `most` rows of an anchor's label in one tile."""
    schema = _schema(POSITIVE)

    def run(parts: pa.Table) -> pa.Table:
        i, anchors, anchor_labels, ids, labels, scores, _ = _summed(parts)
        out = []
        for row, (own, label) in enumerate(zip(anchors, anchor_labels, strict=True)):
            at = np.flatnonzero((labels == label) & (ids != own))
            s = scores[row, at]
            if len(at) > most:
                near = s >= np.partition(s, -most)[-most]
                at, s = at[near], s[near]
            for x in at[_ordered(s, ids[at])[:most]]:
                out.append((i, row, own, ids[x], scores[row, x]))
        return pa.Table.from_batches([_batch(schema, out)])

    return run


def _negatives(most: int, low: int, high: int):
    """The first `most` rows of other labels in one tile for each positive's window."""
    schema = _schema(NEGATIVE)

    def run(parts: pa.Table) -> pa.Table:
        i, anchors, anchor_labels, ids, labels, scores, wanted = _summed(parts)
        windows: dict[int, list] = {}
        for w in wanted.as_py() or []:
            windows.setdefault(w["row"], []).append((w["rank"], w["id"], w["score"], -(-low * w["score"] // 100), high * w["score"] // 100))
        out = []
        for row, each in windows.items():
            s = scores[row]
            at = np.flatnonzero((s >= min(w[3] for w in each)) & (s <= max(w[4] for w in each)) & (labels != anchor_labels[row]) & (ids != anchors[row]))
            at = at[_ordered(s[at], ids[at])]
            falling = -s[at]
            for rank, pid, score, least, top in each:
                begin, end = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -least, "right")
                for x in at[begin : min(begin + most, end)]:
                    out.append((i, row, anchors[row], rank, pid, score, ids[x], s[x]))
        return pa.Table.from_batches([_batch(schema, out)])

    return run


def hard_negatives(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """For each anchor (id divisible by `every`) and each of its first `positives` other rows of the same label, the first `negatives` rows of other labels whose score is from
    low to high hundredths of the positive's: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the components times 256 rounded down; higher scores come first, then smaller ids. Rows with a null label, a null vector or a null, non-finite or
    huge (2**18) component take no part. Rows of the anchor's own id are never its positives or negatives. A repeated row counts as often as it stands, a repeated anchor gives
    repeated results; rows with a null id come last among equal scores and are no anchors (nor is the id 2**63-1, which stands for them). Of vectors of different length the shorter is
    taken to end in zeros. Positive scores below zero have an empty window. Other columns are left out. An empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    kept = scratch.keep(rows.filter(F.col(label_col).isNotNull() & usable(F.col(vec_col))).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), scaled(rows, vec_col).alias("q")))
    is_anchor = (F.col("id") % every == 0) & (F.col("id") != NO_ID)
    buckets = max(1, math.ceil(kept.filter(is_anchor).count() / anchor_block))
    placed = kept.withColumn("place", F.monotonically_increasing_id()).withColumn("anchor", is_anchor).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    # One row per bucket: how many blocks it has, and their first numbers.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / row_block).alias("parts"), F.ceil(F.count_if("anchor") / anchor_block).alias("anchor_parts"))
    sizes = scratch.keep(sizes.select("bucket", "parts", "anchor_parts", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_first") for c in ("parts", "anchor_parts"))))
    total = sizes.agg(F.sum("parts"), F.sum("anchor_parts")).first()
    with_sizes = placed.join(sizes, "bucket")

    def blocks(of: DataFrame, first: str, parts: str, other_first: str, other_parts: str) -> DataFrame:
        """Packed blocks; is_first and is_parts name the other side's blocks of the same bucket."""
        named = of.select((F.col(first) + F.pmod(F.xxhash64("place"), F.col(parts))).cast("long").alias("block"), F.col(other_first).alias("is_first"), F.col(other_parts).alias("is_parts"), "id", "label", "q")
        return scratch.keep(named.groupBy("block").applyInArrow(_pack(chunk), BLOCK))

    row_blocks = blocks(with_sizes, "parts_first", "parts", "anchor_parts_first", "anchor_parts")
    anchor_blocks = blocks(with_sizes.filter("anchor"), "anchor_parts_first", "anchor_parts", "parts_first", "parts")
    left = anchor_blocks.select(F.col("block").alias("i"), "chunk", "is_first", "is_parts", F.col("n").alias("anchor_n"), F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), F.col("data").alias("anchor_data"))
    right = row_blocks.select(F.col("block").alias("j"), "chunk", "is_first", "is_parts", "n", "ids", "labels", "data")

    def tiles(a: DataFrame, b: DataFrame, js, is_) -> DataFrame:
        """Partial tiles: anchor blocks copied to their tiles' columns, row blocks to their rows."""
        a = a.withColumn("j", F.explode(js)).drop("is_first", "is_parts")
        b = b.filter("is_parts > 0").withColumn("i", F.explode(is_)).drop("is_first", "is_parts")
        # Spark doesn't count the copies in the size of either side; without the hint it would gather all of a side that is small before it is copied in the driver, to broadcast it.
        return a.hint("merge").join(b.hint("merge"), ["i", "j", "chunk"]).mapInArrow(_multiply(chunk), TILE)

    own = F.sequence("is_first", F.col("is_first") + F.col("is_parts") - 1)
    best = Window.partitionBy("i", "row").orderBy(F.desc("score"), "id")
    found = tiles(left, right, own, own).groupBy("i", "j").applyInArrow(_positives(positives), POSITIVE)
    found = scratch.keep(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives))
    wanted = found.groupBy("i").agg(F.collect_list(F.struct("row", "rank", "id", "score")).alias("wanted"))
    every_i, every_j = (F.sequence(F.lit(0).cast("long"), F.lit(max((n or 0) - 1, 0)).cast("long")) for n in (total[1], total[0]))
    everywhere = right.withColumn("is_parts", F.lit(1 if total[1] else 0))
    told = tiles(left.join(wanted, "i"), everywhere, every_j, every_i).groupBy("i", "j").applyInArrow(_negatives(negatives, low, high), NEGATIVE)
    best = Window.partitionBy("i", "row", "rank").orderBy(F.desc("score"), "id")
    told = told.withColumn("place_in", F.row_number().over(best)).filter(F.col("place_in") <= negatives)
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = cut(told.select("anchor_id", id_of("positive_id").alias("positive_id"), F.col("place_in").alias("rank"), id_of("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    scratch.drop()
    return out
