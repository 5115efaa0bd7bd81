"""Exact token-length histogram: one row per encoded length, from which suffix sums answer every question about context limits."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    """Token ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(1)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def _lengths(path: str, pattern: str):
    def run(batches):
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return run


def token_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row (n_tokens) per document; null and empty texts have no tokens. The vocabulary file must be readable on every executor."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths(path, pattern), "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct length: n_docs, docs_at_least and tokens_at_least (suffix sums over lengths from this one on) and truncated_total, the
    tokens left if every document is cut to this length. Null lengths are left out; an empty table gives no rows.

    Sums run within blocks of lengths and over the blocks' totals, so no task sees all lengths.
    """
    # Checkpointed, as both levels of sums read the counts and no text should be encoded twice.
    counts = cut(lengths.dropna(subset=["n_tokens"]).groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block", "tokens", F.coalesce(F.sum("docs").over(above), zero).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), zero).alias("tokens_above"), F.coalesce(F.sum("tokens").over(ahead), zero).alias("tokens_below")
    )
    out = counts.join(blocks, "block")
    docs_in = F.sum("n_docs").over(inside)
    tokens_in = F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)
    out = out.select("n_tokens", "n_docs", (docs_in + F.col("docs_above")).alias("docs_at_least"), (tokens_in + F.col("tokens_above")).alias("tokens_at_least"), (F.col("tokens_below") + F.col("tokens") - tokens_in).alias("shorter"))
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("shorter") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"))


def totals_at(hist: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens and tokens left at a context limit, from the histogram alone."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    return hist.agg(F.sum(docs).alias("docs"), F.sum(n * docs).alias("tokens"), F.sum(F.least(n, F.lit(limit)) * docs).alias("truncated_total"))


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least this share of documents does not exceed."""
    total = hist.agg(F.sum("n_docs").alias("all_docs"))
    at_most = hist.select("n_tokens", (F.col("n_docs") - F.col("docs_at_least")).alias("less"), F.lit(1).alias("k")).join(total.withColumn("k", F.lit(1)), "k")
    return at_most.filter(F.col("all_docs") + F.col("less") >= share * F.col("all_docs")).agg(F.min("n_tokens").alias("n_tokens"))
