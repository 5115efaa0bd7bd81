"""The corpus pipeline: five stages over documents, each applying one operator to all that its predecessor kept.

Toxicity and decontamination judge each row where it stands, whatever its id. The two deduplications name rows by their place in the files of their input, so rows with a null or
repeated id are judged by their own text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, table
from ledgerloom.llm.decontaminate import clean_rows
from ledgerloom.llm.exact_dedup import exact_duplicates
from ledgerloom.llm.near_dedup import near_duplicates
from ledgerloom.llm.queries import PIECES
from ledgerloom.llm.toxicity import fit, mild_rows
from ledgerloom.llm.unigram import encode


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for every row that is the same at every use, and the free name of its column: the hash of its file plus its place there, or a written number where docs don't come from files.

    Two files of a table clash only if their 64-bit hashes lie closer together than a file has rows.
    """
    key = "_row_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    try:
        keyed = docs.select("*", (F.shiftright(F.xxhash64(F.col("_metadata.file_path")), 1) + F.col("_metadata.row_index")).alias(key))
        keyed.schema
    except AnalysisException:
        return Scratch(docs.sparkSession).keep(docs.withColumn(key, F.monotonically_increasing_id())), key
    return keyed, key


def _one_of_each(docs: DataFrame, key: str, groups: DataFrame, largest: bool) -> DataFrame:
    """docs without those rows of a group (key, same) that aren't its first by id; a row with a null id is first only where its group holds no id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    several = groups.join(groups.groupBy("same").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "same")
    named = scratch.keep(several.join(docs.select(key, F.col("doc_id").cast("long").alias("id")), key))
    first = F.max(F.struct("id", key)) if largest else F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", key))
    gone = scratch.keep(named.join(named.groupBy("same").agg(first.alias("first")).select(F.col(f"first.{key}").alias(key)), key, "left_anti").select(key))
    return docs.join(gone, key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below 0.7; repeated rows are judged alike, null and empty texts stay."""
    return mild_rows(docs, *fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-identical texts, null and empty ones being equal, the row with the largest id; of repeated rows one."""
    docs, key = _keyed(docs)
    return _one_of_each(docs, key, exact_duplicates(docs, key).filter("group_size > 1").select(key, F.col("keep_id").alias("same")), largest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest id; texts without words stay."""
    docs, key = _keyed(docs)
    return _one_of_each(docs, key, near_duplicates(docs, key).filter("n_shingles > 0").select(key, F.col("component_id").alias("same")), largest=False)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs within its edit budget; repeated rows are judged alike, null and empty texts stay."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of all remaining documents; null ids pass through, null and empty texts give no pieces, repeated rows repeated results."""
    return encode(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("encoding", encode_pieces),
]

#: Learnt scores, edit distances and piece ids aren't expressible in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet in the shared folder and read again; a table goes when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if last:
            last.drop()
        last = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
