"""Which files to read again, which hold the same content, and what became of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import delimited

SAME = ["file_id", "modified_time", "size", "mime_type", "kind", "folder_id"]


def supported(files: DataFrame) -> DataFrame:
    """Files that are PDF, delimited text or OFX by name or type. files: name, mime_type."""
    named = F.lower("name").rlike(r"\.(pdf|csv|ofx)$") | F.lower(F.coalesce("mime_type", F.lit(""))).isin("application/pdf", "text/csv", "application/x-ofx")
    return files.filter(named)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, name, modified_time, size, sha256) of the files under a path; the digest is computed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified_time"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that weren't processed in their present state. index: the columns of SAME and processing_status; nulls equal each other."""
    done = index.filter("processing_status = 'PROCESSED'").select(*(F.col(c).alias(f"done_{c}") for c in SAME)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"done_{c}")) for c in SAME]
    return files.join(done, same, "left_anti")


def first_copies(files: DataFrame, identity: str = "sha256") -> DataFrame:
    """Files with `copy_of`: the first file (by name and id) of the same identity, null for the first itself and for files without identity."""
    first = F.first("file_id").over(Window.partitionBy(identity).orderBy("name", "file_id"))
    return files.withColumn("copy_of", F.when(F.col(identity).isNotNull() & (first != F.col("file_id")), first))


def outcomes(results: DataFrame) -> DataFrame:
    """Status per file: its explicit result, else PROCESSED, DUPLICATE or ERROR by what it counted, else PROCESSING_ERROR. results: file_id, result, processed, duplicates, errors."""
    status = F.coalesce("result", F.when(F.col("processed") > 0, "PROCESSED").when(F.col("duplicates") > 0, "DUPLICATE").when(F.col("errors") > 0, "ERROR").otherwise("PROCESSING_ERROR"))
    return results.select("file_id", status.alias("status"))


def outcome_summary(outcomes_: DataFrame) -> DataFrame:
    return outcomes_.groupBy("status").agg(F.count("*").alias("files"))


def statement_format(content: Column) -> Column:
    """OFX for a text with an envelope and movements, EMPTY for a blank one, else DELIMITED."""
    bare = F.regexp_replace(content, "^\ufeff", "")
    envelope = bare.rlike(r"(?i)<OFX(?:\s|>)|<BANKMSGSRSV1>|(?:^|\r?\n)OFXHEADER\s*:")
    return F.when(~F.coalesce(bare, F.lit("")).rlike(r"\S"), "EMPTY").when(envelope & bare.rlike("(?i)<STMTTRN>"), "OFX").otherwise("DELIMITED")


def dispatch(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(OFX statements, delimited statements, errors as file and error) of documents (file, content). A delimited text without a line that names a date, a text and a value is an unknown layout."""
    told = documents.withColumn("format", statement_format(F.col("content")))
    text = told.filter("format = 'DELIMITED'").drop("format")
    heads = delimited.rows(text).select("file").distinct()
    lost = text.join(heads, "file", "left_anti").select("file", F.lit("UNKNOWN_LAYOUT").alias("error"))
    return told.filter("format = 'OFX'").drop("format"), text.join(heads, "file", "left_semi"), told.filter("format = 'EMPTY'").select("file", F.lit("EMPTY_FILE").alias("error")).unionByName(lost)
