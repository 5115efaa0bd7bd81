"""Delimited files of any size whose quoted fields may hold line breaks.

A file is read in byte ranges, line by line. For each line two questions are answered without its neighbours: is a quoted field open at its end if none was open before it, and if one was? So a line keeps the state, swaps it,
or sets it whatever came before, and such steps can be composed in any grouping: first within each range, then over the ranges of a file, which are few. That gives the state before every line, and with it
where records begin.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

#: Byte ranges, of about 100 bytes each, up to which their table is broadcast.
RANGES = 50_000


def _field(delimiter: str) -> str:
    """A field: quoted, closed, with whatever follows up to the delimiter, or not starting with a quote."""
    d = re.escape(delimiter)
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"(?!")[^{d}]*+|(?!")[^{d}]*+)'


def _closed(line: Column, delimiter: str) -> Column:
    """Whether no quoted field is open at the end of a line that starts outside of one."""
    return line.rlike(rf"(?s)\A{_field(delimiter)}(?:{re.escape(delimiter)}{_field(delimiter)})*+\z")


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text): lines with the byte range that they were read in and their order within it; a carriage return before the line feed stays."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def _composed(batches):
    """One row for each byte range: its lines, and whether a field is open after it, from outside and from within."""
    place, n, out, within = None, 0, False, True
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*place, n, out, within), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=["file", "block", "n", "o", "w"])
    for batch in batches:
        for file, block, o, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != (file, block):
                if place:
                    yield row()
                place, n, out, within = (file, block), 0, False, True
            n, out, within = n + 1, (w if out else o), (w if within else o)
    if place:
        yield row()


def _pieces(batches):
    """Records, and what a byte range holds of those that cross its ends: (file, line, text, begins, ends)."""
    place, line, open_, held, first, begins = None, 0, False, [], 0, True

    def put(ends):
        out.append((place[0], first, "\n".join(held), begins, ends))
        held.clear()

    for batch in _and_end(batches):
        out = []
        for file, block, text, o, w, open_before, lines_before in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else ():
            if place != (file, block):
                if held:
                    put(False)
                place, line, open_ = (file, block), lines_before, open_before
            line += 1
            if not held:
                first, begins = line, not open_
            held.append(text)
            open_ = w if open_ else o
            if not open_:
                put(True)
        if batch is None and held:
            put(False)
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=["file", "line", "text", "begins", "ends"])


def _and_end(batches):
    yield from batches
    yield None


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, line, text): the records of all files under path, with the physical line on which each begins, from 1; line breaks within quotes stay, a carriage return at the end goes.

    A quote that is never closed makes the rest of its file one record, as it does for any reader. Files are read twice, first for the states between the ranges; only pieces of records that cross the end of a
    range are shuffled.
    """
    lines = physical_lines(spark, path)
    # Whether a field is open after the line, from outside and from within. Equal answers set the state, others keep or swap it.
    lines = lines.withColumn("out", ~_closed(F.col("text"), delimiter)).withColumn("within", ~_closed(F.concat(F.lit('"'), F.col("text")), delimiter))
    blocks = cut(lines.select("file", "block", "out", "within").mapInArrow(_composed, "file string, block long, n long, o boolean, w boolean"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = lambda n: n % 2 == 1
    # The ranges of a file, a few thousand for a terabyte, are composed by the last one that sets the state and the swaps since.
    over = blocks.withColumn("s", (F.col("o") & ~F.col("w")).cast("int")).withColumn("swaps", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    own = over.withColumn("mark", F.when(F.col("o") == F.col("w"), F.struct("o", (F.col("swaps") + F.col("s")).alias("swaps")))).withColumn("set", F.last("mark", ignorenulls=True).over(earlier))
    start = F.when(F.col("set").isNull(), odd(F.col("swaps"))).otherwise(F.col("set.o") != odd(F.col("swaps") - F.col("set.swaps")))
    starts = cut(own.select("file", "block", start.alias("open_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before")))
    cols = ["file", "block", "text", "out", "within", "open_before", "lines_before"]
    if starts.count() <= RANGES:  # rows stay in the order of the scan beside a broadcast table
        dealt = lines.join(F.broadcast(starts), ["file", "block"]).select(cols)
    else:
        dealt = lines.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at").select(cols)
    pieces = cut(dealt.mapInArrow(_pieces, "file string, line long, text string, begins boolean, ends boolean"))
    whole = pieces.filter("begins and ends").select("file", "line", "text")
    parts = pieces.filter("not (begins and ends)")
    # The record of a piece is found without its text: a file has at most two pieces for each of its ranges.
    heads = parts.select("file", "line", F.last(F.when(F.col("begins"), F.col("line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line")).alias("first"))
    parts = parts.join(cut(heads), ["file", "line"])
    joined = parts.groupBy("file", F.col("first").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("file", "line", "text")).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def fields(record: Column, delimiter: str = ",") -> Column:
    """The fields of a record as an array: quoted ones without their quotes, with doubled quotes as one; an unclosed one runs to the end."""
    d = re.escape(delimiter)
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(rf'(?s){d}({_field(delimiter)[3:-1]}|".*)'), F.lit(1))
    inner = lambda f: F.replace(F.regexp_extract(f, r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"(?!")', 1), F.lit('""'), F.lit('"'))
    rest = lambda f: F.regexp_extract(f, r'(?s)\A"[^"]*+(?:""[^"]*+)*+"(?!")(.*)\z', 1)
    closed = lambda f: f.rlike(r'(?s)\A"[^"]*+(?:""[^"]*+)*+"(?!")')
    return F.transform(found, lambda f: F.when(~f.startswith('"'), f).when(closed(f), F.concat(inner(f), rest(f))).otherwise(F.replace(F.substring(f, 2, 1 << 30), F.lit('""'), F.lit('"'))))


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, line, values, issue): the records of files with a header as maps from trimmed column names to texts.

    A byte order mark goes; blank records, columns without a name and records without any filled value are left out. Records with fewer fields lack the last columns; more fields than columns are an
    issue (TOO_MANY_FIELDS) unless the extra ones are blank. Of repeated names the last column counts.
    """
    rows = records(spark, path, delimiter).withColumn("text", F.when(F.col("line") == 1, F.regexp_replace("text", "\\A\ufeff", "")).otherwise(F.col("text"))).filter(F.trim("text") != "")
    header = rows.groupBy("file").agg(F.min_by("text", "line").alias("head"), F.min("line").alias("head_line"))
    # One row per file; written, so that its size is known and records stay where they are as long as it's small.
    header = cut(header.select("file", "head_line", F.transform(fields(F.col("head"), delimiter), lambda name: F.trim(name)).alias("names")))
    body = rows.join(header, "file").filter(F.col("line") > F.col("head_line")).withColumn("cells", fields(F.col("text"), delimiter))
    named = F.filter(F.transform(F.slice("cells", 1, F.size("names")), lambda v, i: F.struct(F.get("names", i).alias("key"), v.alias("value"))), lambda e: e["key"] != "")
    last = F.aggregate(named, F.lit(None).cast("map<string,string>"), lambda m, e: F.when(m.isNull(), F.create_map(e["key"], e["value"])).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"]))))
    extra = F.exists(F.slice("cells", F.size("names") + 1, 1 << 30), lambda v: F.trim(v) != "")
    out = body.select("file", "line", last.alias("values"), F.when(extra, "TOO_MANY_FIELDS").alias("issue"))
    return out.filter(F.exists(F.map_values("values"), lambda v: F.trim(v) != "") | F.col("issue").isNotNull())
