"""Overlap of statement exports: the same movement in a newly read source and in what earlier sources gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_description
from ..plans.shared import Scratch, cut

KEY = ["date", "direction", "amount"]
# Words that say nothing about a movement.
EMPTY_WORDS = ["pix", "qrcode", "code", "est", "din", "dinamico", "estatico", "des", "rem", "fav", "orig"]
#: Share of rows with a single partner in another format above which repeated movements pair by their order.
ALIGNED = 0.9


def compatible(left: Column, right: Column) -> Column:
    """Whether two texts may name one movement: equal, two shared words that are most of the shorter, or one within the other."""
    return _alike_said(normalize_description(left), normalize_description(right))


def _alike_said(a: Column, b: Column) -> Column:
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: (F.length(w) > 2) & ~w.isin(EMPTY_WORDS)))
    shared, few = F.size(F.array_intersect(words(a), words(b))), F.least(F.size(words(a)), F.size(words(b)))
    within = (F.least(F.length(a), F.length(b)) >= 12) & (a.contains(b) | b.contains(a))
    return F.coalesce((a == b) | (few > 0) & ((shared >= 2) & (shared / few >= 0.75) | within), F.lit(False))


def overlaps(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """(known_id, incoming_id, how) of movements that both hold, each at most once.

    known, incoming: id, row_idx, date, direction, amount, document, format (or formats, an array), original_description; incoming may hold several sources (source) that share no date, direction and amount. SINGLE: the only row of its date, direction and amount on both sides, in another format or with
    like evidence. DOCUMENT, TEXT: equal document or text, once on each side. LIKE: an incoming row whose text is like that of exactly one known row of the key, which no other incoming row claims so. ORDER: if nearly all rows of an incoming source are single in another format, what is left of a key with any other format pairs by
    order when both sides have equally many. An id that repeats in a source names one row per date, direction and amount. All steps are counts, equi-joins on unique keys and windows; only distinct texts of a key are compared with each other, never its rows.
    """
    cols = ["id", "row_idx", *KEY, "document", "original_description"]
    formats = lambda df: (F.col("formats") if "formats" in df.columns else F.array_compact(F.array("format"))).alias("formats")
    source = lambda df: (F.col("source") if "source" in df.columns else F.lit("")).alias("source")
    # Every step is written: the next one reads it twice, and texts are normalised once.
    scratch = Scratch(known.sparkSession)
    a, b = (scratch.keep(df.select(*cols, formats(df), source(df)).withColumn("said", normalize_description(F.coalesce("original_description", F.lit(""))))) for df in (known, incoming))
    size = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name), *(F.min(c).alias(f"{name}_{n}") for c, n in (("id", "id"), ("formats", "formats"), ("said", "said"), ("document", "document"), ("source", "source"))))
    keys = size(a, "a").join(size(b, "b"), KEY)
    cross = F.size(F.array_except("b_formats", "a_formats")) > 0
    like = F.coalesce((F.col("a_document") != "") & (F.col("a_document") == F.col("b_document")), F.lit(False)) | _alike_said(F.col("a_said"), F.col("b_said"))
    alone = scratch.keep(keys.filter("a = 1 and b = 1").select(*KEY, "a_id", "b_id", "b_source", cross.alias("cross"), like.alias("like")))
    single = alone.filter("cross or like").select(*KEY, F.col("a_id").alias("known_id"), F.col("b_id").alias("incoming_id"), F.lit("SINGLE").alias("how"))
    anchors = alone.groupBy(F.col("b_source").alias("source")).agg(F.count_if("cross").alias("anchors"))
    aligned = b.groupBy("source").agg(F.count("*").alias("total")).join(anchors, "source").filter(F.col("anchors") >= ALIGNED * F.col("total")).select("source")

    def once(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.filter(F.coalesce(column, F.lit("")) != "").groupBy(*KEY, column).agg(F.count("*").alias("n"), F.min("id").alias(name)).filter("n = 1").drop("n")

    def rest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        taken = lambda name: pairs.select(*KEY, F.col(name).alias("id"))
        return a.join(taken("known_id"), [*KEY, "id"], "left_anti"), b.join(taken("incoming_id"), [*KEY, "id"], "left_anti")

    pairs = single
    for column, how in (("document", "DOCUMENT"), ("said", "TEXT")):
        left, right = rest(pairs)
        pairs = scratch.keep(pairs.unionByName(once(left, column, "known_id").join(once(right, column, "incoming_id"), [*KEY, column]).select(*KEY, "known_id", "incoming_id", F.lit(how).alias("how"))))
    left, right = rest(pairs)
    pairs = scratch.keep(pairs.unionByName(_alike(left, right, scratch)))
    left, right = rest(pairs)
    whole = Window.partitionBy(*KEY)
    placed = lambda df, name: df.select(*KEY, F.col("id").alias(name), F.col("source").alias(f"{name}_source"), F.row_number().over(whole.orderBy("row_idx", "id")).alias("nth"), F.count("*").over(whole).alias("size"))
    having = a.select(*KEY, F.explode("formats").alias("format")).groupBy(*KEY, "format").agg(F.count("*").alias("having"))
    foreign = b.select(*KEY, F.explode("formats").alias("format")).distinct().join(a.groupBy(*KEY).agg(F.count("*").alias("n")), KEY).join(having, [*KEY, "format"], "left").filter(F.coalesce("having", F.lit(0)) < F.col("n")).select(*KEY).distinct()
    ordered = placed(left, "known_id").join(placed(right, "incoming_id"), [*KEY, "nth", "size"]).join(foreign, KEY, "left_semi").join(aligned.withColumnRenamed("source", "incoming_id_source"), "incoming_id_source", "left_semi")
    out = cut(pairs.drop(*KEY).unionByName(ordered.select("known_id", "incoming_id", F.lit("ORDER").alias("how"))))
    scratch.drop()
    return out


def _alike(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, known_id, incoming_id, how) of rows whose texts are like each other's and no other's."""
    texts = lambda df, name: df.groupBy(*KEY, "said").agg(F.count("*").alias(f"{name}_n"), F.min("id").alias(f"{name}_id")).withColumnRenamed("said", f"{name}_said")
    met = scratch.keep(texts(left, "known").join(texts(right, "incoming"), KEY))
    alike = scratch.keep(met.select("known_said", "incoming_said").distinct().filter(_alike_said(F.col("known_said"), F.col("incoming_said"))))
    met = met.join(alike, ["known_said", "incoming_said"])
    only = met.groupBy(*KEY, "incoming_said").agg(F.sum("known_n").alias("options"), F.max("incoming_n").alias("n"), F.min("known_said").alias("known_said"), F.min("known_id").alias("known_id"), F.min("incoming_id").alias("incoming_id")).filter("options = 1")
    single = only.groupBy(*KEY, "known_said").agg(F.sum("n").alias("claims"), F.min("known_id").alias("known_id"), F.min("incoming_id").alias("incoming_id")).filter("claims = 1")
    return single.select(*KEY, "known_id", "incoming_id", F.lit("LIKE").alias("how"))


def merge(known: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """Known rows, with the source added to source_ids where it holds them too, and the incoming rows that are new. known also has source_ids."""
    pairs = overlaps(known, incoming)
    met = pairs.select(F.col("known_id").alias("id"), F.lit(source).alias("again"))
    old = known.join(met, "id", "left").withColumn("source_ids", F.array_distinct(F.array_compact(F.concat("source_ids", F.array("again"))))).drop("again")
    new = incoming.join(pairs.select(F.col("incoming_id").alias("id")), "id", "left_anti").withColumn("source_ids", F.array(F.lit(source)))
    return old.unionByName(new.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True)


def _levels(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, level): sources that share a movement have different levels, in their order; levels are as low as that allows. keys: date, direction, amount, source."""
    pairs = scratch.keep(keys.withColumn("before", F.lag("source").over(Window.partitionBy(*KEY).orderBy("source"))).filter("before is not null").select("before", "source").distinct())
    levels = scratch.keep(keys.select("source").distinct().withColumn("level", F.lit(0)))
    while True:
        up = pairs.join(levels.select(F.col("source").alias("before"), "level"), "before").groupBy("source").agg((F.max("level") + 1).alias("up"))
        raised = scratch.keep(levels.join(up, "source", "left").select("source", F.col("level").alias("old"), F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        levels = raised.select("source", "level")
        if raised.filter("level > old").isEmpty():
            return levels


def richer(left: Column, right: Column) -> Column:
    """The text that says more: more words that say anything, then more characters; the left one of equals."""
    words = lambda t: F.filter(F.split(normalize_description(F.coalesce(t, F.lit(""))), " "), lambda w: (F.length(w) > 2) & ~w.isin(EMPTY_WORDS))
    weight = lambda t: F.size(words(t)) * 100 + F.length(F.trim(F.coalesce(t, F.lit(""))))
    return F.when(weight(right) > weight(left), right).otherwise(left)


def fold(rows: DataFrame) -> DataFrame:
    """All sources merged in the order of their names, each into what the ones before it gave: (id, source, row_idx, date, direction, amount, document, original_description, source_ids, formats, descriptions).

    rows: source, id, row_idx (its place in the source), date, direction, amount, document, format, original_description. Every movement stands under the earliest source that holds it, with all sources, formats
    and texts that name it and the text that says most. Sources that share no movement are taken in one round, so there are as many rounds as the longest chain of overlapping sources; a row is written until
    the last source with its date, direction and amount has been taken, then never again. Rows whose key no other source has are read once. An empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch, result = Scratch(spark), Scratch(spark)
    named = rows.withColumn("uid", F.concat_ws("/", "source", "row_idx"))
    levels = _levels(scratch.keep(rows.select(*KEY, "source").distinct()), scratch)
    held = ["uid", "id", "source", "row_idx", *KEY, "document", "original_description"]
    fresh = named.join(levels, "source").select(*held, "level", F.array("source").alias("source_ids"), F.array_compact(F.array("format")).alias("formats"), F.array_compact(F.array("original_description")).alias("descriptions"))
    last = fresh.groupBy(*KEY).agg(F.max("level").alias("last"))
    fresh = scratch.keep(fresh.join(last, KEY))
    done, open_, older = [], None, None
    for level in range((levels.agg(F.max("level")).first()[0] or 0) + 1):
        new = fresh.filter(F.col("level") == level)
        if open_ is not None:
            keys = new.select(*KEY).distinct()
            met = open_.join(keys, KEY, "left_semi")
            plain = lambda df: df.select(F.col("uid").alias("id"), "source", "row_idx", *KEY, "document", "formats", "original_description")
            by_place = F.row_number().over(Window.partitionBy(*KEY).orderBy("source", "row_idx"))
            pairs = overlaps(plain(met.withColumn("row_idx", by_place)), plain(new))
            again = pairs.join(new.select(F.col("uid").alias("incoming_id"), *(F.col(c).alias(f"new_{c}") for c in ("source_ids", "formats", "descriptions", "original_description"))), "incoming_id").drop("incoming_id", "how")
            both = open_.join(again.withColumnRenamed("known_id", "uid"), "uid", "left")
            gathered = {c: F.when(F.col(f"new_{c}").isNull(), F.col(c)).otherwise(F.array_union(c, f"new_{c}")) for c in ("source_ids", "formats", "descriptions")}
            text = F.when(F.col("new_source_ids").isNull(), F.col("original_description")).otherwise(richer(F.col("original_description"), F.col("new_original_description")))
            old = both.withColumns({**gathered, "original_description": text}).select(fresh.columns)
            new = old.unionByName(new.join(pairs.select(F.col("incoming_id").alias("uid")), "uid", "left_anti"))
        step = Scratch(spark)
        now = step.keep(new)
        if older is not None:
            older.drop()
        done.append(result.keep(now.filter(F.col("last") == level)))
        open_, older = now.filter(F.col("last") > level), step
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    scratch.drop()
    older.drop()
    return out.select("id", "source", "row_idx", *KEY, "document", "original_description", F.array_sort("source_ids").alias("source_ids"), F.array_sort("formats").alias("formats"), F.array_sort("descriptions").alias("descriptions"))
