"""Decisions as a stream: new files of decisions are merged into a table of buckets, by the same rule as records.sync_merge().

Each key belongs to one bucket by its hash. A batch reads the buckets of its keys, merges, and writes these buckets alone to a new folder; all other buckets stay where they are. The rule takes the greatest
of a total order of versions, so files may come in any order and any number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import Scratch
from ..sources.versions import Conflict, VersionedTable

SCHEMA = "key string, updated_ts timestamp, state string, side string"
#: Buckets of a table; a table keeps the number it was made with.
BUCKETS = 64
_BATCH, _BUCKETS = "_batch", "_buckets"


def _rank() -> Column:
    """Versions in the order in which they win: the later one, then a local deletion, then a remote version, a deletion before an active one."""
    local, gone = F.coalesce(F.col("side") == "local", F.lit(False)), F.coalesce(F.col("state") == "DELETED", F.lit(False))
    return F.struct("updated_ts", F.when(local & gone, 2).when(~local, 1).otherwise(0).alias("by"), gone.alias("gone"), "state", "side")


def latest(decisions: DataFrame, *by: str) -> DataFrame:
    """The winning version of each key (by, key, updated_ts, state, side); a null side is remote, null keys are one key, repeated versions count once. by: columns that follow from the key."""
    return decisions.groupBy(*by, "key").agg(F.max_by(F.struct("updated_ts", "state", "side"), _rank()).alias("won")).select(*by, "key", "won.*")


def merge_batch(spark: SparkSession, table: str, batch: DataFrame, number: int, buckets: int = BUCKETS) -> list[int]:
    """Merge a numbered batch into the table and return the buckets that it touched; a batch that the table has already seen changes nothing."""
    held = VersionedTable(spark, table, SCHEMA)
    scratch = Scratch(spark)
    buckets = int(held.slots(held.version()).get(_BUCKETS, buckets))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    new = scratch.keep(latest(batch.withColumn("bucket", bucket), "bucket"))
    touched = sorted(new.agg(F.collect_set("bucket")).first()[0])  # at most as many as there are buckets
    try:
        for _ in range(20):
            base = held.version()
            slots = held.slots(base)
            if int(slots.get(_BATCH, -1)) >= number:
                return []
            known = held.rows(slots[str(b)] for b in touched if str(b) in slots)
            # One shuffle, by bucket, serves the merge and the write.
            folder = held.write(latest(new.unionByName(known.withColumn("bucket", bucket)).repartition("bucket"), "bucket"), by="bucket")
            if held.commit(base, slots | {str(b): f"{folder}/bucket={b}" for b in touched} | {_BATCH: str(number), _BUCKETS: str(buckets)}):
                return touched
            held.discard(folder)
        raise Conflict(f"batch {number} of {table}")
    finally:
        scratch.drop()


def merge_new_files(spark: SparkSession, source: str, table: str, checkpoint: str, buckets: int = BUCKETS, files_per_batch: int | None = None) -> None:
    """Process the JSON files in `source` (key, updated_ts, state, and side where it isn't remote) that weren't processed before."""
    reader = spark.readStream.schema(SCHEMA)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    batches = reader.json(source).writeStream.foreachBatch(lambda batch, number: merge_batch(spark, table, batch, number, buckets) and None)
    batches.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the table, empty before the first batch."""
    return VersionedTable(spark, table, SCHEMA).read()
