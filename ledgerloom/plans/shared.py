"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir or that the session has set; a new local one only where driver and executors are one process."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir()
    return folder


class Scratch:
    """A folder of its own in the shared folder for the tables of one operator.

    A kept table cuts the lineage, survives lost executors, is computed once, and has a known size, so that Spark itself broadcasts it in a join if it's small and not otherwise.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables kept here; nothing that still depends on them may be run afterwards."""
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; later steps read the kept rows."""
    return Scratch(df.sparkSession).keep(df)
