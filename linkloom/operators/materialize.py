"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local session may leave it unset and
    gets a folder of its own; executors elsewhere would not see that."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def materialized(df: DataFrame) -> DataFrame:
    """df computed once and read back from the checkpoint folder; lost executors lose nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """df written once as Parquet below the checkpoint folder and reread, with its columns prunable. The
    files go when the application ends."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = file_system(df.sparkSession, path)
    system.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are worth a task.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many tasks as about so many rows of a few numbers need, one a core at least. Adaptive execution does the
    same where a session lets it; without it a small table is written as one file for each shuffle partition."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // TASK_ROWS))


class Scratch:
    """Intermediate tables in one folder below the checkpoint folder, deleted together.

    ``keep`` writes a table once and rereads it, with its columns prunable; whatever outlives ``clear``
    must not read from it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        system, path = file_system(self.spark, self.path)
        system.delete(path, True)
