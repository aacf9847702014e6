"""Lineage cuts for iterative plans.

A loop that joins its own result again needs its plan cut between rounds. The cut
is a parquet table in the shared folder named by ``spark.checkpoint.dir``, so a
lost executor re-reads files and Catalyst sees the real size of each round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names. Only a local master that names none, where all
    tasks share the machine, gets one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    return shared_path(spark, uuid.uuid4().hex)


def shared_path(spark: SparkSession, name: str) -> str:
    """The path of that name in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/quirelens-{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(hadoop).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    pieces = Pieces()
    out = pieces.add(df)
    out._scratch = pieces.paths
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of cut tables that nothing will read again: a loop's last round
    once the next one is written."""
    for df in tables:
        for path in getattr(df, "_scratch", ()):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Pieces:
    """Rows gathered over the rounds of a loop.

    Each round is written once and all rounds are read by a single scan, so the
    plan does not grow with the number of rounds.
    """

    def __init__(self):
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        self.spark, self.schema = df.sparkSession, df.schema
        path = scratch_path(self.spark)
        # Texts take six tenths of the room that the default codec leaves them. Other tables keep that codec:
        # Catalyst takes a file's size for that of its rows when it chooses what to broadcast.
        writer = df.write.option("compression", "zstd") if "text" in df.columns else df.write
        writer.parquet(path)
        self.paths.append(path)
        return self._scan(path)

    def all(self) -> DataFrame:
        return self._scan(*self.paths)

    def _scan(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)
