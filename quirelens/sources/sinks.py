"""Change-only writes and a baseline that advances only on success."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelens.functions.hashing import WHOLE
from quirelens.operators.diff import fingerprint, snapshot_diff
from quirelens.plans.lineage import cut


class TargetMoved(ValueError):
    """The target changed since the baseline was read; it is left alone."""


class IncompleteOutput(ValueError):
    """The new rows do not cover every part the target holds."""


class TooManyParts(ValueError):
    """The write would go over the limit of parts that the caller set."""


class EmptyPart(ValueError):
    """A part has an empty name."""


def row_hash(df: DataFrame, exclude=()) -> F.Column:
    cols = sorted(c for c in df.columns if c not in exclude)
    return F.sha2(F.to_json(F.struct(*cols), WHOLE), 256)


def part_states(df: DataFrame, part: str) -> DataFrame:
    """Row count and order-free fingerprint of each part."""
    return fingerprint(df.withColumn("_h", row_hash(df)), [part], "_h", bag=True)


def write_plan(new: DataFrame, current: DataFrame, part: str) -> DataFrame:
    """What a write would do to each part: added, changed, equal or removed."""
    old, fresh = part_states(current, part), part_states(new, part)
    return snapshot_diff(old, fresh, [part], "fingerprint")


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_changed(
    new: DataFrame,
    path: str,
    part: str,
    baseline: DataFrame | None = None,
    limit: int | None = None,
    stage: bool = True,
) -> DataFrame:
    """Rewrite only the parts whose content differs; equal parts stay untouched.

    ``baseline`` holds part and fingerprint as read before the work began. Every
    check runs before the first write. The new rows are staged first, so what is
    written is what was checked, even when they derive from the target itself;
    ``stage=False`` is for rows that already are a stored table. The parts to write
    are written beside the target and moved in when all are there; a move that was
    broken off is finished by the next write. A null part is a part; an empty one,
    which a folder name cannot tell from it, is refused. Returns part and status.
    """
    spark = new.sparkSession
    target = _Target(spark, path)
    target.finish()
    if stage:
        new = cut(new)
    if isinstance(new.schema[part].dataType, T.StringType) and not new.filter(F.col(part) == "").isEmpty():
        raise EmptyPart(path)
    current = _read(spark, path, new.schema)
    if current is None:
        current = spark.createDataFrame([], new.schema)
    plan = cut(write_plan(new, current, part))
    if baseline is not None:
        drift = snapshot_diff(baseline, plan.filter("status <> 'added'").select(part, F.col("old_hash").alias("fingerprint")), [part], "fingerprint")
        if not drift.filter("status <> 'equal'").isEmpty():
            raise TargetMoved(path)
    if not plan.filter("status = 'removed'").isEmpty():
        raise IncompleteOutput(path)
    if limit is not None and (n_parts := plan.count()) > limit:
        raise TooManyParts(f"{n_parts} parts, limit {limit}")
    todo = plan.filter("status in ('added', 'changed')").select(F.col(part).alias("_part"))
    if not todo.isEmpty():
        rows = new.join(todo, F.col(part).eqNullSafe(F.col("_part")), "left_semi")
        rows.write.partitionBy(part).parquet(target.staging())
        target.finish()
    return plan.select(part, "status")


class _Target:
    """A folder of part folders, and what is to be moved into it.

    Staged parts lie in a folder whose name readers pass over. Spark marks it when it
    is complete; from then on its parts belong into the target, and moving them can be
    taken up again at any point.
    """

    STAGED, OLD = "_staged-", "_old-"

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = self._path(path)
        self._fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def staging(self) -> str:
        return f"{self.root.toString()}/{self.STAGED}{uuid.uuid4().hex}"

    def _names(self, folder) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder))

    def finish(self) -> None:
        if not self._fs.exists(self.root):
            return
        for name in self._names(self.root):
            folder = self._path(self.root, name)
            if name.startswith(self.STAGED) and self._fs.exists(self._path(folder, "_SUCCESS")):
                self._move_in(folder, self._path(self.root, self.OLD + name.removeprefix(self.STAGED)))
            elif name.startswith(self.OLD) and self.STAGED + name.removeprefix(self.OLD) not in self._names(self.root):
                self._fs.delete(folder, True)

    def _move_in(self, staged, old) -> None:
        self._fs.mkdirs(old)
        for name in self._names(staged):
            if name[:1] in "._":
                continue
            place = self._path(self.root, name)
            if self._fs.exists(place) and not self._fs.exists(self._path(old, name)):
                self._fs.rename(place, self._path(old, name))
            if not self._fs.rename(self._path(staged, name), place):
                raise TargetMoved(f"{name} appeared during the move")
        self._fs.delete(staged, True)
        self._fs.delete(old, True)


class BaselineStore:
    """Versions of a baseline under one folder.

    A version's rows are written to a folder of their own; then a marker that names
    the folder is created, which fails if another run has taken the number. A reader
    sees the last version that has a marker. A failed attempt leaves earlier versions
    as they were and is recorded with its whole reason.
    """

    MARKER = ".complete"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(path).getFileSystem(conf)

    def _versions(self) -> list[int]:
        root = self._hadoop.Path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        stems = [n.removesuffix(self.MARKER) for n in names if n.endswith(self.MARKER)]
        return sorted(int(n[1:]) for n in stems if n.startswith("v") and n[1:].isdigit())

    def _marker(self, number: int):
        return self._hadoop.Path(f"{self.path}/v{number}{self.MARKER}")

    def read(self) -> DataFrame | None:
        """The last baseline, or None before the first run."""
        versions = self._versions()
        if not versions:
            return None
        stream = self._fs.open(self._marker(versions[-1]))
        try:
            folder = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def advance(self, df: DataFrame) -> int:
        versions = self._versions()
        number = versions[-1] + 1 if versions else 1
        folder = f"v{number}-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.path}/{folder}")
            try:
                stream = self._fs.create(self._marker(number), False)
            except Py4JJavaError as error:
                raise TargetMoved(f"version {number} appeared during the run") from error
            stream.write(bytearray(folder.encode()))
            stream.close()
        except Exception as error:
            self._record(number, "failed", str(error))
            raise
        self._record(number, "updated", None)
        return number

    def _record(self, number: int, status: str, reason: str | None) -> None:
        self.spark.createDataFrame(
            [(number, status, reason)], "version int, status string, reason string"
        ).write.mode("append").parquet(f"{self.path}/attempts")

    def attempts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/attempts")
