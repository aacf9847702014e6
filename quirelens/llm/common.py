"""What several of these operators share: words, stable numbering, running totals."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import quirelens
from quirelens.plans.lineage import cut, scratch_path

# Fixed value: a word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
_PID_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application.

    Operators with Python stages call it, so that they also run where the package is
    installed on the driver alone. The archive goes through the shared folder.
    """
    context = spark.sparkContext
    if getattr(context, "_quirelens", False):
        return
    root = Path(quirelens.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root).as_posix()}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark)}/{root.name}.zip")
    stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(place.toString())
    context._quirelens = True


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_order(df: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """The rows written down in ascending order of ``keys``, with their place in ``at``.

    Places grow with the keys but have gaps between partitions. The order is made by
    range partitioning, so no task holds more than its range, and it is written once,
    so every later read sees the same places.
    """
    cols = [F.col(k).asc_nulls_last() for k in keys]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return cut(placed.withColumn(at, F.monotonically_increasing_id()))


def running(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str | None = None) -> DataFrame:
    """Add ``rank`` (from 1) and, for ``value``, ``total`` (up to and with the row) in each group.

    A group of any size is spread over range partitions; what joins them is one row
    per group and partition that it reaches into. ``order`` should be total: rows that
    tie get different ranks in any order.
    """
    groups = list(groups)
    rows = in_order(df, [*groups, *order]).withColumn("_pid", F.shiftright("at", _PID_BITS))
    sums = [F.sum(value).alias("_sum")] if value else []
    chunks = rows.groupBy(*groups, "_pid").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"), *sums)
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before")]
    if value:
        before.append(F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"))
    chunks = chunks.select(*groups, "_pid", "_first", *before)
    right = chunks.select(*[F.col(c).alias("_c" + c) for c in [*groups, "_pid"]], *[c for c in chunks.columns if c not in (*groups, "_pid")])
    on = F.lit(True)
    for c in [*groups, "_pid"]:
        on = on & F.col(c).eqNullSafe(F.col("_c" + c))
    out = rows.join(right, on).withColumn("rank", F.col("at") - F.col("_first") + F.col("_n_before") + 1)
    extra = ["rank"]
    if value:
        inside = Window.partitionBy("_pid", *groups).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("total", F.sum(value).over(inside) + F.col("_sum_before"))
        extra.append("total")
    return out.select(*df.columns, *extra)
