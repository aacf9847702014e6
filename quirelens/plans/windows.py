"""Windows over groups of any size.

``latest`` needs one row per key, so a rank filter lets every map task keep its
best row before the shuffle. ``next_in_group`` needs real neighbours: rows are cut
into ranges by key and order, so that a group of any size spreads over tasks, with a
stitch between the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelens.plans.lineage import cut


def latest(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key under ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def next_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "next_",
    group_rows: int | None = None,
) -> DataFrame:
    """Add, for every row, ``columns`` of the following row of its group.

    ``order`` is ascending and total inside a group. The last row of a group gets
    nulls. ``group_rows`` sets how many rows a range is to hold; without it the
    session's number of shuffle partitions does.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    ahead = _chunked_lead(df, keys, order, columns, group_rows)
    return ahead.select(
        *df.columns, *[F.col("_ahead")[c].alias(prefix + c) for c in columns]
    )


def _chunked_lead(df, keys, order, columns, rows: int | None) -> DataFrame:
    # Range partitioning on key and order splits a hot key by its order. The chunk
    # number is written down, so both uses below read the same one.
    by = [F.col(c) for c in keys + order]
    ranged = df.repartitionByRange(*by) if rows is None else df.repartitionByRange(-(-max(1, df.count()) // rows), *by)
    chunked = cut(ranged.withColumn("_chunk", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    # One row per key and chunk: a key never has more of them than there are chunks.
    heads = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_head"))
        .withColumn("_next_head", F.lead("_head").over(across))
        .select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_chunk").alias("_c"), "_next_head")
    )
    same = F.col("_chunk") == F.col("_c")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col("_k_" + k))
    return (
        chunked.withColumn("_inner", F.lead(F.struct(*columns)).over(inside))
        .join(heads, same, "left")
        .withColumn("_ahead", F.coalesce("_inner", "_next_head"))
    )
