"""Joins whose left key may be hot.

A third of all left rows may share one key. While the right side is small enough
for Catalyst to broadcast, skew does not matter. Beyond that the adaptive skew
join splits the oversized left partition at run time, without a further pass.
Where a session has that switched off, hot keys are found with a pre-aggregated
count and only those are spread: left rows take one of as many salts as their key
needs, the few matching right rows are repeated for each salt. The result is the plain join,
row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the left rows, so there are
# never more than 1 / HOT_SHARE hot keys and their list is safe to broadcast.
HOT_SHARE = 0.001


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size estimate is within its own broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def splits_skew(df: DataFrame, forced: bool = True) -> bool:
    """Whether the session splits skewed join partitions by itself. Unless that is
    ``forced``, Spark passes over a split that would cost it a shuffle."""
    conf = df.sparkSession.conf
    wanted = {"enabled": "true", "skewJoin.enabled": "true"}
    if forced:
        wanted["forceOptimizeSkewedJoin"] = "false"
    return all(conf.get(f"spark.sql.adaptive.{k}", default) == "true" for k, default in wanted.items())


def hot_counts(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows, at most ``1 / share`` of them, with
    how many times that share each holds (rounded up)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = F.lit(share) * counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_times"))


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    return hot_counts(df, keys, share).select(*keys)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] = (),
    moves_on: bool = False,
) -> DataFrame:
    """Join ``left`` to ``right`` on equal columns when a left key may be hot.

    ``salt_by`` names left columns that vary inside a hot key (a row id). ``how``
    is one of inner, left, left_semi, left_anti. ``moves_on`` says that the rows are
    written or shuffled by another key next, so that a split costs no shuffle.
    """
    if not salt_by or splits_skew(left, not moves_on) or fits_broadcast(right):
        return left.join(right, list(on), how)
    return salted_join(left, right, on, how, salt_by)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    salt_by: Sequence[str],
    spread: int | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """The join with hot left keys spread, each over as many salts as leave ``share`` of
    all rows to one, or over ``spread``. A salt is a function of its row, so a task
    that runs again sends its rows the same way."""
    on = list(on)
    salts = F.col("_times") if spread is None else F.lit(spread)
    hot = F.broadcast(hot_counts(left, on, share).select(*on, salts.alias("_salts")))
    no_key = F.lit(False)
    for k in on:  # null keys match nothing but would all meet in one task
        no_key |= F.col(k).isNull()
    spread_over = F.when(no_key, F.lit(spread or int(1 / share))).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), spread_over).cast("int")
    copy = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    marked = left.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    copies = right.join(hot, on, "left").withColumn("_salt", copy).drop("_salts")
    return marked.join(copies, [*on, "_salt"], how).drop("_salt")
