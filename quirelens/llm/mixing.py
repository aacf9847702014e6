"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm.common import WORD, fresh, running, text_of
from quirelens.plans.lineage import cut

# Expected copies are counted in units of 2**-24 so that prefix sums are exact.
UNIT_BITS = 24
SEED = 20


def offset_of(seed: int) -> int:
    """The random offset, in the same units."""
    return random.Random(seed).randrange(1 << UNIT_BITS)


def sizes(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size in words and ``keep``; a null text has size 0."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")
    return documents.select("doc_id", "source", size.alias("size"), *keep)


def targets(sized: DataFrame, share: float, cycle: Sequence[int], most: float) -> DataFrame:
    """source, source_size and target, one row per source.

    Sources in code point order, null last, take the weights of ``cycle`` in turn and
    split ``share`` times all sizes by weight. A target stops at ``most`` times its
    source's size and what it leaves is shared out again. Where that ends is a level:
    ``target = min(most * size, level * weight)``. With sources in the order in which
    they reach their limit, the level is the largest of (what the earlier ones leave)
    / (weight of the others). Both windows run over one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    weighed = by_source.withColumn("weight", F.get(weights, place % len(cycle)))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = weighed.withColumn("_level", (budget - full) / others)
    level = level.withColumn("_level", F.max("_level").over(everything))
    return level.select("source", "source_size", F.least("limit", F.col("_level") * F.col("weight")).alias("target"))


def mix(
    documents: DataFrame,
    share: float = 1.5,
    cycle: Sequence[int] = (3, 1, 2),
    most: float = 2.0,
    seed: int = SEED,
    keep: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and ``keep`` for every row.

    Every document of a source expects target / source_size copies. The prefix sum of
    that over the source, ordered by size and doc_id, plus one random offset drawn from
    ``seed``, crosses a number of whole numbers at each document: its copies. Ordered
    by size, the copies spread over short and long documents alike, so the words taken
    differ from the target by no more than about one long document. Counts are exact
    integers, so a document never gets more than ``most`` (rounded up) copies.

    Repeated rows each count as a document; of equal sizes and ids, columns of ``keep`` named in
    ``ties`` decide which row comes first. Rows with a null doc_id come last among
    equal sizes, a null source is a source of its own, a text without words takes
    nothing, and an empty table gives no rows. Other columns are left alone.
    """
    if not cycle or min(cycle) <= 0 or share < 0 or most < 0:
        raise ValueError("weights must be positive, share and most not negative")
    sized = cut(sizes(documents, keep))
    aim = cut(targets(sized, share, cycle, most))
    ranked = running(sized, ["source"], ["size", "doc_id", *ties])
    right = aim.select(F.col("source").alias("_source"), "source_size", "target")
    out = ranked.join(right, F.col("source").eqNullSafe(F.col("_source")))
    unit, offset = 1 << UNIT_BITS, offset_of(seed)
    each = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    out = out.withColumn("_each", F.floor(each * unit + F.lit(0.5)).cast("bigint"))
    upto = F.shiftright(F.col("rank") * F.col("_each") + F.lit(offset), UNIT_BITS)
    before = F.shiftright((F.col("rank") - 1) * F.col("_each") + F.lit(offset), UNIT_BITS)
    out = out.withColumn("copies", (upto - before).cast("bigint"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", taken, *keep)


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The documents with their columns, every row as many times as the mixture takes it."""
    row, copies, digest = fresh(documents, "_row"), fresh(documents, "_copies"), fresh(documents, "_digest")
    # Written down, as the number of a row must be the same in both reads.
    numbered = cut(documents.withColumn(row, F.monotonically_increasing_id()))
    # The row's number depends on the partitions; the text's hash does not, so reruns take the same texts.
    drawn = mix(numbered.withColumn(digest, F.xxhash64(text_of())), keep=[row, digest], ties=[digest], **how).filter("copies > 0")
    drawn = drawn.select(F.col(row).alias("_drawn"), F.col("copies").cast("int").alias(copies))
    taken = numbered.join(drawn, F.col(row) == F.col("_drawn"))
    return taken.select(*documents.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*documents.columns)
