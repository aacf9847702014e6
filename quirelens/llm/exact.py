"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import in_order, text_of
from quirelens.plans.frames import union_all
from quirelens.plans.lineage import cut

BLOCK = 2048


def _digest(block, bits: int):
    return F.xxhash64(block) if bits >= 64 else F.shiftrightunsigned(F.xxhash64(block), 64 - bits)


def _blocks(documents: DataFrame, size: int, bits: int) -> DataFrame:
    """One row per fixed-size block: idx, block and its hash, with what the row carries."""
    text = text_of()
    count = F.greatest(F.lit(1), F.ceil(F.char_length(text) / F.lit(size)).cast("int"))
    cut_up = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    rows = documents.select("doc_id", "_doc", "sha", count.alias("blocks"), F.posexplode(cut_up).alias("idx", "block"))
    return rows.withColumn("h", _digest(F.col("block"), bits))


def _name(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of ``rows`` replaced by one integer: the place of their values in sorted order."""
    names = in_order(rows.select(*keys).distinct(), keys, "name")
    right = names.select(*[F.col(k).alias("_k_" + k) for k in keys], "name")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col("_k_" + k))
    return rows.join(right, on).drop(*keys, *["_k_" + k for k in keys])


def identities(documents: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, blocks and name: texts are equal when blocks and name are.

    Texts are cut into blocks of ``block`` characters. Distinct blocks are sorted, by
    their hash and among equal hashes by their bytes, and named by their place. Then
    adjacent names are paired, distinct pairs are sorted and named in turn, and so on
    until one name is left, after log2 of the largest number of blocks rounds. A name
    stands for one content only: all distinct blocks are compared by their bytes in one
    aggregate, and where two share a hash (``hash_bits`` is there to test that) their
    rows are told apart by content. Texts are shuffled once, names are integers.
    """
    numbered = documents.select("doc_id", "text").withColumn("sha", F.unhex(F.sha2(text_of(), 256)))
    rows = _blocks(numbered.withColumn("_doc", F.monotonically_increasing_id()), block, hash_bits)
    narrow = cut(rows.drop("block"))
    # Content alone decides here, so it does not matter how this second scan numbers its rows.
    distinct = rows.select("h", "block").distinct()
    clashing = cut(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    if clashing.isEmpty():
        narrow = narrow.withColumn("tie", F.lit(0).cast("bigint"))
    else:
        told = in_order(distinct.join(clashing, "h", "left_semi"), ["h", "block"], "tie")
        # The documents' own content finds the row again: doc_id, digest and place.
        own = rows.join(told, ["h", "block"]).select(
            F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("idx").alias("_idx"), "tie"
        ).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("idx") == F.col("_idx"))
        narrow = narrow.join(own, match, "left").withColumn("tie", F.coalesce("tie", F.lit(-1))).drop("_id", "_sha", "_idx")
    level = cut(_name(narrow, ["h", "tie"]))
    most, done = level.agg(F.max("blocks")).first()[0] or 0, []
    left = F.col("blocks")
    while most > 1:
        # Documents of one name rest; the others go on with half as many names.
        done.append(level.filter(left == 1))
        pairs = level.filter(left > 1).groupBy("_doc", F.shiftright("idx", 1).alias("idx")).agg(
            *[F.first(c).alias(c) for c in ("doc_id", "sha", "blocks")],
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        level = cut(_name(pairs, ["a", "b"]))
        left, most = F.ceil(left / 2), (most + 1) // 2
    named = union_all([*done, level])
    return named.select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "blocks", "name")


def exact_duplicates(documents: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per document.

    Of equal texts the largest doc_id stays. A null text equals an empty one. A row
    with a null doc_id stays only when all of its group have none (keep_id is null
    then). Repeated rows of the largest doc_id are all marked as kept: the id stays.
    Whole texts count, of any length; other columns are left alone; an empty table
    gives no rows.
    """
    named = cut(identities(documents, block, hash_bits))
    groups = cut(named.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    out = named.join(groups, ["blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
