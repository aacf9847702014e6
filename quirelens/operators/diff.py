"""Snapshots, manifests, sets and multisets compared by key and content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.functions.hashing import is_digest
from quirelens.functions.paths import is_safe_path
from quirelens.plans.frames import null_safe_join, union_all
from quirelens.plans.skew import lookup_join

# A digest is read as five words of 12 hex digits. A word fits decimal(18,0) and
# a sum of words fits decimal(28,0) up to 3e13 rows per group.
WORDS, DIGITS = 5, 12


def fingerprint(df: DataFrame, group: Sequence[str], digest: str, bag: bool = False) -> DataFrame:
    """Hash of each group's set of row digests, whatever their order.

    Digest words are summed, so every map task sends one row per group and no
    group is ever collected. A set ignores repeats; ``bag`` counts them.
    """
    rows = df.select(*group, digest)
    if not bag:
        rows = rows.distinct()
    words = [
        F.conv(F.substring(digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("bigint").cast("decimal(18,0)")
        for i in range(WORDS)
    ]
    sums = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]
    )
    text = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(WORDS)])
    return sums.select(*group, "n_rows", F.sha2(text, 256).alias("fingerprint"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """added, removed, changed or equal for each key. A renamed row is one removed
    and one added. Keys are unique on each side; null keys and hashes equal each other."""
    a = old.select(*key, F.col(digest).alias("old_hash"), F.lit(True).alias("_old"))
    b = new.select(*key, F.col(digest).alias("new_hash"), F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "equal")
        .otherwise("changed")
    )
    return null_safe_join(a, b, key, "full_outer").select(*key, "old_hash", "new_hash", status.alias("status"))


def freshness(expected: DataFrame, actual: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """Expected outputs that are missing or stale, with both byte lengths."""
    a = expected.select(
        *key, F.octet_length(content).alias("expected_bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("_e")
    )
    b = actual.select(
        *key, F.octet_length(content).alias("actual_bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("_a"),
        F.lit(True).alias("_found"),
    )
    return (
        null_safe_join(a, b, key, "left")
        .withColumn("status", F.when(F.col("_found").isNull(), "missing").when(~F.col("_e").eqNullSafe(F.col("_a")), "stale"))
        .filter("status is not null")
        .select(*key, "status", "expected_bytes", "actual_bytes")
    )


def verify_manifest(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Check ``declared(path, sha256)`` against ``actual(path, sha256)``.

    Unsafe path, malformed hash, missing file and mismatch are told apart; a
    manifest without rows yields the single row 'empty manifest'.
    """
    found = actual.select("path", F.col("sha256").alias("actual_sha256"), F.lit(True).alias("_found"))
    status = (
        F.when(~is_safe_path("path"), "unsafe path")
        .when(~is_digest("sha256"), "malformed hash")
        .when(F.col("_found").isNull(), "missing file")
        .when(F.col("sha256") == F.col("actual_sha256"), "ok")
        .otherwise("mismatch")
    )
    rows = declared.join(found, "path", "left").select("path", "sha256", "actual_sha256", status.alias("status"))
    none = F.lit(None).cast("string")
    empty = (
        declared.agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(none.alias("path"), none.alias("sha256"), none.alias("actual_sha256"), F.lit("empty manifest").alias("status"))
    )
    return rows.unionByName(empty)


def same_identity(manifests: DataFrame, artifact: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Manifests with the fields in which they differ from the one artifact row."""
    truth = artifact.select(F.struct(*fields).alias("_t")).scalar()
    wrong = F.array_compact(
        F.array(*[F.when(~F.col(f).eqNullSafe(truth[f]), F.lit(f)) for f in fields])
    )
    return manifests.withColumn("differs", wrong).withColumn("bound", F.size("differs") == 0)


def missing_members(required: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    return null_safe_join(required.select(*key).distinct(), actual.select(*key).distinct(), key, "left_anti")


def set_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Members of only one of two sets, with the side that has them."""
    left = missing_members(a, b, key).withColumn("only_in", F.lit("left"))
    right = missing_members(b, a, key).withColumn("only_in", F.lit("right"))
    return left.unionByName(right)


def not_subset(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Members of ``a`` that ``b`` lacks; empty when ``a`` is a subset."""
    return missing_members(a, b, key)


def reconcile(planned: DataFrame, executed: DataFrame, key: str) -> DataFrame:
    """Problems between a planned list and what was executed.

    The lists must agree with multiplicity, the plan must be free of repeats and
    not empty, and nothing may be marked ``not_passed``. No rows means all agree.
    """
    a = planned.groupBy(key).agg(F.count(F.lit(1)).alias("n_planned"))
    b = executed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_executed"), F.count_if("not_passed").alias("n_not_passed")
    )
    counts = null_safe_join(a, b, [key], "full_outer").na.fill(0, ["n_planned", "n_executed", "n_not_passed"])
    problem = (
        F.when(F.col("n_planned") == 0, "unplanned")
        .when(F.col("n_planned") > 1, "planned twice")
        .when(F.col("n_executed") == 0, "not executed")
        .when(F.col("n_executed") != F.col("n_planned"), "count differs")
        .when(F.col("n_not_passed") > 0, "not passed")
    )
    rows = counts.withColumn("problem", problem).filter("problem is not null")
    empty = (
        planned.agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(
            F.lit(None).cast(planned.schema[key].dataType).alias(key), F.lit(0).cast("bigint").alias("n_planned"),
            F.lit(0).cast("bigint").alias("n_executed"), F.lit(0).cast("bigint").alias("n_not_passed"),
            F.lit("empty plan").alias("problem"),
        )
    )
    return rows.unionByName(empty)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(frames).distinct()


def append_absent(base: DataFrame, extra: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` and, once each, the members of ``extra`` it lacks."""
    new = null_safe_join(extra.dropDuplicates(list(key)), base.select(*key).distinct(), key, "left_anti")
    return base.unionByName(new)


def resolve_alias(df: DataFrame, aliases: DataFrame, column: str, salt_by: Sequence[str] = ()) -> DataFrame:
    """Replace renamed keys: ``aliases(old_key, new_key)``; other keys stay."""
    names = aliases.select(F.col("old_key").alias(column), "new_key")
    out = lookup_join(df, names, [column], "left", salt_by)
    return out.withColumn(column, F.coalesce("new_key", column)).drop("new_key").select(*df.columns)


def size_guard(tracked: DataFrame, added: DataFrame, path: str, limit: int, forbidden: Sequence[str]) -> DataFrame:
    """One row: distinct paths, how many are forbidden, and whether all is well."""
    paths = union_distinct(tracked.select(path), added.select(path))
    hit: Column = F.lit(False)
    for pattern in forbidden:
        hit |= F.col(path).rlike(pattern)
    return paths.agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(hit).alias("n_forbidden")).withColumn(
        "ok", (F.col("n_paths") <= limit) & (F.col("n_forbidden") == 0)
    )
