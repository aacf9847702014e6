"""Declared keys, domains and relationships checked against rows.

Spark does not enforce constraints, so each becomes a frame of violations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelens.functions.paths import is_safe_path
from quirelens.functions.text import line_count
from quirelens.operators.search import with_groups
from quirelens.plans.frames import union_all
from quirelens.plans.skew import lookup_join

Pairs = Sequence[tuple[str, str]]


def _all_set(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _parent_keys(parent: DataFrame, on: Pairs) -> DataFrame:
    return parent.select(*[F.col(p).alias(c) for c, p in on])


def fk_orphans(child: DataFrame, parent: DataFrame, on: Pairs, salt_by: Sequence[str] = ()) -> DataFrame:
    """Child rows whose complete key has no parent. A key with any null is exempt."""
    cols = [c for c, _ in on]
    return lookup_join(child.filter(_all_set(cols)), _parent_keys(parent, on), cols, "left_anti", salt_by)


def _key_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """One text for a complete key, null for a key with any null. Bytes count as hex,
    as not all are text, and JSON keeps the parts of a composite key apart."""
    binary = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)}
    cast = [(F.hex(c) if c in binary else F.col(c).cast("string")).alias(str(i)) for i, c in enumerate(columns)]
    whole = cast[0] if len(columns) == 1 else F.to_json(F.struct(*cast))
    return F.when(_all_set(columns), whole)


def key_usage(references: Sequence[tuple[str, DataFrame, DataFrame, Pairs]]) -> DataFrame:
    """Child and parent rows of every key of every reference.

    Children and parents of all references are counted by (reference, key) in one
    aggregate instead of one join each, and a table that takes part in several is
    read once. Counts combine before the shuffle, so neither a hot key nor the rows
    without a key gather in one task.
    """
    tables: list[tuple[DataFrame, list[Column]]] = []
    for name, child, parent, on in references:
        for frame, columns, is_child in ((child, [c for c, _ in on], 1), (parent, [p for _, p in on], 0)):
            side = F.struct(
                F.lit(name).alias("reference"), _key_text(frame, columns).alias("key"),
                F.lit(is_child).alias("_child"), F.lit(1 - is_child).alias("_parent"),
            )
            known = next((sides for seen, sides in tables if seen is frame or seen.sameSemantics(frame)), None)
            if known is None:
                tables.append((frame, [side]))
            else:
                known.append(side)
    rows = union_all([frame.select(F.explode(F.array(*sides)).alias("u")).select("u.*") for frame, sides in tables])
    return rows.groupBy("reference", "key").agg(F.sum("_child").alias("n_child"), F.sum("_parent").alias("n_parent"))


def fk_summary(references: Sequence[tuple[str, DataFrame, DataFrame, Pairs]]) -> DataFrame:
    """Child, exempt and orphan rows of each reference."""
    n = F.col("n_child")
    no_key, no_parent = F.col("key").isNull(), F.col("n_parent") == 0
    counts = key_usage(references).groupBy("reference").agg(
        F.sum(n).alias("child_rows"),
        F.coalesce(F.sum(F.when(no_key, n)), F.lit(0)).alias("exempt_rows"),
        F.coalesce(F.sum(F.when(~no_key & no_parent, n)), F.lit(0)).alias("orphan_rows"),
    )
    return _every_reference(references, counts, ["child_rows", "exempt_rows", "orphan_rows"])


def _every_reference(references, counts: DataFrame, zero: Sequence[str]) -> DataFrame:
    """A row also for references whose two tables are empty."""
    names = counts.sparkSession.createDataFrame([(r[0],) for r in references], "reference string")
    return names.join(counts, "reference", "left").na.fill(0, list(zero))


def audit_inventory(inventory, store: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Summary of every declared reference whose two tables are given."""
    declared = inventory.references.filter(F.col("store") == store).orderBy("table", "id").collect()
    refs = [
        (f"{r['table']}_{r['id']}", tables[r["table"]], tables[r["target_table"]],
         list(zip(r["from_columns"], r["to_columns"])))
        for r in declared
        if r["table"] in tables and r["target_table"] in tables
    ]
    return fk_summary(refs)


def key_dups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. Keys with a null never collide."""
    return df.filter(_all_set(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_dups_where(df: DataFrame, key: Sequence[str], predicate: Column) -> DataFrame:
    """Repeats among the rows the predicate holds for; other rows may repeat."""
    return key_dups(df.filter(predicate), key)


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count of each column that must not be null."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_null")) for i, c in enumerate(columns)])
    )
    return one.select("n_rows", pairs.alias("p")).select("p.column_name", "p.n_null", "n_rows")


def relationship_profile(references: Sequence[tuple[str, DataFrame, DataFrame, Pairs]]) -> DataFrame:
    """What the rows of each reference show: a parent always or sometimes, one child
    or many, and how many parents have none (a parent never needs one)."""
    keyed = F.col("key").isNotNull()
    used = keyed & (F.col("n_child") > 0)
    shape = key_usage(references).groupBy("reference").agg(
        F.sum("n_child").alias("child_rows"),
        F.coalesce(F.sum(F.when(~keyed, F.col("n_child"))), F.lit(0)).alias("null_rows"),
        F.count_if(used).alias("used_parents"),
        F.coalesce(F.max(F.when(used, F.col("n_child"))), F.lit(0)).alias("_most"),
        F.coalesce(F.sum(F.when(~used, F.col("n_parent"))), F.lit(0)).alias("childless_parents"),
    )
    counts = ["child_rows", "null_rows", "used_parents", "childless_parents"]
    return _every_reference(references, shape, [*counts, "_most"]).select(
        "reference", *counts[:3],
        F.when(F.col("null_rows") == 0, "exactly one").otherwise("zero or one").alias("parent_side"),
        F.when(F.col("_most") <= 1, "zero or one").otherwise("many").alias("child_side"),
        "childless_parents",
    )


def bad_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, once per missing end."""
    out = []
    for end, other in (("source", "target"), ("target", "source")):
        known = nodes.select(F.col("node").alias(end))
        out.append(lookup_join(edges, known, [end], "left_anti", [other]).withColumn("missing_end", F.lit(end)))
    return out[0].unionByName(out[1])


def boundary_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Physical edges that cross groups and logical edges that stay inside one."""
    crosses = ~F.col("source_group").eqNullSafe(F.col("target_group"))
    broken = ((F.col("kind") == "physical") & crosses) | ((F.col("kind") == "logical") & ~crosses)
    return with_groups(edges, nodes).filter(broken)


def unclassified(entities: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Entities in no group or in several; ``groups`` holds key and group."""
    n_groups = groups.select(key, "group").distinct().groupBy(key).agg(F.count("group").alias("n_groups"))
    return (
        entities.select(key)
        .distinct()
        .join(n_groups, key, "left")
        .na.fill(0, ["n_groups"])
        .filter("n_groups <> 1")
    )


def id_mismatch(df: DataFrame, column: str, formula: Column) -> DataFrame:
    """Rows whose id is not what the formula makes of their other columns."""
    return df.withColumn("expected_id", formula).filter(~F.col(column).eqNullSafe(F.col("expected_id")))


def domain_violations(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows whose value is outside the closed set, null included."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def uncited(df: DataFrame, citations: str) -> DataFrame:
    """Rows that carry no citation."""
    return df.filter(F.col(citations).isNull() | (F.size(citations) < 1))


def bad_citations(
    cites: DataFrame, files: DataFrame, key: str, line: str, text: str, salt_by: Sequence[str] = (), roots: Sequence[str] | None = None
) -> DataFrame:
    """Citations of a missing file, or of a line below 1 or past the file's end.

    With ``roots`` keys are paths, and one that is absolute, climbs, holds a backslash
    or begins with none of these folders is refused before it is looked up.
    """
    sizes = files.select(key, line_count(text).alias("n_lines"))
    refused = F.lit(False)
    if roots is not None:
        path = F.col(key).cast("string")
        inside = F.split_part(path, F.lit("/"), F.lit(1)).isin(*roots) & path.contains("/")
        refused = ~F.coalesce(is_safe_path(path) & inside, F.lit(False))
    reason = (
        F.when(refused, "invalid path")
        .when(F.col(line).isNull() | (F.col(line) < 1), "invalid line")
        .when(F.col("n_lines").isNull(), "missing file")
        .when(F.col(line) > F.col("n_lines"), "line outside file")
    )
    return lookup_join(cites, sizes, [key], "left", salt_by).withColumn("reason", reason).filter("reason is not null")
