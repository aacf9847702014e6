"""Explorer filters: names, fields, whole records, edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.plans.skew import lookup_join


def name_or_member(name: str, members: str, query: str) -> Column:
    """The lowered query is in the name or in any member; an empty one keeps all."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    return F.coalesce(
        F.lower(name).contains(q) | F.coalesce(F.exists(members, lambda m: F.lower(m).contains(q)), F.lit(False)), F.lit(False)
    )


def search_entities(
    df: DataFrame, query: str, name: str, members: str, group: str | None = None, value: str = "all"
) -> DataFrame:
    out = df if group is None or value == "all" else df.filter(F.col(group) == value)
    return out.filter(name_or_member(name, members, query))


def search_fields(
    df: DataFrame, query: str, fields: Sequence[str], domain: str | None = None, value: str = "all"
) -> DataFrame:
    """Lowered query in the fields and array items joined by blanks, within a domain."""
    text = F.lower(F.concat_ws(" ", *fields))
    out = df if domain is None or value == "all" else df.filter(F.col(domain) == value)
    return out.filter(text.contains(query.strip().lower()))


def search_records(df: DataFrame, query: str) -> DataFrame:
    """Lowered query anywhere in the record's JSON, which keeps null fields."""
    return df.filter(F.lower(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).contains(query.lower()))


def match_counts(df: DataFrame, predicate: Column, *group: str) -> DataFrame:
    """Shown and total rows of a filter."""
    return df.groupBy(*group).agg(
        F.count_if(predicate).alias("n_shown"), F.count(F.lit(1)).alias("n_total")
    )


def group_counts(df: DataFrame, group: str, label: Column | None = None) -> DataFrame:
    """Rows per group with a display label, sorted by group."""
    n = F.col("n")
    title = label if label is not None else F.col(group).cast("string")
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", F.concat(title, F.lit(" ("), n.cast("string"), F.lit(")")))
        .orderBy(group)
    )


def ordered(df: DataFrame, *key) -> DataFrame:
    """Total order on a full key; a range shuffle, so for results meant to be read."""
    return df.orderBy(*key)


def filter_edges(edges: DataFrame, kind: str = "all", node=None, nearby: bool = False) -> DataFrame:
    """Edges of one kind (or all), only those touching ``node`` when ``nearby``,
    each marked with whether it touches the node."""
    touching = (
        F.lit(False) if node is None else (F.col("source") == node) | (F.col("target") == node)
    )
    out = edges.withColumn("touching", touching)
    if kind != "all":
        out = out.filter(F.col("kind") == kind)
    return out.filter("touching") if nearby else out


def with_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the group of both ends from ``nodes(node, group)``."""
    ends = edges
    for end, other in (("source", "target"), ("target", "source")):
        side = nodes.select(F.col("node").alias(end), F.col("group").alias(f"{end}_group"))
        ends = lookup_join(ends, side, [end], "left", [other])
    return ends


def edges_by_scope(edges: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    """Edges 'inside' one group or 'crossing' groups."""
    same = F.col("source_group") == F.col("target_group")
    return with_groups(edges, nodes).filter(same if scope == "inside" else ~same)
