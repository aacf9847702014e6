"""Declared keys, domains and citations checked on the star schema and the texts."""

from pyspark.sql import functions as F

from quirelens.functions.urls import host, url_path
from quirelens.operators import audit, catalog, search
from quirelens.queries.registry import query
from quirelens.session import table


def references(spark, sf):
    """Name, child, parent and key pairs of each natural reference."""
    t = {n: table(spark, sf, n) for n in (
        "lineitem", "orders", "part", "supplier", "customer", "nation", "region", "labels", "documents", "conversations")}
    replies = t["conversations"].select(
        F.when(F.col("turn") > 0, F.col("conv_id")).alias("conv_id"), (F.col("turn") - 1).alias("turn")
    )
    return [
        ("lineitem_orders", t["lineitem"], t["orders"], [("l_orderkey", "o_orderkey")]),
        ("lineitem_part", t["lineitem"], t["part"], [("l_partkey", "p_partkey")]),
        ("lineitem_supplier", t["lineitem"], t["supplier"], [("l_suppkey", "s_suppkey")]),
        ("orders_customer", t["orders"], t["customer"], [("o_custkey", "c_custkey")]),
        ("customer_nation", t["customer"], t["nation"], [("c_nationkey", "n_nationkey")]),
        ("supplier_nation", t["supplier"], t["nation"], [("s_nationkey", "n_nationkey")]),
        ("nation_region", t["nation"], t["region"], [("n_regionkey", "r_regionkey")]),
        ("labels_documents", t["labels"], t["documents"], [("doc_id", "doc_id")]),
        ("documents_labels", t["documents"], t["labels"], [("doc_id", "doc_id")]),
        ("turn_previous", replies, t["conversations"], [("conv_id", "conv_id"), ("turn", "turn")]),
    ]


REFERENCE_SQL = [
    ("lineitem_orders", "lineitem", "orders", "l_orderkey", "o_orderkey"),
    ("lineitem_part", "lineitem", "part", "l_partkey", "p_partkey"),
    ("lineitem_supplier", "lineitem", "supplier", "l_suppkey", "s_suppkey"),
    ("orders_customer", "orders", "customer", "o_custkey", "c_custkey"),
    ("customer_nation", "customer", "nation", "c_nationkey", "n_nationkey"),
    ("supplier_nation", "supplier", "nation", "s_nationkey", "n_nationkey"),
    ("nation_region", "nation", "region", "n_regionkey", "r_regionkey"),
    ("labels_documents", "labels", "documents", "doc_id", "doc_id"),
    ("documents_labels", "documents", "labels", "doc_id", "doc_id"),
]


def _summary_sql(name, child, parent, c, p):
    return f"""SELECT '{name}' AS reference, count(*) AS child_rows, count(*) FILTER (c.{c} IS NULL) AS exempt_rows,
      count(*) FILTER (c.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{p} = c.{c})) AS orphan_rows
      FROM {child} c"""


@query(
    "fk_summary",
    "\nUNION ALL ".join(
        [_summary_sql(*r) for r in REFERENCE_SQL]
        + ["""SELECT 'turn_previous', count(*), count(*) FILTER (turn = 0), count(*) FILTER (turn > 0 AND NOT EXISTS
           (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)) FROM conversations c"""]
    ),
)
def fk_summary(spark, sf):
    return audit.fk_summary(references(spark, sf))


@query(
    "fk_orphans",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def fk_orphans(spark, sf):
    child = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    finished = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return audit.fk_orphans(child, finished, [("l_orderkey", "o_orderkey")], ["l_linenumber", "l_partkey", "l_suppkey"])


@query(
    "key_dups",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def key_dups(spark, sf):
    return audit.key_dups(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "key_dups_where",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'
    GROUP BY ALL HAVING count(*) > 1""",
)
def key_dups_where(spark, sf):
    rows = table(spark, sf, "lineitem")
    return audit.key_dups_where(rows, ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R")


NULL_CHECKED = ("doc_id", "quality", "toxic", "text")


@query(
    "null_audit",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows "
        "FROM documents LEFT JOIN labels USING (doc_id)"
        for c in NULL_CHECKED
    ),
)
def null_audit(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return audit.null_violations(rows, NULL_CHECKED)


def _profile_sql(name, child, parent, c, p):
    return f"""SELECT '{name}' AS reference, (SELECT count(*) FROM {child}) AS child_rows,
      (SELECT count(*) FROM {child} WHERE {c} IS NULL) AS null_rows, count(k) AS used_parents,
      CASE WHEN (SELECT count(*) FROM {child} WHERE {c} IS NULL) = 0 THEN 'exactly one' ELSE 'zero or one' END AS parent_side,
      CASE WHEN coalesce(max(n), 0) <= 1 THEN 'zero or one' ELSE 'many' END AS child_side,
      (SELECT count(*) FROM {parent} p WHERE NOT EXISTS (SELECT 1 FROM {child} c WHERE c.{c} = p.{p})) AS childless_parents
      FROM (SELECT {c} AS k, count(*) AS n FROM {child} WHERE {c} IS NOT NULL GROUP BY 1)"""


TURN_PROFILE_SQL = """SELECT 'turn_previous' AS reference, (SELECT count(*) FROM conversations) AS child_rows,
      (SELECT count(*) FROM conversations WHERE turn = 0) AS null_rows, count(*) AS used_parents,
      CASE WHEN (SELECT count(*) FROM conversations WHERE turn = 0) = 0 THEN 'exactly one' ELSE 'zero or one' END AS parent_side,
      CASE WHEN coalesce(max(n), 0) <= 1 THEN 'zero or one' ELSE 'many' END AS child_side,
      (SELECT count(*) FROM conversations p WHERE NOT EXISTS (SELECT 1 FROM conversations c
        WHERE c.turn > 0 AND c.conv_id = p.conv_id AND c.turn - 1 = p.turn)) AS childless_parents
      FROM (SELECT count(*) AS n FROM conversations WHERE turn > 0 GROUP BY conv_id, turn)"""


@query("relationship_profile", "\nUNION ALL ".join([*[_profile_sql(*r) for r in REFERENCE_SQL], TURN_PROFILE_SQL]))
def relationship_profile(spark, sf):
    return audit.relationship_profile(references(spark, sf))


def trade_edges(spark, sf):
    """Customer to supplier of every order line; physical unless it was returned."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    kind = F.when(F.col("l_returnflag") == "R", "logical").otherwise("physical")
    return lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
        kind.alias("kind"),
    )


def trade_nodes(spark, sf):
    """Customers and suppliers with their nation as group."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_nationkey").alias("group")
    ).unionByName(
        s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_nationkey").alias("group"))
    )


TRADE_SQL = """
trade AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target,
    CASE WHEN l_returnflag = 'R' THEN 'logical' ELSE 'physical' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
actors AS (SELECT 'c' || c_custkey AS node, c_nationkey AS grp FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier)"""


@query(
    "bad_endpoints",
    f"""WITH {TRADE_SQL}, known AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0), e AS (SELECT DISTINCT * FROM trade)
    SELECT source, target, kind, 'source' AS missing_end FROM e WHERE source NOT IN (SELECT node FROM known)
    UNION ALL SELECT source, target, kind, 'target' FROM e WHERE target NOT IN (SELECT node FROM known)""",
)
def bad_endpoints(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    s = table(spark, sf, "supplier").filter("s_acctbal > 0")
    known = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")).unionByName(
        s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    )
    return audit.bad_endpoints(trade_edges(spark, sf).distinct(), known)


@query(
    "boundary_edges",
    f"""WITH {TRADE_SQL}, e AS (SELECT DISTINCT * FROM trade)
    SELECT source, target, kind, a.grp AS source_group, b.grp AS target_group
    FROM e JOIN actors a ON a.node = source JOIN actors b ON b.node = target
    WHERE (kind = 'physical' AND a.grp <> b.grp) OR (kind = 'logical' AND a.grp = b.grp)""",
)
def boundary_edges(spark, sf):
    return audit.boundary_violations(trade_edges(spark, sf).distinct(), trade_nodes(spark, sf))


@query(
    "unclassified",
    """WITH g AS (SELECT doc_id, 'quality ' || quality AS grp FROM labels
      UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)
    SELECT doc_id, n_groups FROM (SELECT d.doc_id, count(g.grp) AS n_groups FROM documents d LEFT JOIN g USING (doc_id)
      GROUP BY d.doc_id) WHERE n_groups <> 1""",
)
def unclassified(spark, sf):
    labels = table(spark, sf, "labels")
    groups = labels.select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("group")).unionByName(
        labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("group"))
    )
    return audit.unclassified(table(spark, sf, "documents"), groups, "doc_id")


@query(
    "id_mismatch",
    r"""SELECT * FROM (SELECT page_id, url, 'https://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))
      || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS expected_id FROM pages) WHERE url <> expected_id""",
)
def id_mismatch(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return audit.id_mismatch(pages, "url", F.concat(F.lit("https://"), host("url"), url_path("url")))


@query(
    "domain_check",
    "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') OR event_type IS NULL",
)
def domain_check(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return audit.domain_violations(rows, "event_type", ["click", "view", "purchase"])


@query("uncited", "SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '[0-9]')")
def uncited(spark, sf):
    docs = table(spark, sf, "documents")
    cites = docs.select("doc_id", "lang", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("citations"))
    return audit.uncited(cites, "citations").drop("citations")


@query(
    "citation_bounds",
    r"""WITH f AS (SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(t) - len(replace(t, chr(10), ''))
        + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS INTEGER) AS n_lines
      FROM (SELECT doc_id, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS t FROM documents)),
    c AS (SELECT doc_id, turn AS line, turn FROM (SELECT conv_id * 9 AS doc_id, turn FROM conversations))
    SELECT doc_id, line, n_lines, CASE WHEN line < 1 THEN 'invalid line' WHEN n_lines IS NULL THEN 'missing file'
      ELSE 'line outside file' END AS reason
    FROM c LEFT JOIN f USING (doc_id) WHERE line < 1 OR n_lines IS NULL OR line > n_lines""",
)
def citation_bounds(spark, sf):
    cites = table(spark, sf, "conversations").select((F.col("conv_id") * 9).alias("doc_id"), F.col("turn").alias("line"))
    return audit.bad_citations(cites, table(spark, sf, "documents"), "doc_id", "line", "text", ["line"])


@query(
    "ordinal_gaps",
    """SELECT * FROM (SELECT l_orderkey, min(l_linenumber) AS first_ordinal, max(l_linenumber) AS last_ordinal,
      count(DISTINCT l_linenumber) AS n_ordinals, count(*) - count(DISTINCT l_linenumber) AS n_repeats,
      CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS BIGINT) AS n_missing
      FROM lineitem GROUP BY 1) WHERE n_missing > 0 OR n_repeats > 0""",
)
def ordinal_gaps(spark, sf):
    return catalog.ordinal_gaps(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "gap_starts",
    """SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem a
    WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
      AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber)""",
)
def gap_starts(spark, sf):
    return catalog.gap_starts(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "edges_by_scope",
    f"""WITH {TRADE_SQL}, e AS (SELECT DISTINCT * FROM trade)
    SELECT source, target, kind, a.grp AS source_group, b.grp AS target_group
    FROM e JOIN actors a ON a.node = source JOIN actors b ON b.node = target WHERE a.grp = b.grp""",
)
def edges_by_scope(spark, sf):
    return search.edges_by_scope(trade_edges(spark, sf).distinct(), trade_nodes(spark, sf), "inside")
