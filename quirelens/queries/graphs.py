"""Neighbours, reachability, components, ancestry, trees and paths."""

from pyspark.sql import functions as F

from quirelens.operators import catalog, graph
from quirelens.queries.audits import TRADE_SQL, trade_edges, trade_nodes
from quirelens.queries.registry import query
from quirelens.session import table


@query(
    "neighborhood",
    """WITH e AS (SELECT DISTINCT c.n_name AS source, s.n_name AS target, CASE WHEN c.n_regionkey = s.n_regionkey THEN false
        ELSE true END AS logical FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = l_suppkey JOIN nation c ON c.n_nationkey = c_nationkey
        JOIN nation s ON s.n_nationkey = s_nationkey),
    x AS (SELECT max(n_name) AS me FROM nation)
    SELECT 'upstream' AS side, target AS name, 'c_nationkey -> s_nationkey' AS label, logical FROM e, x WHERE source = me
    UNION ALL SELECT 'downstream', source, 'c_nationkey -> s_nationkey', logical FROM e, x WHERE target = me""",
)
def neighborhood(spark, sf):
    nations = table(spark, sf, "nation")
    me = nations.agg(F.max("n_name").alias("me")).scalar()
    return graph.neighborhood(_nation_edges(spark, sf), me)


def _nation_edges(spark, sf):
    """Nations that trade, as references between their keys."""
    pairs = trade_edges(spark, sf).select("source", "target").distinct()
    nodes = trade_nodes(spark, sf)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("group"), "n_name", "n_regionkey")
    named = nodes.join(nations, "group").select("node", "n_name", "n_regionkey")
    c, s = named.alias("c"), named.alias("s")
    kind = F.when(F.col("c.n_regionkey") == F.col("s.n_regionkey"), "physical").otherwise("logical")
    joined = pairs.join(c, F.col("source") == F.col("c.node")).join(s, F.col("target") == F.col("s.node"))
    return joined.select(
        F.col("c.n_name").alias("source"), F.col("s.n_name").alias("target"), kind.alias("kind"),
    ).distinct().select(
        "*", F.array(F.lit("c_nationkey")).alias("from_columns"), F.array(F.lit("s_nationkey")).alias("to_columns")
    )


@query(
    "degrees",
    f"""WITH {TRADE_SQL} SELECT node, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM actors
    LEFT JOIN (SELECT source AS node, count(*) AS n FROM trade GROUP BY 1) o USING (node)
    LEFT JOIN (SELECT target AS node, count(*) AS n FROM trade GROUP BY 1) i USING (node)""",
)
def degrees(spark, sf):
    return graph.degrees(trade_nodes(spark, sf), trade_edges(spark, sf))


@query(
    "group_edges",
    f"""WITH {TRADE_SQL} SELECT a.grp AS source_group, b.grp AS target_group, count(*) AS n_edges
    FROM trade JOIN actors a ON a.node = source JOIN actors b ON b.node = target WHERE a.grp <> b.grp GROUP BY 1, 2""",
)
def group_edges(spark, sf):
    return graph.group_edges(trade_edges(spark, sf), trade_nodes(spark, sf))


@query(
    "isolated",
    f"""WITH {TRADE_SQL}, n AS (SELECT node FROM actors UNION SELECT 's' || p_partkey FROM part)
    SELECT node FROM n WHERE node NOT IN (SELECT source FROM trade) AND node NOT IN (SELECT target FROM trade)""",
)
def isolated(spark, sf):
    """Of customers, suppliers and suppliers numbered like parts those no order line names."""
    more = table(spark, sf, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("node"))
    nodes = trade_nodes(spark, sf).select("node").unionByName(more).distinct()
    return graph.isolated(nodes, trade_edges(spark, sf))


FIVE_SQL = """
steps AS (SELECT user_id, event_id, event_type FROM events),
types AS (SELECT event_type, lead(event_type) OVER (ORDER BY event_type) AS nxt FROM (SELECT DISTINCT event_type FROM events)),
pairs AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM steps)"""


def _type_chain(spark, sf):
    """Each event type joined to the next by name."""
    types = table(spark, sf, "events").select("event_type").distinct()
    pairs = graph.consecutive_pairs(types.withColumn("chain", F.lit(0)).withColumn("pos", F.col("event_type")), "chain", "pos", "event_type")
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))


@query("consecutive_pairs", f"WITH {FIVE_SQL} SELECT * FROM pairs WHERE b IS NOT NULL")
def consecutive_pairs(spark, sf):
    return graph.consecutive_pairs(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query(
    "path_follows_edges",
    f"""WITH {FIVE_SQL} SELECT user_id, event_id, a, b FROM pairs p WHERE b IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM types t WHERE (t.event_type = p.a AND t.nxt = p.b) OR (t.event_type = p.b AND t.nxt = p.a))""",
)
def path_follows_edges(spark, sf):
    return graph.path_violations(table(spark, sf, "events"), _type_chain(spark, sf), "user_id", "event_id", "event_type")


MARK_SQL = f"""{TRADE_SQL},
stops AS (SELECT row_number() OVER (ORDER BY o_orderkey, x) AS pos, node FROM (
    SELECT l_orderkey AS o_orderkey, 'c' || min(o_custkey) AS node, 0 AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
    UNION ALL SELECT l_orderkey, 's' || min(l_suppkey), 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)),
hops AS (SELECT node AS a, lead(node) OVER (ORDER BY pos) AS b FROM stops)"""


def _tour(spark, sf):
    """One path through all orders: customer, then a supplier of theirs."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    per = lines.join(orders, "o_orderkey").groupBy("o_orderkey").agg(
        F.min("o_custkey").alias("c"), F.min("l_suppkey").alias("s")
    )
    stop = F.array(
        F.struct((F.col("o_orderkey") * 2).alias("pos"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("node")),
        F.struct((F.col("o_orderkey") * 2 + 1).alias("pos"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("node")),
    )
    return per.select(F.explode(stop).alias("x")).select("x.pos", "x.node")


@query(
    "mark_path",
    f"""WITH {MARK_SQL}, e AS (SELECT DISTINCT source, target FROM trade)
    SELECT source, target, EXISTS (SELECT 1 FROM hops h WHERE (h.a = source AND h.b = target) OR (h.a = target AND h.b = source))
      AS on_path FROM e""",
)
def mark_path(spark, sf):
    edges = trade_edges(spark, sf).select("source", "target").distinct()
    return graph.mark_path(trade_nodes(spark, sf), edges, _tour(spark, sf))[1]


@query(
    "mark_path_nodes",
    f"""WITH {MARK_SQL} SELECT node, grp AS "group", node IN (SELECT node FROM stops) AS on_path FROM actors""",
)
def mark_path_nodes(spark, sf):
    edges = trade_edges(spark, sf).select("source", "target").distinct()
    return graph.mark_path(trade_nodes(spark, sf), edges, _tour(spark, sf))[0]


LINE_SQL = """
lines AS (SELECT DISTINCT doc_id, lang, line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE line <> ''),
heads AS (SELECT lang, line, min(doc_id) AS head FROM lines GROUP BY 1, 2),
rel AS (SELECT DISTINCT l.lang AS entity_kind, head AS "left", doc_id AS "right" FROM lines l JOIN heads h
  ON h.lang = l.lang AND h.line = l.line WHERE doc_id <> head)"""


def shared_lines(spark, sf):
    """Documents of a language that share a line, each tied to the first that holds it
    rather than to all others. An empty line says nothing."""
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    keyed = lines.select("doc_id", "lang", F.sha2("line", 256).alias("line")).distinct()
    # A document holds a line once, so spreading by document splits the hot lines.
    heads = keyed.groupBy("lang", "line").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    from quirelens.plans.skew import lookup_join

    tied = lookup_join(keyed, heads, ["lang", "line"], "inner", ["doc_id"]).filter("doc_id <> head")
    return tied.select(
        F.col("lang").alias("entity_kind"), F.col("head").alias("left"), F.col("doc_id").alias("right")
    ).distinct()


CLOSURE_SQL = """
e AS (SELECT "left" AS a, "right" AS b FROM r UNION SELECT "right", "left" FROM r),
reach AS (SELECT a AS member, a AS other FROM e UNION SELECT member, b FROM reach JOIN e ON a = other)"""


@query(
    "equivalence_closure",
    f"""WITH RECURSIVE {LINE_SQL}, r AS (SELECT * FROM rel), {CLOSURE_SQL},
    least AS (SELECT member, min(other) AS representative FROM reach GROUP BY 1)
    SELECT lang AS entity_kind, doc_id AS member, coalesce(representative, doc_id) AS representative
    FROM documents LEFT JOIN least ON member = doc_id""",
)
def equivalence_closure(spark, sf):
    """The closure of each language's relations, with all of its documents."""
    members = table(spark, sf, "documents").select(F.col("lang").alias("entity_kind"), F.col("doc_id").alias("node"))
    return catalog.equivalence_closures(shared_lines(spark, sf), members)


@query(
    "components",
    f"""WITH RECURSIVE {LINE_SQL}, r AS (SELECT * FROM rel), {CLOSURE_SQL}
    SELECT member, min(other) AS representative FROM reach GROUP BY 1""",
)
def components(spark, sf):
    rel = shared_lines(spark, sf)
    return graph.components(rel.select(F.col("left").alias("source"), F.col("right").alias("target")))


@query(
    "reachability",
    f"""WITH RECURSIVE {TRADE_SQL}, t AS (SELECT DISTINCT source AS a, target AS b FROM trade),
    e AS (SELECT a, b FROM t UNION SELECT b, a FROM t),
    seed AS (SELECT min(node) AS node FROM actors),
    w AS (SELECT node, 0 AS hops FROM seed UNION SELECT b, hops + 1 FROM w JOIN e ON a = node WHERE hops < 12)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1""",
)
def reachability(spark, sf):
    seed = trade_nodes(spark, sf).agg(F.min("node").alias("node"))
    return graph.reachable(trade_edges(spark, sf), seed)


def turn_id(column="turn"):
    return F.concat_ws("/", F.col("conv_id").cast("string"), F.col(column).cast("string"))


def turns(spark, sf):
    """Each turn with the one it answers."""
    rows = table(spark, sf, "conversations").withColumn("before", F.col("turn") - 1)
    return rows.select(
        "conv_id", "turn", "role", turn_id().alias("child"), F.when(F.col("before") >= 0, turn_id("before")).alias("parent")
    )


@query(
    "ancestry",
    """WITH h AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
    SELECT conv_id || '/' || last AS head, conv_id || '/' || turn AS ancestor, CAST(last - turn AS INTEGER) AS depth
    FROM conversations JOIN h USING (conv_id)""",
)
def ancestry(spark, sf):
    rows = turns(spark, sf)
    heads = rows.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(turn_id().alias("node"))
    return graph.ancestry(rows.select("child", "parent"), heads)


@query(
    "tree_flatten",
    """SELECT 'world' AS root, r_name || '/' || n_name || '/' || c_name AS path, 'c' || c_custkey AS leaf
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'world', r_name || '/' || n_name, 'n' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
      WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""",
)
def tree_flatten(spark, sf):
    return graph.flatten_tree(_entries(spark, sf), spark.range(1).select(F.lit("world").alias("root")))


def _entries(spark, sf):
    def entry(frame, tree, name, child):
        return frame.select(tree.alias("tree"), F.col(name).alias("name"), child.alias("child"))

    def key(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    return (
        entry(table(spark, sf, "region"), F.lit("world"), "r_name", key("r", "r_regionkey"))
        .unionByName(entry(table(spark, sf, "nation"), key("r", "n_regionkey"), "n_name", key("n", "n_nationkey")))
        .unionByName(entry(table(spark, sf, "customer"), key("n", "c_nationkey"), "c_name", key("c", "c_custkey")))
    )


@query(
    "tree_gaps",
    """SELECT 'n' || n_nationkey AS root, CAST(n_regionkey + 60 AS BIGINT) AS entry_count, true AS complete, count(c_custkey) AS n_found
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey HAVING count(c_custkey) <> n_regionkey + 60""",
)
def tree_gaps(spark, sf):
    nations = table(spark, sf, "nation")
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    flat = graph.flatten_tree(_entries(spark, sf), nations.select(key.alias("root")))
    declared = nations.select(
        key.alias("root"), (F.col("n_regionkey") + 60).cast("bigint").alias("entry_count"), F.lit(True).alias("complete")
    )
    return graph.manifest_gaps(flat, declared)


@query(
    "tag_peel",
    """WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
    SELECT role || ' ' || conv_id || '/' || turn AS ref, conv_id || '/' || turn AS target_oid,
      CASE WHEN turn > 0 THEN conv_id || '/0' ELSE conv_id || '/' || turn END AS peeled_oid, turn AS n_tags
    FROM conversations""",
)
def tag_peel(spark, sf):
    rows = turns(spark, sf)
    kind = F.when(F.col("turn") > 1, "tag").otherwise("commit")
    tags = rows.filter("parent is not null").select(
        F.col("child").alias("oid"), F.col("parent").alias("target_oid"), kind.alias("target_type")
    )
    refs = rows.select(F.concat_ws(" ", "role", "child").alias("ref"), F.col("child").alias("target_oid"))
    return graph.peel(refs, tags)


@query(
    "thread_totals",
    """SELECT conv_id || '/0' AS root, count(*) AS n_comments, max(turn) AS max_depth FROM conversations GROUP BY conv_id""",
)
def thread_totals(spark, sf):
    return catalog.thread_totals(catalog.threads(turns(spark, sf), "child", "parent"))


@query(
    "parent_join",
    """SELECT a.conv_id, a.turn, a.role, b.role AS parent_role FROM conversations a LEFT JOIN conversations b
      ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role = 'user'""",
)
def parent_join(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("role").alias("kind"), F.col("conv_id").alias("parent_conv"),
        (F.col("turn") - 1).alias("parent_turn"),
    )
    out = catalog.with_parent(rows, ["conv_id", "turn"], ["parent_conv", "parent_turn"], ["role"], kind="user")
    return out.select("conv_id", "turn", "role", "parent_role")


@query(
    "short_paths",
    "SELECT o_custkey, count(*) AS n_steps FROM orders GROUP BY 1 HAVING count(*) < 2",
)
def short_paths(spark, sf):
    return graph.short_paths(table(spark, sf, "orders"), "o_custkey")
