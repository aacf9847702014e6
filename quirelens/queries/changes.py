"""Snapshots, manifests, sets, review reasons and refresh plans."""

from pyspark.sql import functions as F

from quirelens.functions.hashing import sha256_hex
from quirelens.operators import diff, review
from quirelens.plans.lineage import scratch_path
from quirelens.plans.skew import lookup_join
from quirelens.queries.registry import query
from quirelens.session import table
from quirelens.sources.files import file_census as census
from quirelens.sources.parts import PartStore
from quirelens.sources.sinks import BaselineStore
from quirelens.sources.sinks import write_plan as plan_write


def order_snapshots(spark, sf):
    """Two states of the orders: an earlier one that ends in 1999 and in which that
    year's orders are all open, and a later one that begins in 1996."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    early = orders.filter("o_orderdate < timestamp_ntz '2000-01-01'").withColumn(
        "o_orderstatus", F.expr("if(o_orderdate >= timestamp_ntz '1999-01-01', 'O', o_orderstatus)")
    )
    return early, orders.filter("o_orderdate >= timestamp_ntz '1996-01-01'")


def order_hash():
    return F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256)


SNAPSHOT_SQL = """
early AS (SELECT o_orderkey, o_custkey, o_orderpriority,
    CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'O' ELSE o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
late AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


@query(
    "snapshot_diff",
    f"""WITH {SNAPSHOT_SQL},
    a AS (SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM early),
    b AS (SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM late)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.h AS old_hash, b.h AS new_hash,
      CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
           WHEN a.h = b.h THEN 'equal' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def snapshot_diff(spark, sf):
    old, new = [s.select("o_orderkey", order_hash().alias("h")) for s in order_snapshots(spark, sf)]
    return diff.snapshot_diff(old, new, ["o_orderkey"], "h")


@query(
    "freshness_check",
    """WITH a AS (SELECT doc_id, text || CASE WHEN quality = 0 THEN '!' ELSE '' END AS text FROM documents JOIN labels USING (doc_id))
    SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' ELSE 'stale' END AS status,
      CAST(strlen(d.text) AS INTEGER) AS expected_bytes, CAST(strlen(a.text) AS INTEGER) AS actual_bytes
    FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id WHERE a.text IS DISTINCT FROM d.text""",
)
def freshness_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mark = F.when(F.col("quality") == 0, "!").otherwise("")
    actual = docs.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.concat("text", mark).alias("text"))
    return diff.freshness(docs, actual, ["doc_id"], "text")


WORD_SUMS = " || ':' || ".join(f"sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT))::VARCHAR" for i in range(5))


@query(
    "fingerprint",
    f"""WITH r AS (SELECT DISTINCT o_orderstatus,
      sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS h FROM orders)
    SELECT o_orderstatus, count(*) AS n_rows, sha256(count(*) || ':' || {WORD_SUMS}) AS fingerprint FROM r GROUP BY 1""",
)
def fingerprint(spark, sf):
    keys = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderpriority")]
    rows = table(spark, sf, "orders").select("o_orderstatus", F.sha2(F.concat_ws("|", *keys), 256).alias("h"))
    return diff.fingerprint(rows, ["o_orderstatus"], "h")


def manifest_rows(spark, sf):
    """A manifest of the documents with faults of every kind, and the actual files."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    digest = F.when(F.col("toxic") == 1, F.substring(sha256_hex("text"), 1, 40)).when(
        F.col("quality") == 0, sha256_hex(F.concat("text", F.lit("x")))
    ).otherwise(sha256_hex("text"))
    name = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(F.col("lang") == "es", F.concat(F.lit("../"), name)).otherwise(name)
    declared = docs.select("source", path.alias("path"), digest.alias("sha256"))
    actual = docs.filter("lang <> 'de'").select(path.alias("path"), sha256_hex("text").alias("sha256"))
    return declared, actual


MANIFEST_SQL = """
d AS (SELECT source, CASE WHEN lang = 'es' THEN '../' ELSE '' END || source || '/' || doc_id || '.txt' AS path, lang,
    sha256(text) AS actual, CASE WHEN toxic = 1 THEN substr(sha256(text), 1, 40) WHEN quality = 0 THEN sha256(text || 'x')
      ELSE sha256(text) END AS sha256
  FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT source, path, sha256, CASE WHEN lang <> 'de' THEN actual END AS actual_sha256,
    CASE WHEN lang = 'es' THEN 'unsafe path' WHEN len(sha256) <> 64 THEN 'malformed hash'
      WHEN lang = 'de' THEN 'missing file' WHEN sha256 = actual THEN 'ok' ELSE 'mismatch' END AS status
  FROM d)"""


@query("manifest_verify", f"WITH {MANIFEST_SQL} SELECT path, sha256, actual_sha256, status FROM v")
def manifest_verify(spark, sf):
    declared, actual = manifest_rows(spark, sf)
    return diff.verify_manifest(declared.select("path", "sha256"), actual)


@query(
    "cache_valid",
    f"WITH {MANIFEST_SQL} SELECT source AS part, count(*) FILTER (status <> 'ok') = 0 AS cache_valid FROM v GROUP BY 1",
)
def cache_valid(spark, sf):
    return review.cache_valid(_checks(spark, sf))


def _checks(spark, sf):
    declared, actual = manifest_rows(spark, sf)
    checks = diff.verify_manifest(declared.select("path", "sha256"), actual)
    return checks.select(F.regexp_extract("path", r"^(?:\.\./)?([^/]*)/", 1).alias("part"), "status")


@query(
    "manifest_identity",
    """WITH m AS (SELECT source, max(lang) AS commit, min(lang) AS tree, max(sha256(text)) AS ir_sha256 FROM documents GROUP BY 1),
    t AS (SELECT max(lang) AS commit, min(lang) AS tree, max(sha256(text)) AS ir_sha256 FROM documents),
    x AS (SELECT source, concat_ws(',', CASE WHEN m.commit <> t.commit THEN 'commit' END,
      CASE WHEN m.tree <> t.tree THEN 'tree' END, CASE WHEN m.ir_sha256 <> t.ir_sha256 THEN 'ir_sha256' END) AS differs
      FROM m, t) SELECT source, differs, differs = '' AS bound FROM x""",
)
def manifest_identity(spark, sf):
    fields = ["commit", "tree", "ir_sha256"]
    facts = [
        F.max("lang").alias("commit"), F.min("lang").alias("tree"), F.max(sha256_hex("text")).alias("ir_sha256"),
    ]
    docs = table(spark, sf, "documents")
    out = diff.same_identity(docs.groupBy("source").agg(*facts), docs.agg(*facts), fields)
    return out.select("source", F.array_join("differs", ",").alias("differs"), "bound")


@query(
    "multiset_reconcile",
    """WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    b AS (SELECT o_custkey AS user_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS bad FROM orders GROUP BY 1),
    c AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_planned, coalesce(b.n, 0) AS n_executed,
      coalesce(bad, 0) AS n_not_passed FROM a FULL JOIN b ON a.user_id = b.user_id)
    SELECT * FROM (SELECT *, CASE WHEN n_planned = 0 THEN 'unplanned' WHEN n_planned > 1 THEN 'planned twice'
      WHEN n_executed = 0 THEN 'not executed' WHEN n_executed <> n_planned THEN 'count differs'
      WHEN n_not_passed > 0 THEN 'not passed' END AS problem FROM c) WHERE problem IS NOT NULL""",
)
def multiset_reconcile(spark, sf):
    """Events of users as planned, orders of customers as executed."""
    planned = table(spark, sf, "events").select("user_id")
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "P").alias("not_passed"))
    return diff.reconcile(planned, done, "user_id")


DAY_SETS_SQL = """
a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
b AS (SELECT DISTINCT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day FROM orders)"""


def _day_sets(spark, sf):
    """Days on which a user has events, and days on which the customer of that number orders."""
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))
    return events, orders


@query(
    "set_diff",
    f"""WITH {DAY_SETS_SQL} SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def set_diff(spark, sf):
    return diff.set_diff(*_day_sets(spark, sf), ["user_id", "day"])


@query("not_subset", f"WITH {DAY_SETS_SQL} SELECT * FROM a EXCEPT SELECT * FROM b")
def not_subset(spark, sf):
    return diff.not_subset(*_day_sets(spark, sf), ["user_id", "day"])


@query("union_distinct", f"WITH {DAY_SETS_SQL} SELECT * FROM a UNION SELECT * FROM b")
def union_distinct(spark, sf):
    return diff.union_distinct(*_day_sets(spark, sf))


@query(
    "alias_lookup",
    """SELECT event_id, CASE WHEN event_type LIKE 's%' OR event_type LIKE 'v%' THEN upper(event_type) ELSE event_type END
    AS event_type FROM events""",
)
def alias_lookup(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    renamed = events.select(F.col("event_type").alias("old_key")).distinct().filter("old_key like 's%' or old_key like 'v%'")
    return diff.resolve_alias(events, renamed.withColumn("new_key", F.upper("old_key")), "event_type", ["event_id"])


@query(
    "size_guard",
    """SELECT count(*) AS n_paths, count(*) FILTER (regexp_matches(path, '^(src1|src2)/') OR path LIKE '%/77%') AS n_forbidden,
      count(*) <= 1000 AND count(*) FILTER (regexp_matches(path, '^(src1|src2)/') OR path LIKE '%/77%') = 0 AS ok
    FROM (SELECT source || '/' || n_chars AS path FROM documents UNION
          SELECT source || '/' || n_chars || '.txt' FROM documents JOIN labels USING (doc_id))""",
)
def size_guard(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.col("n_chars").cast("string"))
    added = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(F.concat(path, F.lit(".txt")).alias("path"))
    return diff.size_guard(docs.select(path.alias("path")), added, "path", 1000, ["^(src1|src2)/", "/77"])


@query(
    "file_census",
    """SELECT source || '/' || doc_id AS path, CASE WHEN lang = 'de' THEN 493 ELSE 420 END AS mode, sha256(text) AS sha256,
      CAST(strlen(text) AS BIGINT) AS byte_length, starts_with(text, 'SQLite format 3' || chr(0)) OR lang = 'de' AS refused FROM documents""",
)
def file_census(spark, sf):
    """The documents as files, German ones executable."""
    mode = F.when(F.col("lang") == "de", 0o755).otherwise(0o644)
    docs = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", mode.alias("mode")
    )
    return census(docs, "path", "text", mode="mode")


@query(
    "write_plan",
    f"""WITH {SNAPSHOT_SQL},
    a AS (SELECT o_orderpriority || (o_custkey // 100) AS part, list(o_orderkey || ':' || o_orderstatus ORDER BY 1) AS l FROM early GROUP BY 1),
    b AS (SELECT o_orderpriority || (o_custkey // 100) AS part, list(o_orderkey || ':' || o_orderstatus ORDER BY 1) AS l FROM late GROUP BY 1)
    SELECT coalesce(a.part, b.part) AS part, CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'removed'
      WHEN a.l = b.l THEN 'equal' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.part = b.part""",
)
def write_plan(spark, sf):
    part = F.concat("o_orderpriority", F.expr("o_custkey div 100").cast("string")).alias("part")
    old, new = [s.select("o_orderkey", "o_orderstatus", part) for s in order_snapshots(spark, sf)]
    return plan_write(new, old, "part").select("part", "status")


@query(
    "text_dependents",
    "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def text_dependents(spark, sf):
    return review.text_dependents(
        table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text"
    )


def _rule(lang, *words):
    def source():
        hit = F.lit(False)
        for w in words:
            hit |= F.col("text").contains(f" {w} ")
        return hit

    return review.Rule(lang, source, lambda: F.col("lang") == lang)


RULES = [_rule("de", "der", "die", "und"), _rule("fr", "le", "la", "les"), _rule("es", "el", "los", "que")]


def _impact(spark, sf):
    return review.rule_dependents(
        table(spark, sf, "benchmark"), table(spark, sf, "documents"), RULES, "item_id", "text", "doc_id", "text"
    )


IMPACT_SQL = """
s AS (SELECT item_id, text, CASE
    WHEN contains(text, ' der ') OR contains(text, ' die ') OR contains(text, ' und ') THEN 'de'
    WHEN contains(text, ' le ') OR contains(text, ' la ') OR contains(text, ' les ') THEN 'fr'
    WHEN contains(text, ' el ') OR contains(text, ' los ') OR contains(text, ' que ') THEN 'es' END AS rule FROM benchmark),
hits AS (SELECT s.item_id, d.doc_id FROM s JOIN documents d ON contains(d.text, s.text)),
reasons AS (
  SELECT item_id, doc_id FROM hits
  UNION SELECT item_id, doc_id FROM s JOIN documents d ON d.lang = s.rule
  UNION SELECT item_id, doc_id FROM s, documents d WHERE rule IS NULL AND item_id NOT IN (SELECT item_id FROM hits))"""


@query(
    "impact_review",
    f"""WITH {IMPACT_SQL} SELECT doc_id AS page, count(*) AS n_reasons, min(item_id) AS first_source FROM reasons GROUP BY 1""",
)
def impact_review(spark, sf):
    return _impact(spark, sf).counts()


@query(
    "impact_reasons",
    f"""WITH {IMPACT_SQL} SELECT CAST(NULL AS BIGINT) AS page, 'Changed source: ' || item_id AS reason FROM s
      WHERE rule IS NULL AND item_id NOT IN (SELECT item_id FROM hits)
    UNION ALL SELECT doc_id, 'Changed source: ' || item_id FROM reasons
      WHERE item_id NOT IN (SELECT item_id FROM s WHERE rule IS NULL AND item_id NOT IN (SELECT item_id FROM hits))""",
)
def impact_reasons(spark, sf):
    impact = _impact(spark, sf)
    return impact.reasons(impact.pages)


def _reasons(spark, sf, flag, text):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    rows = lookup_join(table(spark, sf, "labels"), docs, ["doc_id"], "inner")
    return rows.filter(flag).select(
        F.concat_ws("/", "source", "lang").alias("page"), F.concat(F.lit(text), F.col("doc_id").cast("string")).alias("reason")
    )


REASON_SQL = """
j AS (SELECT source || '/' || lang AS page, doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)),
old AS (SELECT page, 'toxic ' || doc_id AS reason, lang FROM j WHERE toxic = 1),
new AS (SELECT page, 'weak ' || doc_id AS reason FROM j WHERE quality = 0)"""


@query("merge_reasons", f"WITH {REASON_SQL} SELECT page, reason FROM old UNION SELECT page, reason FROM new")
def merge_reasons(spark, sf):
    return review.merge_reasons(_reasons(spark, sf, "toxic = 1", "toxic "), _reasons(spark, sf, "quality = 0", "weak "))


@query(
    "pending_review",
    f"""WITH {REASON_SQL} SELECT page, reason FROM old WHERE page NOT IN (SELECT page FROM old WHERE lang = 'en')
    UNION SELECT page, reason FROM new""",
)
def pending_review(spark, sf):
    pending = _reasons(spark, sf, "toxic = 1", "toxic ")
    done = pending.filter(F.col("page").endswith("/en")).select("page")
    return review.update_pending(pending, done, _reasons(spark, sf, "quality = 0", "weak "))


def _states(spark, sf):
    """What each source of documents was built from, now and as last saved."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    facts = [
        F.count(F.lit(1)).cast("string").alias("inputs"), F.min("lang").alias("renderer"),
        F.max(sha256_hex("text")).alias("generated"), F.min(sha256_hex("text")).alias("ir_sha256"),
    ]
    now = docs.groupBy(F.col("source").alias("part")).agg(*facts)
    saved = docs.filter("coalesce(toxic, 0) = 0 and source <> 'src7'").groupBy(F.col("source").alias("part")).agg(*facts)
    return now, saved


STATE_SQL = f"""{MANIFEST_SQL},
valid AS (SELECT source AS part, count(*) FILTER (status <> 'ok') = 0 AS cache_valid FROM v GROUP BY 1),
now AS (SELECT source AS part, count(*)::VARCHAR AS inputs, min(lang) AS renderer, max(sha256(text)) AS generated,
    min(sha256(text)) AS ir FROM documents GROUP BY 1),
saved AS (SELECT source AS part, count(*)::VARCHAR AS inputs, min(lang) AS renderer, max(sha256(text)) AS generated,
    min(sha256(text)) AS ir FROM documents LEFT JOIN labels USING (doc_id)
  WHERE coalesce(toxic, 0) = 0 AND source <> 'src7' GROUP BY 1),
b AS (SELECT n.part, s.part IS NULL AS first, s.part IS NULL OR n.renderer <> s.renderer OR n.generated <> s.generated AS gen,
    n.inputs IS DISTINCT FROM s.inputs AS moved, n.ir IS DISTINCT FROM s.ir AS ir_moved, coalesce(cache_valid, false) AS valid
  FROM now n LEFT JOIN saved s ON s.part = n.part LEFT JOIN valid ON valid.part = n.part),
plan AS (SELECT part, CASE WHEN first THEN 'unassessed' ELSE 'recorded' END AS baseline,
    NOT valid OR moved OR gen AS prepare_needed, gen OR ir_moved AS generate_needed,
    gen OR NOT valid OR moved AS generation_planned FROM b)"""


def _plan(spark, sf):
    now, saved = _states(spark, sf)
    valid = review.cache_valid(_checks(spark, sf))
    return review.plan_refresh(now.join(valid, "part", "left"), saved)


@query("refresh_plan", f"WITH {STATE_SQL} SELECT * FROM plan")
def refresh_plan(spark, sf):
    return _plan(spark, sf)


@query(
    "first_refresh_plan",
    """SELECT DISTINCT source AS part, 'unassessed' AS baseline, true AS prepare_needed, true AS generate_needed,
    true AS generation_planned FROM documents""",
)
def first_refresh_plan(spark, sf):
    now, _ = _states(spark, sf)
    return review.plan_refresh(now.withColumn("cache_valid", F.lit(False)), None)


@query(
    "review_status",
    f"""WITH {STATE_SQL} SELECT plan.*, CASE WHEN prepare_needed OR generate_needed THEN 'updated'
      WHEN part IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0) THEN 'review-needed'
      ELSE 'up-to-date' END AS status FROM plan""",
)
def review_status(spark, sf):
    weak = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    pending = table(spark, sf, "documents").join(weak, "doc_id", "left_semi").select(F.col("source").alias("part"))
    return review.review_status(_plan(spark, sf), pending)


@query("first_run_reasons", """SELECT doc_id AS page,
    'Initial or unavailable baseline: review applicability manually' AS reason FROM documents""")
def first_run_reasons(spark, sf):
    return review.first_run_reasons(table(spark, sf, "documents").select(F.col("doc_id").alias("page")))


@query(
    "changed_parts_written",
    """SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS part,
      CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-07-01')
        OR o_orderpriority = '1-URGENT' OR o_orderpriority LIKE '4%' THEN 'changed' ELSE 'equal' END AS status
    FROM orders GROUP BY o_orderpriority""",
)
def changed_parts_written(spark, sf):
    """Commit the orders by priority, the lowest as a part without a name, then again after
    a change of states, and of one priority's times by a microsecond; only parts that
    differ are written the second time."""
    store, new = _order_versions(spark, sf)
    return store.commit(new)


def _order_versions(spark, sf):
    """A store whose first version holds the orders by priority, and the rows of a second one."""
    store = PartStore(spark, scratch_path(spark))
    part = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("part")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", part, "o_orderdate")
    store.commit(orders, stage=False)
    late = F.expr("o_orderstatus = 'P' and o_orderdate >= timestamp_ntz '2001-07-01'") | F.coalesce(F.col("part") == "1-URGENT", F.lit(False))
    at = F.expr("if(part like '4%', o_orderdate + interval 1 microsecond, o_orderdate)")
    return store, orders.withColumn("o_orderstatus", F.when(late, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderdate", at)


@query(
    "rows_of_changed_parts",
    """SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS part, o_orderkey, 'changed' AS status
    FROM orders WHERE (o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-07-01')
      OR o_orderpriority = '1-URGENT' OR o_orderpriority LIKE '4%'""",
)
def rows_of_changed_parts(spark, sf):
    """The rows that differ between two committed versions; files of equal parts stay closed."""
    store, new = _order_versions(spark, sf)
    store.commit(new)
    return store.row_changes(["o_orderkey"], *store.versions())


@query(
    "baseline_versions",
    """SELECT source AS part, count(*) AS n_documents FROM documents GROUP BY 1""",
)
def baseline_versions(spark, sf):
    """Save two baselines one after the other and read back the last."""
    store = BaselineStore(spark, scratch_path(spark))
    docs = table(spark, sf, "documents")
    for rows in (docs.filter("lang = 'en'"), docs):
        store.advance(rows.groupBy(F.col("source").alias("part")).agg(F.count(F.lit(1)).alias("n_documents")))
    return store.read()
