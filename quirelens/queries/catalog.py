"""Catalog reads on analogues of their tables."""

from pyspark.sql import functions as F

from quirelens.functions.hashing import sha256_hex
from quirelens.functions.times import to_micros
from quirelens.operators import catalog
from quirelens.plans.windows import latest
from quirelens.queries.registry import query
from quirelens.session import table


def _us(column):
    return to_micros(F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


@query(
    "active_relations",
    """SELECT doc_id AS relation_uuidv4, first AS "left" FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first
    FROM documents) WHERE doc_id <> first AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def active_relations(spark, sf):
    from quirelens.plans.lineage import cut
    from quirelens.plans.skew import lookup_join

    refs = cut(catalog.cas_references(table(spark, sf, "documents"), "doc_id", "text"))
    store = catalog.store_of(refs, "doc_id").filter("n_refs > 1").select("sha256", F.col("first_owner").alias("left"))
    copies = lookup_join(refs, store, ["sha256"], "inner", ["doc_id"]).filter("doc_id <> left")
    relations = copies.select(F.col("doc_id").alias("relation_uuidv4"), "left")
    cancelled = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("relation_uuidv4"))
    return catalog.active_relations(relations, cancelled)


@query(
    "latest_state",
    """SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_state(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    "current_coverage",
    """WITH c AS (SELECT o_orderkey AS coverage_claim_id, o_custkey AS coverage_scope_id, o_orderstatus AS coverage_state,
        epoch_us(o_orderdate) AS observed_at_us FROM orders WHERE o_orderpriority <> '5-LOW'
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT c.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = coverage_claim_id) AS n_markers FROM c""",
)
def current_coverage(spark, sf):
    orders = table(spark, sf, "orders")
    claims = orders.select(
        F.col("o_orderkey").alias("coverage_claim_id"), F.col("o_custkey").alias("coverage_scope_id"),
        F.col("o_orderstatus").alias("coverage_state"), _us("o_orderdate").alias("observed_at_us"),
    )
    markers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("coverage_claim_id"))
    blocked = orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("coverage_claim_id"))
    return catalog.current_coverage(claims, markers, blocked)


def _resource_state(spark, sf):
    """Documents as state rows: scope is source and language, short texts have no body."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scope = F.concat_ws("/", "source", "lang").alias("scope")
    body = F.when(F.col("n_chars") >= 100, sha256_hex("text")).alias("body")
    state = docs.select("doc_id", scope, body)
    toxic = labels.filter("toxic = 1").select("doc_id")
    blocked = docs.join(toxic, "doc_id", "left_semi").select(scope)
    bodies = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(sha256_hex("text").alias("body"))
    return state, blocked, bodies


STATE_SQL = """
s AS (SELECT doc_id, source || '/' || lang AS scope, CASE WHEN n_chars >= 100 THEN sha256(text) END AS body FROM documents),
r AS (SELECT *, CASE WHEN scope IN (SELECT source || '/' || lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    THEN 'scope blocked' WHEN body IS NOT NULL AND body NOT IN
      (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) THEN 'body missing' END AS reason FROM s)"""


@query("eligible_rows", f"WITH {STATE_SQL} SELECT doc_id, scope, body FROM r WHERE reason IS NULL")
def eligible_rows(spark, sf):
    return catalog.eligible(*_resource_state(spark, sf), "scope", "body", ["doc_id"])


@query("diagnostics", f"WITH {STATE_SQL} SELECT * FROM r WHERE reason IS NOT NULL")
def diagnostics(spark, sf):
    return catalog.diagnostics(*_resource_state(spark, sf), "scope", "body", ["doc_id"])


@query(
    "observed_names",
    """SELECT c_nationkey AS nation, c_mktsegment AS name FROM customer UNION SELECT s_nationkey, s_name FROM supplier""",
)
def observed_names(spark, sf):
    current = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("name"))
    history = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return catalog.observed_names(current, history, "nation", "name")


def _git_tables(spark, sf):
    """Documents as objects, their texts as payloads; toxic texts are quarantined."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    verified = F.coalesce(F.col("quality"), F.lit(1)).alias("verified")
    objects = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("git_object_id"), "lang", verified)
    held = docs.select(
        F.col("doc_id").alias("git_object_id"), F.lit("raw").alias("payload_representation"), sha256_hex("text").alias("payload_sha256")
    )
    payloads = docs.filter("lang <> 'es'").select(F.lit("raw").alias("representation"), sha256_hex("text").alias("sha256")).distinct()
    toxic = labels.filter("toxic = 1").select("doc_id")
    quarantine = docs.join(toxic, "doc_id", "left_semi").select(sha256_hex("text").alias("sha256")).distinct()
    return objects, held, payloads, quarantine


AVAILABLE_SQL = """
q AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
o AS (SELECT doc_id AS git_object_id, lang, coalesce(quality, 1) AS verified, sha256(text) AS h FROM documents LEFT JOIN labels USING (doc_id)),
avail AS (SELECT * FROM o WHERE h NOT IN (SELECT h FROM q) AND h IN (SELECT h FROM o WHERE lang <> 'es'))"""


@query("available_objects", f"WITH {AVAILABLE_SQL} SELECT git_object_id, lang, verified FROM avail")
def available_objects(spark, sf):
    return catalog.available_objects(*_git_tables(spark, sf))


@query(
    "available_acquisitions",
    f"""WITH {AVAILABLE_SQL}, g AS (SELECT doc_id, source || '/' || lang || '/' || doc_id % 7 AS id FROM documents)
    SELECT DISTINCT id AS git_acquisition_id FROM g WHERE id NOT IN
    (SELECT id FROM g JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT git_object_id FROM avail))""",
)
def available_acquisitions(spark, sf):
    name = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 7).cast("string")).alias("git_acquisition_id")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    objects = catalog.available_objects(*_git_tables(spark, sf)).select(
        F.lit("id").alias("object_format"), F.col("git_object_id").alias("oid")
    )
    roots = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(
        name, F.lit("id").alias("object_format"), F.col("doc_id").alias("oid")
    )
    return catalog.available_acquisitions(docs.select(name).distinct(), roots, objects)


def _snapshots(spark, sf):
    """Orders as snapshots of their customers; each follows the order its key points to."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("repository_uuidv4"),
        (F.col("o_orderkey") - F.col("o_custkey")).alias("predecessor_snapshot_id"),
        (F.col("o_orderstatus") != "P").cast("int").alias("complete"), _us("o_orderdate").alias("generation"),
    )


SNAP_SQL = """
s AS (SELECT o_orderkey AS snapshot_id, o_custkey AS repository_uuidv4, o_orderkey - o_custkey AS predecessor_snapshot_id,
  CAST(o_orderstatus <> 'P' AS INTEGER) AS complete, epoch_us(o_orderdate) AS generation FROM orders)"""


@query("available_snapshots", f"WITH {SNAP_SQL} SELECT * FROM s WHERE complete = 1")
def available_snapshots(spark, sf):
    return catalog.available_snapshots(_snapshots(spark, sf))


@query(
    "current_snapshots",
    f"""WITH {SNAP_SQL} SELECT * FROM s WHERE complete = 1 AND snapshot_id NOT IN (SELECT predecessor_snapshot_id FROM s)
    QUALIFY row_number() OVER (PARTITION BY repository_uuidv4 ORDER BY generation DESC, snapshot_id) = 1""",
)
def current_snapshots(spark, sf):
    return catalog.current_snapshots(_snapshots(spark, sf))


@query(
    "valid_facts",
    """SELECT doc_id AS git_object_id, role AS decoder_key, min(turn) AS fact_id FROM (SELECT conv_id AS doc_id, role, turn FROM conversations)
      JOIN (SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1) USING (doc_id) GROUP BY 1, 2""",
)
def valid_facts(spark, sf):
    objects = _git_tables(spark, sf)[0]
    facts = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("git_object_id"), F.col("role").alias("decoder_key"), F.col("turn").alias("fact_id")
    )
    return catalog.valid_facts(facts, objects, ["git_object_id", "decoder_key"], "fact_id")


@query(
    "valid_ref_captures",
    f"""WITH {SNAP_SQL}, m AS (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
    SELECT DISTINCT l_orderkey AS snapshot_id, 'p' || l_partkey AS raw_ref_name, 'p' || l_partkey AS target_oid,
      CASE WHEN p_size > 25 THEN p_brand ELSE 'p' || l_partkey END AS peeled_oid,
      CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS n_tags
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN s ON s.snapshot_id = l_orderkey WHERE s.complete = 1""",
)
def valid_ref_captures(spark, sf):
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    refs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), name.alias("raw_ref_name"), name.alias("target_oid")
    ).distinct()
    tags = table(spark, sf, "part").filter("p_size > 25").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("oid"), F.col("p_brand").alias("target_oid"),
        F.lit("commit").alias("target_type"),
    )
    return catalog.valid_ref_captures(refs, _snapshots(spark, sf), tags)


@query(
    "cas_store",
    """SELECT sha256(text) AS sha256, max(strlen(text)) AS byte_length, min(doc_id) AS first_owner, count(*) AS n_refs
    FROM documents GROUP BY 1""",
)
def cas_store(spark, sf):
    return catalog.cas_store(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "cas_bodies",
    "SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_length, text FROM documents",
)
def cas_bodies(spark, sf):
    return catalog.cas_bodies(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "dedup_ratio",
    """SELECT count(DISTINCT sha256(text)) AS n_bodies, count(*) AS n_refs,
      (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM (SELECT DISTINCT text FROM documents)) AS stored_bytes,
      CAST(sum(strlen(text)) AS BIGINT) AS referenced_bytes FROM documents""",
)
def dedup_ratio(spark, sf):
    return catalog.dedup_ratio(catalog.cas_store(table(spark, sf, "documents"), "doc_id", "text"))


@query(
    "digest_verify",
    """SELECT doc_id, sha256(text) AS sha256, CASE WHEN quality = 0 OR strlen(substr(text, 1, 1)) > 1
      THEN 'length mismatch' ELSE 'digest mismatch' END AS reason
    FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1""",
)
def digest_verify(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    longer = F.when(F.col("quality") == 0, F.concat("text", F.lit("x")))
    swapped = F.when(F.col("toxic") == 1, F.concat(F.substring("text", 2, 1 << 30), F.lit("#")))
    kept = docs.select(
        "doc_id", sha256_hex("text").alias("sha256"), F.octet_length("text").alias("byte_length"),
        F.coalesce(longer, swapped, F.col("text")).alias("body"),
    )
    return catalog.verify_digests(kept, "doc_id", "body", "sha256", "byte_length")


@query(
    "cleanup_candidates",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""",
)
def cleanup_candidates(spark, sf):
    cache = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    done = (F.col("o_orderstatus") == "F").cast("int").alias("complete")
    obligations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), done)
    return catalog.cleanup_candidates(cache, obligations, "l_orderkey")


@query(
    "staging_conflicts",
    """WITH s AS (SELECT n_chars AS record_key, count(*) AS n_staged, min(sha256(text)) AS lo, max(sha256(text)) AS hi
      FROM documents GROUP BY 1), a AS (SELECT n_chars AS record_key, max(sha256(text)) AS h FROM documents JOIN labels
      USING (doc_id) GROUP BY 1)
    SELECT record_key, n_staged, CASE WHEN lo <> hi THEN 'conflict' WHEN h IS NULL THEN 'new' WHEN h = lo THEN 'identical'
      ELSE 'conflict' END AS status FROM s LEFT JOIN a USING (record_key)""",
)
def staging_conflicts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("record_key"), sha256_hex("text").alias("content"))
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    admitted = known.groupBy("record_key").agg(F.max("content").alias("content"))
    return catalog.staging_status(docs, admitted, "record_key", "content")


@query(
    "relation_staging",
    """WITH s AS (SELECT o_custkey AS record_uuidv4, count(*) AS n_staged, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi
      FROM orders GROUP BY 1)
    SELECT record_uuidv4, n_staged, CASE WHEN lo <> hi THEN 'conflict' WHEN c_custkey IS NULL THEN 'new'
      WHEN lo = '1-URGENT' THEN 'identical' ELSE 'conflict' END AS status
    FROM s LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = record_uuidv4""",
)
def relation_staging(spark, sf):
    staged = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("record_uuidv4"), F.col("o_orderpriority").alias("content_sha256")
    )
    known = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("record_uuidv4"), F.lit("1-URGENT").alias("content_sha256")
    )
    return catalog.relation_staging_status(staged, known)


@query(
    "collection_status",
    """WITH p AS (SELECT conv_id, count(*) AS n_pages, max(turn) - min(turn) + 1 > count(DISTINCT turn) OR count(*) > count(DISTINCT turn) AS gap,
        max_by(role = 'user', turn) AS more FROM conversations GROUP BY 1),
    a AS (SELECT conv_id, role AS member, count(*) AS n FROM conversations GROUP BY 1, 2),
    b AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN 'user' ELSE role END AS member, count(*) AS m FROM conversations GROUP BY 1, 2),
    o AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(*) AS n FROM a FULL JOIN b
      ON a.conv_id = b.conv_id AND a.member = b.member WHERE n IS DISTINCT FROM m GROUP BY 1)
    SELECT conv_id, n_pages, coalesce(o.n, 0) AS n_unreconciled, CASE WHEN gap THEN 'page gap' WHEN more THEN 'unfinished'
      WHEN coalesce(o.n, 0) > 0 THEN 'membership differs' ELSE 'complete' END AS state FROM p LEFT JOIN o USING (conv_id)""",
)
def collection_status(spark, sf):
    rows = table(spark, sf, "conversations")
    pages = rows.select("conv_id", F.col("turn").alias("ordinal"), (F.col("role") == "user").cast("int").alias("has_next"))
    members = rows.select("conv_id", F.col("role").alias("member"))
    expected = rows.select("conv_id", F.when(F.col("turn") % 5 == 4, "user").otherwise(F.col("role")).alias("member"))
    return catalog.collection_status(pages, members, expected, "conv_id")


@query(
    "change_totals",
    """SELECT l_orderkey, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions,
      CAST(sum(l_linenumber) AS BIGINT) AS deletions, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS changes,
      count(*) FILTER (l_returnflag = 'A') AS n_added, count(*) FILTER (l_returnflag = 'N') AS n_modified,
      count(*) FILTER (l_returnflag = 'R') AS n_removed, CAST(0 AS BIGINT) AS n_renamed FROM lineitem GROUP BY 1""",
)
def change_totals(spark, sf):
    added, deleted = F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "added").when(flag == "N", "modified").otherwise("removed")
    files = table(spark, sf, "lineitem").select(
        "l_orderkey", added.alias("additions"), deleted.alias("deletions"), (added + deleted).alias("changes"), status.alias("status")
    )
    return catalog.change_totals(files, "l_orderkey")


@query(
    "attempt_status",
    """WITH a AS (SELECT l_orderkey AS job_id, l_linenumber AS attempt, max(l_returnflag) AS state, min(epoch_us(l_shipdate)) AS created,
        max(epoch_us(l_shipdate)) AS not_before FROM lineitem GROUP BY 1, 2),
    j AS (SELECT o_orderkey AS job_id, o_orderpriority AS kind, (SELECT max(attempt) FROM a WHERE a.job_id = o_orderkey) AS current_attempt FROM orders),
    n AS (SELECT job_id, count(*) AS n FROM a GROUP BY 1)
    SELECT j.job_id, kind, current_attempt, state, coalesce(n, 0) AS n_attempts, greatest(coalesce(n, 0) - 1, 0) AS n_retries,
      CASE WHEN state IS NULL THEN 0 ELSE greatest(not_before - created, 0) END AS wait_us
    FROM j LEFT JOIN a ON a.job_id = j.job_id AND a.attempt = current_attempt LEFT JOIN n ON n.job_id = j.job_id""",
)
def attempt_status(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", _us("l_shipdate").alias("us"))
    attempts = lines.groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt")).agg(
        F.max("l_returnflag").alias("state"), F.min("us").alias("created_at_us"), F.max("us").alias("not_before_us")
    )
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("kind"))
    return catalog.attempt_status(jobs, attempts)


@query(
    "reservation_balance",
    """SELECT l_suppkey AS job_id, CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS reserved,
      CAST(sum(CAST(l_extendedprice AS BIGINT)) AS BIGINT) AS consumed,
      CAST(sum(CAST(l_quantity AS BIGINT) * 10) - sum(CAST(l_extendedprice AS BIGINT)) AS BIGINT) AS balance FROM
      (SELECT l_suppkey, l_quantity, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1""",
)
def reservation_balance(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("job_id"), (F.col("l_quantity").cast("bigint") * 10).alias("reserved"),
        F.floor("l_extendedprice").alias("consumed"),
    )
    return catalog.reservation_balance(rows)


@query(
    "active_leases",
    "SELECT l_partkey AS active_cache_entry_id, count(*) AS n_leases, min(epoch_us(l_shipdate)) AS oldest_us FROM lineitem GROUP BY 1",
)
def active_leases(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("active_cache_entry_id"), _us("l_shipdate").alias("acquired_at_us"))
    return catalog.active_leases(rows)


@query(
    "rebuild_rate",
    """SELECT event_id AS rebuild_id, d AS duration_ms, user_id AS documents_indexed, event_id * 7 AS bytes_indexed,
      CASE WHEN d > 0 THEN user_id / (d / 1000.0::DOUBLE) END AS documents_per_second,
      CASE WHEN d > 0 THEN (event_id * 7) / (d / 1000.0::DOUBLE) END AS bytes_per_second
    FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS d FROM events)""",
)
def rebuild_rate(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("rebuild_id"), F.get_json_object("props", "$.k").cast("bigint").alias("duration_ms"),
        F.col("user_id").alias("documents_indexed"), (F.col("event_id") * 7).alias("bytes_indexed"),
    )
    return catalog.rebuild_rate(rows)
