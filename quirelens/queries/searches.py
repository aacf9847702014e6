"""Explorer filters and full-text search."""

import hashlib

from pyspark.sql import functions as F

from quirelens.functions.hashing import sha256_hex
from quirelens.operators import catalog, fulltext, search
from quirelens.plans.lineage import scratch_path, shared_path
from quirelens.queries.audits import TRADE_SQL, trade_edges
from quirelens.queries.links import LINKS_SQL
from quirelens.queries.registry import query
from quirelens.session import table
from quirelens.sources.generations import GenerationStore
from quirelens.sources.markup import extract_links


@query(
    "entity_search",
    f"""WITH {LINKS_SQL} SELECT page_id, url FROM pages p WHERE url LIKE 'https%' AND (contains(lower(url), 'the')
      OR EXISTS (SELECT 1 FROM links l WHERE l.page_id = p.page_id AND contains(lower(l.target), 'the')))""",
)
def entity_search(spark, sf):
    """Pages by their url or any of their links' targets."""
    pages = table(spark, sf, "pages")
    members = extract_links(pages).groupBy("page_id").agg(F.array_agg("target").alias("members"))
    pages = pages.select("page_id", "url", F.regexp_extract("url", "^(https?)", 1).alias("scheme")).join(members, "page_id", "left")
    return search.search_entities(pages, " The ", "url", "members", "scheme", "https").select("page_id", "url")


@query(
    "field_search",
    """SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL'
      AND contains(lower(concat_ws(' ', p_name, p_brand, array_to_string(string_split(p_name, ' '), ' '))), 'ring brand#2')""",
)
def field_search(spark, sf):
    parts = table(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    hits = search.search_fields(parts, "RING Brand#2", ["p_name", "p_brand", "words"], "p_type", "SMALL")
    return hits.select("p_partkey", "p_name")


@query(
    "record_search",
    """SELECT p_partkey FROM part WHERE contains(lower(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand,
      'p_type': p_type, 'p_size': p_size})), '"p_brand":"brand#1')""",
)
def record_search(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return search.search_records(rows, '"p_brand":"Brand#1').select("p_partkey")


@query(
    "match_counts",
    """SELECT source, count(*) FILTER (contains(lower(text), 'ment')) AS n_shown, count(*) AS n_total FROM documents GROUP BY 1""",
)
def match_counts(spark, sf):
    return search.match_counts(table(spark, sf, "documents"), F.lower("text").contains("ment"), "source")


@query(
    "group_counts",
    "SELECT lang, count(*) AS n, upper(lang) || ' (' || count(*) || ')' AS label FROM documents GROUP BY 1",
)
def group_counts(spark, sf):
    return search.group_counts(table(spark, sf, "documents"), "lang", F.upper("lang"))


@query(
    "edge_filter",
    f"""WITH {TRADE_SQL} SELECT DISTINCT source, target, kind, true AS touching FROM trade
    WHERE kind = 'logical' AND (source = 's1' OR target = 's1')""",
)
def edge_filter(spark, sf):
    return search.filter_edges(trade_edges(spark, sf).distinct(), "logical", "s1", nearby=True)


def _index(spark, sf):
    """Where the index of a folder's documents is kept. ``index_build`` writes it; searches only read, and
    scan while there is none."""
    return GenerationStore(spark, shared_path(spark, "search-" + hashlib.md5(sf.encode()).hexdigest()))


@query(
    "index_build",
    """WITH d AS (SELECT doc_id, text FROM documents),
    g AS (SELECT DISTINCT doc_id, substr(text, i, 3) AS gram FROM d, unnest(range(1, length(text) - 1)) AS u(i))
    SELECT gram, count(*) AS n_documents FROM g GROUP BY 1""",
)
def index_build(spark, sf):
    """Build a generation, publish it, remove retired ones, and count what the new one holds."""
    docs, store = table(spark, sf, "documents"), _index(spark, sf)
    number = store.build(docs, fulltext.files_fence(docs))
    for old, state in store.states().items():
        if state == "retired":
            store.remove(old)
    with store.lease(number) as postings:
        return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n_documents"))


@query("trigram_search", "SELECT doc_id, lang FROM documents WHERE contains(text, 'tion the')")
def trigram_search(spark, sf):
    docs = table(spark, sf, "documents")
    return _index(spark, sf).search(docs, "tion the", fulltext.files_fence(docs)).select("doc_id", "lang")


@query("direct_scan", "SELECT doc_id, lang FROM documents WHERE contains(text, 'tion the')")
def direct_scan(spark, sf):
    return fulltext.direct_scan(table(spark, sf, "documents"), "tion the").select("doc_id", "lang")


@query("short_search", "SELECT doc_id, lang FROM documents WHERE contains(text, 'Th')")
def short_search(spark, sf):
    docs = table(spark, sf, "documents")
    return _index(spark, sf).search(docs, "Th", fulltext.files_fence(docs)).select("doc_id", "lang")


@query(
    "search_fallback",
    """SELECT doc_id, CASE WHEN (SELECT max(doc_id) FROM documents) <> (SELECT max(doc_id) FROM labels)
      THEN 'index stale' END AS fallback_reason FROM documents WHERE contains(text, 'Ment')""",
)
def search_fallback(spark, sf):
    """A search under one revision of an index built under another."""
    docs, store = table(spark, sf, "documents"), GenerationStore(spark, scratch_path(spark))
    last = {t: str(table(spark, sf, t).agg(F.max("doc_id")).first()[0]) for t in ("documents", "labels")}
    store.build(docs, last["labels"])
    return store.search(docs, "Ment", last["documents"]).select("doc_id", "fallback_reason")


@query("search_corrupt", "SELECT doc_id, 'index corrupt' AS fallback_reason FROM documents WHERE contains(text, 'tion the')")
def search_corrupt(spark, sf):
    """A search in an index that has lost the postings of a document in seven: its digests tell, and the scan answers."""
    docs, store = table(spark, sf, "documents"), GenerationStore(spark, scratch_path(spark))
    lost = F.expr("doc_id % 7 <=> 3")
    number = store.begin("1")
    # Digests add up, so that of the whole needs no second index.
    store.publish(number, fulltext.add_digests(store.write(number, docs.filter(~lost)), store.digests(docs.filter(lost))))
    return store.search(docs, "tion the", "1").select("doc_id", "fallback_reason")


_STATE_SQL = """CASE event_type WHEN 'signup' THEN 'building' WHEN 'view' THEN 'ready' WHEN 'purchase' THEN 'retired' WHEN 'error' THEN 'removed' END"""
_LIVES_SQL = f"""
    a AS (SELECT user_id, event_id, ts, {_STATE_SQL} AS state FROM events WHERE event_type <> 'click'),
    g0 AS (SELECT user_id, count(*) AS n, min(event_id) FILTER (WHERE state = 'building') AS building_at FROM a GROUP BY 1),
    g1 AS (SELECT g0.*, (SELECT min(event_id) FROM a WHERE a.user_id = g0.user_id AND state = 'ready' AND event_id > building_at) AS ready_at FROM g0),
    g2 AS (SELECT g1.*, (SELECT min(event_id) FROM a WHERE a.user_id = g1.user_id AND state = 'retired' AND event_id > ready_at) AS retired_at FROM g1),
    g3 AS (SELECT g2.*, (SELECT min(event_id) FROM a WHERE a.user_id = g2.user_id AND state = 'removed' AND event_id > retired_at) AS removed_at FROM g2),
    lives AS (SELECT user_id, building_at, ready_at, retired_at, removed_at,
      CASE WHEN removed_at IS NOT NULL THEN 'removed' WHEN retired_at IS NOT NULL THEN 'retired' WHEN ready_at IS NOT NULL THEN 'ready'
        WHEN building_at IS NOT NULL THEN 'building' END AS state,
      n - (building_at IS NOT NULL)::BIGINT - (ready_at IS NOT NULL)::BIGINT - (retired_at IS NOT NULL)::BIGINT - (removed_at IS NOT NULL)::BIGINT AS n_refused
    FROM g3)"""


def _lives(spark, sf, removed="error"):
    """Lives of generations, one per user, whose events are attempts to change the state."""
    e = F.col("event_type")
    state = F.when(e == "signup", "building").when(e == "view", "ready").when(e == "purchase", "retired").when(e == removed, "removed")
    events = table(spark, sf, "events").filter(e != "click")
    return fulltext.lives(events.select("user_id", "event_id", state.alias("state")), "user_id", "event_id")


@query("generation_lives", f"WITH {_LIVES_SQL} SELECT * FROM lives")
def generation_lives(spark, sf):
    return _lives(spark, sf)


@query(
    "removable_generations",
    f"""WITH {_LIVES_SQL.replace("WHEN 'error' THEN 'removed'", "")}, now AS (SELECT max(ts) AS now FROM events),
    held AS (SELECT DISTINCT user_id FROM events, now WHERE event_type = 'click' AND ts <= now AND ts + to_microseconds(CAST(floor(value * 60000000) AS BIGINT)) > now)
    SELECT user_id FROM lives WHERE state = 'retired' AND user_id NOT IN (SELECT user_id FROM held)""",
)
def removable_generations(spark, sf):
    """Retired generations that no lease holds; a click takes one for as many minutes as its value."""
    events = table(spark, sf, "events")
    leases = events.filter("event_type = 'click'").select(
        "user_id", F.col("ts").alias("acquired_at"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value * 60000000) as decimal(18, 0)) / 1000000)").alias("expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("released_at"))
    return fulltext.removable(_lives(spark, sf, "none"), leases, events.agg(F.max("ts")).scalar(), "user_id")


@query(
    "index_freshness",
    """WITH r AS (SELECT max(doc_id) AS local_revision FROM documents)
    SELECT source, max(doc_id) AS core_revision_fence, any_value(local_revision) AS local_revision,
      max(doc_id) <> any_value(local_revision) AS stale FROM documents, r GROUP BY source""",
)
def index_freshness(spark, sf):
    docs = table(spark, sf, "documents")
    identity = docs.groupBy("source").agg(F.max("doc_id").alias("core_revision_fence"))
    return fulltext.index_stale(identity, docs.select(F.col("doc_id").alias("local_revision")))


@query(
    "ready_generation",
    "SELECT o_orderpriority AS kind, max(o_orderkey) AS index_generation_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
)
def ready_generation(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "building").otherwise("retired")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("index_generation_id"), F.col("o_orderpriority").alias("kind"), state.alias("state")
    )
    return fulltext.ready_generation(rows)


@query(
    "illegal_transitions",
    """WITH h AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'building' WHEN 'view' THEN 'ready'
        WHEN 'purchase' THEN 'retired' WHEN 'signup' THEN 'removed' ELSE 'lost' END AS state FROM events),
    n AS (SELECT *, lead(state) OVER (PARTITION BY user_id ORDER BY event_id) AS next_state FROM h)
    SELECT * FROM n WHERE next_state IS NOT NULL AND NOT ((state = 'building' AND next_state = 'ready')
      OR (state = 'ready' AND next_state = 'retired') OR (state = 'retired' AND next_state = 'removed'))""",
)
def illegal_transitions(spark, sf):
    e = F.col("event_type")
    state = (
        F.when(e == "click", "building").when(e == "view", "ready").when(e == "purchase", "retired")
        .when(e == "signup", "removed").otherwise("lost")
    )
    rows = table(spark, sf, "events").select("user_id", "event_id", state.alias("state"))
    return fulltext.illegal_transitions(rows, "user_id", "event_id")


PROJECTION_SQL = """
p AS (SELECT CASE WHEN lang = 'en' THEN 'code' ELSE 'commits' END AS kind, 'git:' || doc_id AS source_key, text
    FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL
  SELECT DISTINCT CASE WHEN lang = 'de' THEN 'pr' ELSE 'issue' END, sha256(text), text FROM documents WHERE lang IN ('de', 'es'))"""


def _projection(spark, sf):
    docs = table(spark, sf, "documents")
    code = docs.filter("lang in ('en', 'fr')").select(
        F.when(F.col("lang") == "en", "code").otherwise("commits").alias("kind"), F.col("doc_id").alias("git_object_id"), "text"
    )
    prose = docs.filter("lang in ('de', 'es')")
    references = prose.select(
        F.when(F.col("lang") == "de", "pr").otherwise("issue").alias("kind"), sha256_hex("text").alias("sha256")
    )
    return fulltext.search_projection(code, references, catalog.cas_bodies(prose, "doc_id", "text"))


@query("search_projection", f"WITH {PROJECTION_SQL} SELECT kind, source_key, strlen(text) AS n_bytes FROM p")
def search_projection(spark, sf):
    return _projection(spark, sf).select("kind", "source_key", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query(
    "source_key_resolve",
    f"""WITH {PROJECTION_SQL}, g AS (SELECT 'git:' || doc_id AS k FROM labels),
    b AS (SELECT DISTINCT sha256(text) AS k FROM documents JOIN labels USING (doc_id))
    SELECT kind, source_key, CASE WHEN kind IN ('code', 'commits') THEN 'git_objects' ELSE 'text_bodies' END AS target,
      CASE WHEN kind IN ('code', 'commits') THEN source_key IN (SELECT k FROM g) ELSE source_key IN (SELECT k FROM b) END AS resolved
    FROM p""",
)
def source_key_resolve(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    objects = labels.select(F.col("doc_id").alias("git_object_id"))
    bodies = (
        table(spark, sf, "documents").join(labels, "doc_id", "left_semi")
        .select(F.unhex(sha256_hex("text")).alias("sha256")).distinct()
    )
    docs = _projection(spark, sf).select("kind", "source_key")
    return catalog.resolve_source_key(docs, objects, bodies, ["source_key"])
