import pytest
from pyspark.sql import functions as F

from conftest import rows
from quirelens.functions.hashing import blob_oid, has_mode_bits, is_commit_id, is_digest
from quirelens.functions.paths import is_safe_path
from quirelens.operators import catalog, fulltext


def test_blob_id(frame):
    assert frame([("hello\n",)], "t string").select(blob_oid("t")).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_identifiers_and_paths(frame):
    ids = ["a" * 40, "a" * 64, "A" * 40, "main", "a" * 40 + "\n", None]
    got = [tuple(r) for r in frame([(i,) for i in ids], "i string").select(is_commit_id("i"), is_digest("i")).collect()]
    assert got == [(True, False), (False, True)] + [(False, False)] * 4
    names = {"a/b": True, "": False, "/a": False, "a\\b": False, "a//b": False, "./a": False, "a/..": False, "..a/b..": True, "a/": False}
    assert dict(frame([(n,) for n in names], "p string").select("p", is_safe_path("p")).collect()) == names
    assert [r[0] for r in frame([(0o644,), (0o755,)], "m int").select(has_mode_bits("m", 0o111)).collect()] == [False, True]


def test_availability(frame):
    objects = frame([(1,), (2,), (3,), (4,)], "git_object_id int")
    held = frame([(1, "raw", "h1"), (2, "raw", "h2"), (3, "raw", "h3")], "git_object_id int, payload_representation string, payload_sha256 string")
    payloads = frame([("raw", "h1"), ("raw", "h2"), ("zip", "h3")], "representation string, sha256 string")
    assert rows(catalog.available_objects(objects, held, payloads, frame([("h2",)], "sha256 string"))) == [(1,)]


def test_current_snapshots(frame):
    snaps = frame(
        [("s1", "r", None, 1, 1), ("s2", "r", "s1", 1, 2), ("s3", "r", "s2", 0, 3), ("s4", "r", None, 1, 1), ("t1", "q", None, 0, 1)],
        "snapshot_id string, repository_uuidv4 string, predecessor_snapshot_id string, complete int, generation int",
    )
    assert rows(catalog.current_snapshots(snaps), "snapshot_id") == [("s4",)]


def test_current_coverage(frame):
    claims = frame([(1, "s", "partial", 5), (2, "s", "full", 9), (3, "s", "full", 9), (4, "u", "x", 1)], "coverage_claim_id int, coverage_scope_id string, coverage_state string, observed_at_us long")
    markers = frame([(2, "m"), (3, "m"), (3, "n")], "coverage_claim_id int, completion_marker_uuidv4 string")
    none = frame([], "coverage_claim_id int")
    assert rows(catalog.current_coverage(claims, markers, none), "coverage_claim_id", "n_markers") == [(3, 2), (4, 0)]
    blocked = frame([(3,), (4,)], "coverage_claim_id int")
    assert rows(catalog.current_coverage(claims, markers, blocked), "coverage_claim_id", "n_markers") == [(2, 1)]


def test_eligibility_and_its_reasons(frame):
    state = frame([(1, "a", "h1"), (2, "b", "h1"), (3, "a", "h9"), (4, "a", None)], "id int, scope string, body string")
    args = (state, frame([("b",)], "scope string"), frame([("h1",)], "body string"), "scope", "body", ["id"])
    assert rows(catalog.eligible(*args), "id") == [(1,), (4,)]
    assert rows(catalog.diagnostics(*args), "id", "reason") == [(2, "scope blocked"), (3, "body missing")]


def test_valid_facts(frame):
    facts = frame([("f1", 1, "d"), ("f0", 1, "d"), ("f2", 1, "e"), ("f3", 2, "d")], "id string, git_object_id int, decoder string")
    objects = frame([(1, 1), (2, 0)], "git_object_id int, verified int")
    assert rows(catalog.valid_facts(facts, objects, ["git_object_id", "decoder"], "id"), "id") == [("f0",), ("f2",)]


def test_content_store(frame):
    df = frame([(1, "x"), (2, "x"), (3, "yy")], "id int, body string")
    store = catalog.cas_store(df, "id", "body")
    assert rows(store, "byte_length", "first_owner", "n_refs") == [(1, 1, 2), (2, 3, 1)]
    assert rows(catalog.cas_bodies(df, "id", "body"), "body") == [("x",), ("yy",)]
    assert rows(catalog.dedup_ratio(store)) == [(2, 3, 3, 4)]


def test_digests(frame):
    good = frame([(1, "x")], "id int, body string").withColumn("sha", F.sha2("body", 256)).withColumn("n", F.lit(1))
    bad = good.withColumn("body", F.lit("y")).union(good.withColumn("n", F.lit(2))).union(good.withColumn("body", F.lit(None).cast("string")))
    assert catalog.verify_digests(good, "id", "body", "sha", "n").isEmpty()
    assert rows(catalog.verify_digests(bad, "id", "body", "sha", "n"), "reason") == [("digest mismatch",), ("length mismatch",), ("missing body",)]


def test_staging(frame):
    staged = frame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "1"), ("d", "1")], "k string, h string")
    admitted = frame([("b", "1"), ("c", "9")], "k string, h string")
    assert rows(catalog.staging_status(staged, admitted, "k", "h")) == [
        ("a", 2, "conflict"), ("b", 1, "identical"), ("c", 2, "conflict"), ("d", 1, "new")]


def test_collections(frame):
    pages = frame([("a", 0, 1), ("a", 1, 0), ("b", 0, 1), ("b", 2, 0), ("c", 0, 1), ("d", 0, 0)], "c string, ordinal int, has_next int")
    members = frame([("a", "m"), ("a", "n"), ("d", "m"), ("d", "m")], "c string, member string")
    expected = frame([("a", "m"), ("a", "n"), ("d", "m")], "c string, member string")
    assert rows(catalog.collection_status(pages, members, expected, "c"), "c", "state") == [
        ("a", "complete"), ("b", "page gap"), ("c", "unfinished"), ("d", "membership differs")]


def test_obligations(frame):
    cache = frame([("c1", "a"), ("c2", "b"), ("c3", "z")], "entry string, git_acquisition_id string")
    duties = frame([("a", 0), ("b", 1)], "git_acquisition_id string, complete int")
    assert rows(catalog.cleanup_candidates(cache, duties, "git_acquisition_id"), "entry") == [("c2",), ("c3",)]


def test_jobs(frame):
    jobs = frame([("j", "k", 2), ("n", "k", None)], "job_id string, kind string, current_attempt int")
    attempts = frame([("j", 1, "failed", 5, 5), ("j", 2, "queued", 10, 25)], "job_id string, attempt int, state string, created_at_us long, not_before_us long")
    assert rows(catalog.attempt_status(jobs, attempts)) == [("j", "k", 2, "queued", 2, 1, 15), ("n", "k", None, None, 0, 0, 0)]
    rate = catalog.rebuild_rate(frame([(500, 10, 4), (0, 1, 1)], "duration_ms long, documents_indexed long, bytes_indexed long"))
    assert rows(rate, "documents_per_second", "bytes_per_second") == [(20.0, 8.0), (None, None)]


def test_source_keys(frame):
    docs = frame([("code", "git:7"), ("commits", "git:8"), ("pr", "ab"), ("issue", "git:7"), ("code", "ab")], "kind string, source_key string")
    objects = frame([(7,)], "git_object_id long")
    bodies = frame([(bytearray(b"\xab"),)], "sha256 binary")
    assert rows(catalog.resolve_source_key(docs, objects, bodies, ["source_key"])) == [
        ("code", "ab", "git_objects", False), ("code", "git:7", "git_objects", True), ("commits", "git:8", "git_objects", False),
        ("issue", "git:7", "text_bodies", False), ("pr", "ab", "text_bodies", True)]


DOCS = ["alpha beta", "Alpha", "al", "xaly", "日本語テキスト", "", "a.b*c", "alphabet"]


@pytest.mark.parametrize("q", ["", "a", "al", "alp", "alpha", "Alpha", "ALPHA", "日本", "本語テ", "b*c", "zzz", "alpha beta gamma"])
def test_search_equals_scan(frame, q):
    docs = frame([(i, t) for i, t in enumerate(DOCS)], "doc_id int, text string")
    got = fulltext.trigram_search(fulltext.trigram_index(docs), docs, q)
    assert rows(got, "doc_id") == [(i,) for i, t in enumerate(DOCS) if q in t]


def test_fallback_reasons(frame, spark, tmp_path):
    docs = frame([(i, t) for i, t in enumerate(DOCS)], "doc_id int, text string")
    path = str(tmp_path / "index")
    fulltext.write_index(docs, path)
    before = sorted(p.name for p in tmp_path.rglob("*"))
    index = spark.read.parquet(path)
    fresh, stale = frame([(5,)], "core_revision_fence long"), frame([(4,)], "core_revision_fence long")
    core = frame([(5,)], "local_revision long")
    cases = [(index, fresh, None), (index, stale, "index stale"), (None, fresh, "index missing"), (docs, fresh, "index corrupt")]
    for idx, identity, reason in cases:
        assert rows(fulltext.search(docs, "alpha", idx, identity, core), "doc_id", "fallback_reason") == [(0, reason), (7, reason)]
    # Reads neither create nor repair anything.
    assert sorted(p.name for p in tmp_path.rglob("*")) == before


def test_generations(frame):
    gens = frame([(1, "code", "retired"), (2, "code", "ready"), (3, "code", "building"), (4, "pr", "building")], "index_generation_id int, kind string, state string")
    assert rows(fulltext.ready_generation(gens)) == [("code", 2)]
    history = frame([(1, 1, "building"), (1, 2, "ready"), (1, 3, "removed"), (2, 1, "building"), (2, 2, "odd"), (3, 1, "ready"), (3, 2, "ready")], "g int, at int, state string")
    assert rows(fulltext.illegal_transitions(history, "g", "at"), "g", "at") == [(1, 2), (2, 1), (3, 1)]


def test_projection_is_unique(frame):
    objects = frame([("code", 1, "x"), ("code", 2, None)], "kind string, git_object_id int, text string")
    used = frame([("pr", "ab"), ("pr", "ab"), ("issue", "ab"), ("pr", "gone")], "kind string, sha256 string")
    bodies = frame([("ab", "y")], "sha256 string, text string")
    assert rows(fulltext.search_projection(objects, used, bodies), "kind", "source_key") == [("code", "git:1"), ("issue", "ab"), ("pr", "ab")]


def test_a_lost_posting_gives_the_scans_answer(frame, spark, tmp_path):
    docs = frame([(i, t) for i, t in enumerate(DOCS)], "doc_id int, text string")
    core = frame([(5,)], "local_revision long")
    made = fulltext.build_generation(docs, str(tmp_path), 3, "code", 5)
    generations = spark.createDataFrame(made.collect(), made.schema)
    assert rows(fulltext.search_ready(docs, "alpha", generations, "code", core), "doc_id", "fallback_reason") == [(0, None), (7, None)]
    index = spark.read.parquet(generations.first()["path"])
    for gone in index.filter("doc_id = 0").collect():
        less = index.filter(~((F.col("gram") == gone["gram"]) & (F.col("doc_id") == 0)))
        got = fulltext.search(docs, "alpha", less, generations, core)
        assert rows(got, "doc_id", "fallback_reason") == [(0, "index corrupt"), (7, "index corrupt")]
    nowhere = generations.withColumn("path", F.lit(str(tmp_path / "none")))
    assert {r["fallback_reason"] for r in fulltext.search_ready(docs, "alpha", nowhere, "code", core).collect()} == {"index missing"}
    old = generations.withColumn("core_revision_fence", F.lit(4).cast("long"))
    assert {r["fallback_reason"] for r in fulltext.search_ready(docs, "alpha", old, "code", core).collect()} == {"index stale"}
    assert {r["fallback_reason"] for r in fulltext.search_ready(docs, "alpha", generations, "pr", core).collect()} == {"index missing"}


def test_repeated_ids_keep_their_hits(frame):
    docs = frame([(1, "xx alpha"), (1, "alpha yy"), (2, "no")], "doc_id int, text string")
    assert fulltext.trigram_search(fulltext.trigram_index(docs), docs, "alpha").count() == 2


def test_collections_without_pages(frame):
    pages = frame([("a", 0, 0)], "c string, ordinal long, has_next int")
    members = frame([("a", "m"), ("b", "m")], "c string, member string")
    expected = frame([("a", "m"), ("d", "m")], "c string, member string")
    assert rows(catalog.collection_status(pages, members, expected, "c")) == [
        ("a", 1, 0, "complete"), ("b", 0, 1, "no pages"), ("d", 0, 1, "no pages")]
