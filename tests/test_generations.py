"""Index generations: damage of any kind, states by compare and set, leases and removal."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quirelens.operators import fulltext
from quirelens.sources import generations
from quirelens.sources.generations import GenerationStore, Leased, WrongState

TEXTS = ["alpha beta", "Alpha", "al", "xaly", "日本語テキスト", "", "a.b*c", "alphabet", None, "betalpha"]


@pytest.fixture
def docs(frame):
    return frame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture
def store(spark, tmp_path):
    return GenerationStore(spark, str(tmp_path / "index"))


def postings_at(store, number):
    return Path(store.path, store._read(f"g{number}.building")["data"])


def replace(store, number, altered):
    """Put other postings where a generation has its own."""
    place = postings_at(store, number)
    altered = store.spark.createDataFrame(altered.collect(), altered.schema)
    altered.coalesce(1).write.mode("overwrite").parquet(str(place))


@pytest.mark.parametrize("q", ["al", "alpha", "日本語", "zzz", "b*c", "alpha beta gamma", "bet"])
def test_search_is_the_scan(docs, store, q):
    store.build(docs, "7")
    got = store.search(docs, q, "7")
    assert rows(got, "doc_id") == rows(fulltext.direct_scan(docs, q), "doc_id")
    assert {r[0] for r in rows(got, "fallback_reason")} <= {"query too short" if len(q) < 3 else None}


def test_damage_of_any_kind_is_told_and_harmless(docs, store, frame):
    number = store.build(docs, "7")
    whole = store._postings(number)
    whole = store.spark.createDataFrame(whole.collect(), whole.schema)
    hit = (F.col("gram") == "lph") & (F.col("doc_id") == 7)
    damage = {
        "lost": whole.filter(~hit),
        "repeated": whole.union(whole.filter(hit)),
        "changed id": whole.withColumn("doc_id", F.when(hit, F.lit(3)).otherwise(F.col("doc_id"))),
        "changed gram": whole.withColumn("gram", F.when(hit, F.lit("lpq")).otherwise(F.col("gram"))),
        "wrong bucket": whole.withColumn("bucket", F.when(hit, F.col("bucket") + 1).otherwise(F.col("bucket"))),
        "swapped": whole.withColumn("doc_id", F.when(F.col("gram") == "lph", 7 - F.col("doc_id")).when(F.col("gram") == "pha", F.col("doc_id")).otherwise(F.col("doc_id")))
        .withColumn("gram", F.when(hit, F.lit("pha")).otherwise(F.col("gram"))),
        "lost gram": whole.filter("gram <> 'pha'"),
        "other columns": whole.withColumnRenamed("gram", "term"),
    }
    want = [(i, "index corrupt") for i, t in enumerate(TEXTS) if t and "alpha" in t]
    for kind, altered in damage.items():
        replace(store, number, altered)
        assert rows(store.search(docs, "alpha", "7"), "doc_id", "fallback_reason") == want, kind
        # A query whose buckets are whole is answered from the index all the same.
        if kind not in ("other columns",):
            assert rows(store.search(docs, "日本語", "7"), "doc_id", "fallback_reason") == [(4, None)], kind
    replace(store, number, whole)
    assert {r[1] for r in rows(store.search(docs, "alpha", "7"), "doc_id", "fallback_reason")} == {None}
    for file in postings_at(store, number).glob("*.parquet"):
        file.write_bytes(b"junk")
    assert rows(store.search(docs, "alpha", "7"), "doc_id", "fallback_reason") == want
    for file in postings_at(store, number).iterdir():
        file.unlink()
    postings_at(store, number).rmdir()
    assert {r[1] for r in rows(store.search(docs, "alpha", "7"), "doc_id", "fallback_reason")} == {"index missing"}


def test_searches_write_nothing(docs, store, tmp_path):
    def seen():
        return sorted((str(p), p.stat().st_mtime_ns) for p in tmp_path.rglob("*"))

    before = seen()
    assert {r[0] for r in rows(store.search(docs, "alpha", "1"), "fallback_reason")} == {"index missing"}
    assert seen() == before
    store.build(docs, "1")
    before = seen()
    for q, fence in (("alpha", "1"), ("alpha", "2"), ("al", "1")):
        store.search(docs, q, fence).collect()
    assert seen() == before
    assert {r[0] for r in rows(store.search(docs, "alpha", "2"), "fallback_reason")} == {"index stale"}


def test_a_bucket_is_all_that_a_search_reads(docs, store, monkeypatch):
    """The check of a query's buckets reads those buckets' postings only."""
    number = store.build(docs, "7")
    read = []
    whole = generations.bucket_digests
    monkeypatch.setattr(generations, "bucket_digests", lambda df, key: read.append(df) or whole(df, key))
    assert store.distrust("alpha", number, "7") is None
    grams = set(fulltext.query_grams("alpha"))
    assert {r["bucket"] for r in read[0].select("bucket").collect()} == set(store._buckets("alpha")) and len(grams) == 3
    assert "PushedFilters: [In(bucket" in read[0]._jdf.queryExecution().executedPlan().toString()


def test_two_builders_at_once(docs, store, spark):
    other = GenerationStore(spark, store.path)
    a, b = store.begin("7"), other.begin("8")
    assert (a, b) == (1, 2) and store.states() == {1: "building", 2: "building"}
    assert store.ready() is None
    newer = other.write(b, docs)
    assert other.publish(b, newer)
    # The slower builder of an older generation does not take over again.
    assert not store.publish(a, store.write(a, docs))
    assert store.states() == {1: "retired", 2: "ready"} and store.ready() == 2
    with pytest.raises(WrongState):
        other.publish(b, newer)
    third = store.build(docs, "9")
    assert store.states() == {1: "retired", 2: "retired", 3: "ready"} and store.ready() == third


def test_numbers_and_states_are_taken_once(store, monkeypatch):
    first = store.begin("1")
    # A builder that has not seen the other's number tries the next one.
    states = GenerationStore.states
    calls = []
    monkeypatch.setattr(GenerationStore, "states", lambda self: {} if not calls.append(1) and len(calls) == 1 else states(self))
    assert (first, store.begin("1")) == (1, 2)
    monkeypatch.setattr(GenerationStore, "states", states)
    for step in ("retired", "removed"):
        with pytest.raises(WrongState):
            store._enter(1, step)
    store._enter(1, "ready")
    with pytest.raises(WrongState):
        store.write(1, None)
    # Both saw "ready"; the file decides who retires it.
    monkeypatch.setattr(GenerationStore, "states", lambda self: {1: "ready"})
    store.retire(1)
    with pytest.raises(WrongState):
        store.retire(1)


def test_what_a_reader_holds_is_not_removed(docs, store):
    old = store.build(docs, "7")
    with store.lease(old) as postings:
        new = store.build(docs, "8")
        assert store.states() == {old: "retired", new: "ready"}
        with pytest.raises(Leased):
            store.remove(old)
        assert rows(store.search(docs, "alpha", "7", old), "doc_id", "fallback_reason") == [(0, None), (7, None), (9, None)]
        assert postings.count() > 0 and store.holders(old)
    assert not store.holders(old)
    store.remove(old)
    assert store.states() == {old: "removed", new: "ready"} and not postings_at(store, old).exists()
    with pytest.raises(WrongState):
        with store.lease(old):
            pass
    for number in (old, new):
        with pytest.raises(WrongState):
            store.remove(number)
    assert rows(store.search(docs, "alpha", "8"), "doc_id", "fallback_reason") == [(0, None), (7, None), (9, None)]


def test_a_lease_ends_and_a_broken_build_goes(docs, store, monkeypatch):
    old, _ = store.build(docs, "7"), store.build(docs, "8")
    store._create(f"leases-{old}/lost", {"until": time.time() - 1})
    store.remove(old)
    left = store.begin("9")
    with pytest.raises(WrongState):
        store.remove(left)
    monkeypatch.setattr(GenerationStore, "BROKEN_AFTER", 0.0)
    store.remove(left)
    assert store.states()[left] == "removed" and store.ready() == 2


def test_a_reader_that_sees_the_intent_backs_off(docs, store):
    number = store.build(docs, "7")
    store._create(f"g{number}.removing", {})
    with pytest.raises(WrongState):
        with store.lease(number):
            pass
    assert not store.holders(number)


def test_lives_are_replayed(frame):
    tries = [(1, "ready"), (2, "building"), (3, "building"), (4, "retired"), (5, "ready"), (6, "removed"), (7, "retired"), (8, "ready"), (9, "lost"), (10, None)]
    other = [(11, "building"), (12, "ready")]
    df = frame([("a", *t) for t in tries] + [("b", *t) for t in other] + [("c", 13, "ready")], "g string, at int, state string")
    got = {r["g"]: tuple(r)[1:] for r in fulltext.lives(df, "g", "at").collect()}
    assert got == {"a": (2, 5, 7, None, "retired", 7), "b": (11, 12, None, None, "ready", 0), "c": (None, None, None, None, None, 1)}


def test_removable_ends_of_leases(frame):
    gens = frame([(i, "retired") for i in range(6)] + [(9, "ready")], "generation int, state string")
    leases = frame([(0, 1, 10, None), (1, 1, 5, None), (2, 1, 10, 4), (3, 1, 10, 6), (4, 6, 10, None)],
                   "generation int, acquired_at int, expires_at int, released_at int")
    assert rows(fulltext.removable(gens, leases, 5)) == [(1,), (2,), (4,), (5,)]


def test_fence_follows_the_files(spark, frame, tmp_path):
    path = str(tmp_path / "d")
    frame([(1, "a")], "id int, t string").write.parquet(path)
    first = fulltext.files_fence(spark.read.parquet(path))
    assert first == fulltext.files_fence(spark.read.parquet(path))
    frame([(1, "b")], "id int, t string").write.mode("overwrite").parquet(path)
    assert first != fulltext.files_fence(spark.read.parquet(path))
