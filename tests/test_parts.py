"""Versions by manifest: commits that break off, commits at once, and what a comparison reads."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quirelens.sources import sinks
from quirelens.sources.parts import PartStore

KIND = "id int, v string, part string"


@pytest.fixture
def store(spark, tmp_path):
    return PartStore(spark, str(tmp_path / "table"))


def parts(frame, *r):
    return frame(list(r), KIND)


def ruin(store, version, keep):
    """Overwrite every data file that does not belong to the parts in ``keep``."""
    from pathlib import Path

    slots = {r[0] for r in store.spark.createDataFrame([(p,) for p in keep], "part string").select(store.slot_of(F.col("part"))).collect()}
    n = 0
    for file in Path(store.path, "data").rglob("*.parquet"):
        if not any(file.parent.name.endswith("=" + s) for s in slots):
            file.write_bytes(b"ruined")
            n += 1
    return n


def test_only_parts_that_differ_are_written(frame, store):
    first = parts(frame, (1, "x", "a"), (2, "y", "b"), (3, "z", None), (4, "w", ""))
    assert store.head() is None
    assert rows(store.commit(first)) == [("", "added"), ("a", "added"), ("b", "added"), (None, "added")]
    new = parts(frame, (1, "X", "a"), (2, "y", "b"), (3, "z", None), (4, "w", ""), (5, "n", "c"))
    assert rows(store.commit(new)) == [("", "equal"), ("a", "changed"), ("b", "equal"), ("c", "added"), (None, "equal")]
    assert rows(store.read()) == rows(new) and rows(store.read(1)) == rows(first)
    from pathlib import Path

    second = sorted(Path(store.path, "data").iterdir(), key=lambda p: p.stat().st_mtime_ns)[-1]
    assert len([p for p in second.iterdir() if p.is_dir()]) == 2
    assert {r[1] for r in rows(store.commit(new))} == {"equal"} and store.versions() == [1, 2]


@pytest.mark.parametrize("step", ["_write_data", "_write_manifest", "_mark"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_commit_that_breaks_off(frame, store, monkeypatch, step, when):
    first, new = parts(frame, (1, "x", "a"), (2, "y", "b")), parts(frame, (1, "z", "a"), (2, "w", "b"))
    store.commit(first)
    reader = store.read()
    whole = getattr(PartStore, step)

    def broken(self, *args):
        if when == "after":
            whole(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(PartStore, step, broken)
    with pytest.raises(RuntimeError):
        store.commit(new)
    monkeypatch.setattr(PartStore, step, whole)
    done = step == "_mark" and when == "after"
    assert rows(store.read()) == rows(new if done else first)
    assert rows(reader) == rows(first)  # a frame made before stays with its version
    assert {r[1] for r in rows(store.commit(new))} == {"equal" if done else "changed"}
    assert rows(store.read()) == rows(new)


def test_a_marker_without_content_is_no_version(frame, store, monkeypatch):
    first, new = parts(frame, (1, "x", "a")), parts(frame, (1, "y", "a"))
    store.commit(first)
    from pathlib import Path

    Path(store.path, "v2.json").write_text('{"manifest": "ab')
    assert rows(store.read()) == rows(first) and store.versions() == [1]
    with pytest.raises(sinks.TargetMoved):
        store.commit(new)
    monkeypatch.setattr(PartStore, "BROKEN_AFTER", 0.0)
    store.commit(new)
    assert store.versions() == [1, 3] and rows(store.read()) == rows(new)


def test_of_two_commits_at_once_one_wins(spark, frame, store, monkeypatch):
    store.commit(parts(frame, (1, "x", "a")))
    other = PartStore(spark, store.path)
    whole = PartStore._mark

    def late(self, number, content):
        monkeypatch.setattr(PartStore, "_mark", whole)
        other.commit(parts(frame, (1, "theirs", "a")))
        whole(self, number, content)

    monkeypatch.setattr(PartStore, "_mark", late)
    with pytest.raises(sinks.TargetMoved):
        store.commit(parts(frame, (1, "mine", "a")))
    assert rows(store.read(), "v") == [("theirs",)]


def test_a_reader_during_a_commit_sees_the_old_table(frame, store, monkeypatch):
    first, new = parts(frame, (1, "x", "a"), (2, "y", "b")), parts(frame, (1, "z", "a"), (2, "w", "b"))
    store.commit(first)
    seen = []
    for step in ("_write_data", "_write_manifest", "_mark"):
        whole = getattr(PartStore, step)

        def watched(self, *args, whole=whole):
            seen.append(rows(store.read()))
            out = whole(self, *args)
            seen.append(rows(store.read()))
            return out

        monkeypatch.setattr(PartStore, step, watched)
    store.commit(new)
    assert seen == [rows(first)] * 5 + [rows(new)]


def test_commits_are_refused_before_they_start(frame, store):
    first = parts(frame, (1, "x", "a"), (2, "y", "b"))
    store.commit(first)
    with pytest.raises(sinks.IncompleteOutput):
        store.commit(parts(frame, (1, "new", "a")))
    with pytest.raises(sinks.TargetMoved):
        store.commit(first, baseline=sinks.part_states(parts(frame, (1, "other", "a"), (2, "y", "b")), "part"))
    with pytest.raises(sinks.TooManyParts):
        store.commit(parts(frame, (1, "n", "a"), (2, "n", "b"), (3, "n", "c")), limit=2)
    with pytest.raises(ValueError):
        store.commit(frame([(1, "a")], "id int, part string"))
    assert store.versions() == [1] and rows(store.read()) == rows(first)
    store.commit(parts(frame, (1, "new", "a")), removed=True, baseline=store.manifest())
    assert rows(store.read()) == [(1, "new", "a")]


def test_new_rows_may_come_from_the_table(frame, store):
    store.commit(parts(frame, (1, "x", "a"), (2, "y", "b")))
    store.commit(store.read().withColumn("v", F.upper("v")))
    assert rows(store.read()) == [(1, "X", "a"), (2, "Y", "b")]


def test_types_empty_tables_and_many_parts(spark, store, tmp_path):
    at = datetime.datetime(2024, 5, 1, 1, 2, 3, 123456)
    kind = "id int, _write string, at timestamp, part timestamp"
    timed = PartStore(spark, str(tmp_path / "timed"))
    first = spark.createDataFrame([(1, "u", at, at), (2, "u", at, None), (3, "u", at, at.replace(microsecond=1))], kind)
    timed.commit(first)
    assert rows(timed.read()) == rows(first) and timed.manifest().count() == 3
    empty = PartStore(spark, str(tmp_path / "empty"))
    assert rows(empty.commit(spark.createDataFrame([], KIND))) == [] and rows(empty.read()) == []
    assert empty.read().schema.simpleString() == "struct<id:int,v:string,part:string>"
    empty.commit(spark.createDataFrame([(1, "x", "a")], KIND))
    assert rows(empty.read()) == [(1, "x", "a")]
    many = spark.range(1100).select(F.col("id").cast("int").alias("id"), F.lit("v").alias("v"), F.col("id").cast("string").alias("part"))
    store.commit(many.coalesce(1))
    assert store.read().count() == 1100


def test_a_comparison_opens_only_what_differs(spark, frame, store):
    rng = random.Random(4)
    base = [(i, f"v{rng.randrange(9)}", f"p{i % 40}") for i in range(400)]
    store.commit(frame(base, KIND))
    changed = [(i, "new" if i == 47 else v, p) for i, v, p in base if i != 87] + [(1000, "x", "p7")]
    store.commit(frame(changed, KIND))
    store.commit(frame(base, KIND))
    assert store.same(1, 3) and not store.same(1, 2)
    assert rows(store.part_changes(1, 2)) == [("p7", "changed")] and rows(store.part_changes(1, 3)) == []
    # All files but those of the part that differs are unreadable, and nobody minds.
    assert ruin(store, 2, ["p7"]) >= 39
    assert rows(store.row_changes(["id"], 1, 2), "id", "status") == [(1000, "added"), (47, "changed"), (87, "removed")]
    assert rows(store.row_changes(["id"], 1, 3)) == []
    assert store.read(2, frame([("p7",)], "part string")).count() == 10
    with pytest.raises(Exception):
        store.read(2).collect()


def test_verify_finds_altered_and_lost_parts(spark, frame, store):
    store.commit(parts(frame, (1, "x", "a"), (2, "y", "b"), (3, "z", "c")))
    assert rows(store.verify()) == []
    import shutil
    from pathlib import Path

    folder = {r[0]: r[1] for r in frame([("a",), ("b",)], "part string").select("part", store.slot_of(F.col("part"))).collect()}
    found = {p: next(Path(store.path, "data").glob(f"*/*={s}")) for p, s in folder.items()}
    shutil.rmtree(found["a"])
    for file in found["b"].glob("*"):
        file.unlink()
    for file in found["b"].glob(".*"):
        file.unlink()
    parts(frame, (2, "other", "b")).coalesce(1).write.mode("overwrite").parquet(str(found["b"]))
    assert rows(store.verify()) == [("a", "missing"), ("b", "altered")]
    assert rows(store.verify(parts=frame([("c",)], "part string"))) == []


def test_vacuum_keeps_what_versions_need(frame, store, monkeypatch):
    for v in ("x", "y", "z"):
        store.commit(parts(frame, (1, v, "a"), (2, "same", "b")))
    frame([(9,)], "x int").write.parquet(f"{store.path}/data/_write=half")
    assert store.vacuum(keep=2) == 0  # all young
    monkeypatch.setattr(PartStore, "BROKEN_AFTER", -10.0)
    assert store.vacuum(keep=1) == 4  # the half one, one old write, two old manifests
    assert store.versions() == [3] and rows(store.read()) == [(1, "z", "a"), (2, "same", "b")]
    with pytest.raises(ValueError):
        store.read(1)
    with pytest.raises(ValueError):
        store.vacuum(keep=0)
