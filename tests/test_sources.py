import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from quirelens.functions import text, times
from quirelens.functions.hashing import canonical_map_json
from quirelens.operators.audit import audit_inventory
from quirelens.sources import files, inventory, markup, sinks


def column(name, type_="text", notnull=True, pk=False):
    return {"name": name, "type": type_, "notnull": notnull, "is_pk": pk, "pk_position": 0, "default_value": None,
            "is_generated": False, "generation_type": None}


def model(profile=None):
    tables = {
        "parent": {"name": "parent", "group": "g1", "group_title": "One", "is_strict": True, "primary_key": ["a", "b"],
                   "columns": [column("a", pk=True), column("b", "integer", pk=True), column("body", "blob", False)],
                   "foreign_keys": [], "unique_constraints": [], "indexes": []},
        "child": {"name": "child", "group": "g2", "group_title": "Two", "is_strict": True, "primary_key": ["a"],
                  "columns": [column("a", pk=True), column("b", "integer", False), column("c")],
                  "foreign_keys": [
                      {"id": 0, "from_columns": ["a", "b"], "target_table": "parent", "to_columns": [None, None],
                       "on_update": "NO ACTION", "on_delete": "NO ACTION", "is_composite": True},
                      {"id": 1, "from_columns": ["c"], "target_table": "child", "to_columns": ["a"],
                       "on_update": "RESTRICT", "on_delete": "RESTRICT", "is_composite": False}],
                  "unique_constraints": [{"name": "u", "columns": ["c"], "partial": True}, {"name": "v", "columns": ["b", "a"], "partial": False}],
                  "indexes": [{"name": "i", "columns": ["c"], "unique": True, "partial": True, "predicate": "c <> ''", "sql": None}]},
    }
    out = {"stores": {"core": {"title": "Core", "db_filename": "c.db", "schema_version": 1, "ddl_sha256": "x", "tables": tables}},
           "logical_dependencies": []}
    if profile:
        out["profile"] = profile
    return out


@pytest.fixture
def inv(spark, tmp_path):
    path = tmp_path / "inventory.json"
    path.write_text(json.dumps(model(), indent=2))
    return inventory.read_inventory(spark, str(path))


def test_inventory_frames(inv):
    assert rows(inventory.store_totals(inv)) == [("core", 2, 6, 3, 2, 1)]
    refs = {(r.table, r.id): r for r in inv.references.collect()}
    assert refs[("child", 0)].to_columns == ["a", "b"] and refs[("child", 0)].is_composite
    assert inv.schema_of("core", "parent") == T.StructType(
        [T.StructField("a", T.StringType(), False), T.StructField("b", T.LongType(), False), T.StructField("body", T.BinaryType(), True)])
    with pytest.raises(ValueError):
        inv.schema_of("core", "nothing")


def test_declared_cardinality_needs_unconditional_sets_in_order(inv):
    assert rows(inventory.declared_cardinality(inv), "id", "parent_side", "child_side") == [
        (0, "zero or one", "many"), (1, "exactly one", "many")]


def test_other_profiles_are_refused(spark, tmp_path):
    path = tmp_path / "inventory.json"
    path.write_text(json.dumps(model("reduced")))
    with pytest.raises(ValueError, match="normal profile"):
        inventory.read_inventory(spark, str(path))


def test_audit_from_the_inventory(inv, frame):
    tables = {
        "parent": frame([("x", 1, None)], "a string, b long, body binary"),
        "child": frame([("x", 1, "x"), ("y", 1, "nope"), ("z", None, "x")], "a string, b long, c string"),
    }
    assert rows(audit_inventory(inv, "core", tables)) == [("child_0", 3, 1, 1), ("child_1", 3, 0, 1)]


def test_census_reads_files_and_refuses_databases(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.db").write_bytes(b"SQLite format 3\x00rest")
    (tmp_path / "c").write_bytes(b"SQLite format 3")
    got = {r[0].rsplit("/", 1)[1]: r[1:] for r in rows(files.file_census(files.read_files(spark, str(tmp_path))))}
    assert got["a.txt"] == (hashlib.sha256(b"hello").hexdigest(), 5, False)
    assert got["b.db"][2] is True and got["c"][2] is False


def test_tree_listing(frame):
    listing = "100644 blob aa\tdir/a b.txt\x00100755 blob bb\trun.sh\x00"
    assert rows(markup.parse_tree_listing(frame([(1, listing)], "id int, l string"), "l", "id")) == [
        (1, "100644", "blob", "aa", "dir/a b.txt"), (1, "100755", "blob", "bb", "run.sh")]


def test_markdown_rows_and_blocks(frame, spark):
    md = "| ADR | x |\n| --- | --- |\n| [0001](0001-a.md) | yes |\n| none | no |\n"
    assert rows(markup.parse_md_rows(frame([(md,)], "t string"), "t")) == [("0001-a.md", "| [0001](0001-a.md) | yes |")]
    doc = frame([("x\n```mermaid\n  graph\n  a\n```\n```mermaid\nsecond\n```",)], "t string")
    assert rows(markup.extract_block(doc, "t", "mermaid")) == [("graph\n  a",)]
    with pytest.raises(Exception, match="no mermaid block"):
        markup.extract_block(frame([("plain",)], "t string"), "t", "mermaid").collect()


def test_xml_readers(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        '<testsuites><testsuite><testcase classname="tests.test_a" name="one"/>'
        '<testcase classname="site.tests.test_b" name="two"><failure>no</failure></testcase>'
        '<testcase classname="site.tests.test_b" name="three"><skipped/></testcase></testsuite></testsuites>')
    assert rows(markup.read_cases(spark, str(tmp_path / "t.xml"), "site/")) == [
        ("site/tests/test_a.py::one", False), ("site/tests/test_b.py::three", True), ("site/tests/test_b.py::two", True)]
    (tmp_path / "s.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/x</loc></url>'
        '<url><loc> https://a/y </loc></url></urlset>')
    assert rows(markup.read_locations(spark, str(tmp_path / "s.xml"))) == [("https://a/x",), ("https://a/y",)]


def parts(frame, *r):
    return frame(list(r), "id int, v string, part string")


def test_only_changed_parts_are_written(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    first = parts(frame, (1, "x", "a"), (2, "y", "b"))
    assert rows(sinks.write_changed(first, path, "part")) == [("a", "added"), ("b", "added")]
    seen = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    new = parts(frame, (2, "y", "b"), (1, "z", "a"), (3, "q", "c"))
    assert rows(sinks.write_changed(new, path, "part")) == [("a", "changed"), ("b", "equal"), ("c", "added")]
    kept = [p for p in seen if p.exists()]
    assert len(kept) == 1 and "part=b" in str(kept[0]) and kept[0].stat().st_mtime_ns == seen[kept[0]]
    assert rows(spark.read.parquet(path), "id", "v", "part") == [(1, "z", "a"), (2, "y", "b"), (3, "q", "c")]
    assert {r[1] for r in rows(sinks.write_changed(new, path, "part"))} == {"equal"}


def test_new_rows_may_come_from_the_target(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_changed(parts(frame, (1, "x", "a"), (2, "y", "b")), path, "part")
    again = spark.read.schema("id int, v string, part string").parquet(path).withColumn("v", F.upper("v"))
    assert {r[1] for r in rows(sinks.write_changed(again, path, "part"))} == {"changed"}
    assert rows(spark.read.parquet(path), "id", "v", "part") == [(1, "X", "a"), (2, "Y", "b")]


def test_writes_are_refused_before_they_start(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    first = parts(frame, (1, "x", "a"), (2, "y", "b"))
    sinks.write_changed(first, path, "part")
    with pytest.raises(sinks.IncompleteOutput):
        sinks.write_changed(parts(frame, (1, "new", "a")), path, "part")
    old = sinks.part_states(parts(frame, (1, "other", "a"), (2, "y", "b")), "part")
    with pytest.raises(sinks.TargetMoved):
        sinks.write_changed(first, path, "part", baseline=old)
    with pytest.raises(sinks.TooManyParts):
        sinks.write_changed(parts(frame, (1, "n", "a"), (2, "n", "b"), (3, "n", "c")), path, "part", limit=2)
    assert rows(spark.read.parquet(path), "id", "v", "part") == [(1, "x", "a"), (2, "y", "b")]
    now = sinks.part_states(first, "part")
    assert {r[1] for r in rows(sinks.write_changed(first, path, "part", baseline=now))} == {"equal"}


def test_baseline_advances_only_on_success(spark, frame, tmp_path):
    store = sinks.BaselineStore(spark, str(tmp_path / "base"))
    assert store.read() is None
    assert store.advance(frame([(1,)], "x int")) == 1
    assert store.advance(frame([(2,)], "x int")) == 2
    bad = frame([(3,)], "x int").select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    with pytest.raises(Exception, match="boom"):
        store.advance(bad)
    assert rows(store.read()) == [(2,)]
    assert rows(store.attempts(), "version", "status") == [(1, "updated"), (2, "updated"), (3, "failed")]


def test_text_functions(frame):
    df = frame([("x" * 600,), ("x" * 601,)], "t string").select(text.truncate_long("t").alias("t"))
    a, b = [r.t for r in df.collect()]
    assert a == "x" * 600 and b.startswith("x" * 400 + "\n-- ...") and len(b) == 400 + len(text.CUT_MARK)
    df = frame([("## 2. Key (v1): a_b-c Ünï",)], "t string").select(text.heading_slug(text.headings("t")[0]))
    assert df.first()[0] == "2-key-v1-a_b-c-ünï"
    m = frame([({"b": 1, "a": 2},)], "m map<string,int>").select(canonical_map_json("m")).first()[0]
    assert m == '{"a":2,"b":1}'


def test_times_need_a_zone(frame):
    df = frame([("2024-01-01T00:00:00Z",), ("2024-01-01T09:00:00+09:00",), ("2024-01-01T00:00:00",), ("no",)], "t string")
    got = [r[0] for r in df.select(times.to_micros(times.parse_zoned("t"))).collect()]
    assert got == [1704067200000000, 1704067200000000, None, None]
    wall = frame([("2024-01-01 20:00:00",)], "t string").select(times.time_element(F.col("t").cast("timestamp_ntz"))).first()[0]
    assert wall == '<time datetime="2024-01-01T20:00:00+00:00">2024-01-02T05:00:00+09:00 (JST)</time>'


def test_null_parts_and_microseconds_are_written(spark, tmp_path):
    import datetime

    path, at = str(tmp_path / "out"), datetime.datetime(2024, 5, 1, 1, 2, 3, 123456)
    kind = "id int, at timestamp, wall timestamp_ntz, part string"
    first = spark.createDataFrame([(1, at, at, None), (2, at, at, "b")], kind)
    assert rows(sinks.write_changed(first, path, "part")) == [("b", "added"), (None, "added")]
    assert rows(spark.read.schema(kind).parquet(path), "id", "part") == [(1, None), (2, "b")]
    assert {r[1] for r in rows(sinks.write_changed(first, path, "part"))} == {"equal"}
    late = at.replace(microsecond=123999)
    second = spark.createDataFrame([(1, late, at, None), (2, at, late, "b")], kind)
    assert {r[1] for r in rows(sinks.write_changed(second, path, "part"))} == {"changed"}
    assert rows(spark.read.schema(kind).parquet(path), "id", "at", "wall") == [(1, late, at), (2, at, late)]
    with pytest.raises(sinks.EmptyPart):
        sinks.write_changed(spark.createDataFrame([(1, at, at, "")], kind), str(tmp_path / "other"), "part")


def test_more_than_a_thousand_parts(spark, tmp_path):
    many = spark.range(1100).select(F.col("id").cast("int").alias("id"), F.col("id").cast("string").alias("part")).coalesce(1)
    assert sinks.write_changed(many, str(tmp_path / "out"), "part").filter("status = 'added'").count() == 1100


def test_a_broken_move_is_finished_by_the_next_write(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    sinks.write_changed(parts(frame, (1, "x", "a"), (2, "y", "b")), path, "part")
    whole, calls = sinks._Target._move_in, []

    def halfway(self, staged, old):
        self._fs.mkdirs(old)
        place = self._path(self.root, "part=a")
        self._fs.rename(place, self._path(old, "part=a"))
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks._Target, "_move_in", halfway)
    new = parts(frame, (1, "z", "a"), (2, "w", "b"))
    with pytest.raises(RuntimeError):
        sinks.write_changed(new, path, "part")
    monkeypatch.setattr(sinks._Target, "_move_in", whole)
    assert {r[1] for r in rows(sinks.write_changed(new, path, "part"))} == {"equal"} and calls
    assert rows(spark.read.parquet(path), "id", "v", "part") == [(1, "z", "a"), (2, "w", "b")]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(("_staged", "_old"))]


def test_a_version_counts_once_its_marker_is_there(spark, frame, tmp_path):
    store = sinks.BaselineStore(spark, str(tmp_path / "base"))
    store.advance(frame([(1,)], "x int"))
    frame([(9,)], "x int").write.parquet(str(tmp_path / "base" / "v2-half"))
    assert rows(store.read()) == [(1,)]
    assert store.advance(frame([(2,)], "x int")) == 2 and rows(store.read()) == [(2,)]
    reason = "long " * 300
    bad = frame([(3,)], "x int").select(F.raise_error(F.lit(reason)).cast("int").alias("x"))
    with pytest.raises(Exception, match="long"):
        store.advance(bad)
    assert reason.strip() in store.attempts().filter("status = 'failed'").first()["reason"]


def test_census_with_modes(frame):
    df = frame([("a", "x", 0o755), ("b", "x", 0o644), ("c", "x", None)], "path string, content string, mode int")
    assert rows(files.file_census(df, mode="mode"), "path", "mode", "refused") == [("a", 0o755, True), ("b", 0o644, False), ("c", None, False)]


def test_line_ends_are_those_of_the_language(frame):
    texts = ["", "a", "a\n", "a\r\nb", "a\x0bb\x0cc", "a\x85b\u2028c\u2029", "\n\n", "a\x1cb", "a\r\n\r\n"]
    got = frame([(t,) for t in texts], "t string").select("t", text.line_count("t")).collect()
    assert {r[0]: r[1] for r in got} == {t: len(t.splitlines()) for t in texts}
