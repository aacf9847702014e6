from pyspark.sql import functions as F

from conftest import rows
from quirelens.operators import audit, catalog, search


def pairs(frame):
    child = frame([(1, 1, 1), (2, 1, None), (3, None, None), (4, 9, 1), (5, 2, 2)], "id int, a int, b int")
    parent = frame([(1, 1), (2, 2)], "x int, y int")
    return child, parent, [("a", "x"), ("b", "y")]


def test_composite_orphans_exempt_partly_null_keys(frame):
    child, parent, on = pairs(frame)
    assert rows(audit.fk_orphans(child, parent, on, ["id"]), "id") == [(4,)]
    assert rows(audit.fk_summary([("r", child, parent, on)])) == [("r", 5, 2, 1)]


def test_empty_child_has_a_summary_row(frame):
    child, parent, on = pairs(frame)
    assert rows(audit.fk_summary([("r", child.limit(0), parent, on)])) == [("r", 0, 0, 0)]
    assert rows(audit.fk_summary([("r", child.limit(0), parent.limit(0), on)])) == [("r", 0, 0, 0)]


def test_unique_ignores_nulls(frame):
    df = frame([(None, 1), (None, 1), (2, 1), (2, 1), (3, 1)], "k int, v int")
    assert rows(audit.key_dups(df, ["k", "v"])) == [(2, 1, 2)]


def test_conditional_uniqueness(frame):
    df = frame([("a", None, "x"), ("a", None, "x"), ("b", "c1", "x"), ("b", "c2", "x")], "repo string, cr string, kind string")
    by_repo = audit.key_dups_where(df, ["repo", "kind"], F.col("cr").isNull())
    assert rows(by_repo) == [("a", "x", 2)]
    assert rows(audit.key_dups(df, ["repo", "kind"]), "repo") == [("a",), ("b",)]


def test_null_audit(frame):
    df = frame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert rows(audit.null_violations(df, ["a", "b"])) == [("a", 1, 3), ("b", 2, 3)]


def test_relationship_profile(frame):
    parent = frame([(1,), (2,), (3,)], "id int")
    one = audit.relationship_profile([("r", frame([(1,), (2,)], "p int"), parent, [("p", "id")])])
    assert rows(one, "parent_side", "child_side", "childless_parents") == [("exactly one", "zero or one", 1)]
    many = audit.relationship_profile([("r", frame([(1,), (1,), (None,)], "p int"), parent, [("p", "id")])])
    assert rows(many, "parent_side", "child_side", "childless_parents") == [("zero or one", "many", 2)]


def graph(frame):
    nodes = frame([("a", "core"), ("b", "core"), ("c", "search")], "node string, group string")
    edges = frame(
        [("a", "b", "physical"), ("a", "c", "physical"), ("a", "b", "logical"), ("c", "a", "logical"), ("a", "z", "physical")],
        "source string, target string, kind string",
    )
    return nodes, edges


def test_endpoints_and_boundaries(frame):
    nodes, edges = graph(frame)
    assert rows(audit.bad_endpoints(edges, nodes)) == [("a", "z", "physical", "target")]
    known = edges.filter("target <> 'z'")
    assert rows(audit.boundary_violations(known, nodes), "source", "target", "kind") == [("a", "b", "logical"), ("a", "c", "physical")]


def test_scopes_and_edge_filters(frame):
    nodes, edges = graph(frame)
    known = edges.filter("target <> 'z'")
    assert search.edges_by_scope(known, nodes, "inside").count() == 2
    assert search.edges_by_scope(known, nodes, "crossing").count() == 2
    assert search.filter_edges(edges, "logical", "c", nearby=True).count() == 1
    assert search.filter_edges(edges, "all", "c").filter("touching").count() == 2


def test_classification(frame):
    got = audit.unclassified(
        frame([("a",), ("b",), ("c",)], "id string"), frame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "id string, group string"), "id"
    )
    assert rows(got) == [("b", 2), ("c", 0)]


def test_domains_citations_and_ids(frame):
    df = frame([("x", ["1"]), ("y", []), (None, None)], "k string, c array<string>")
    assert rows(audit.domain_violations(df, "k", ["x"]), "k") == [("y",), (None,)]
    assert audit.uncited(df, "c").count() == 2
    ids = frame([("design/core/a", "core", "a"), ("a", "core", "a")], "id string, store string, name string")
    assert rows(audit.id_mismatch(ids, "id", F.concat_ws("/", F.lit("design"), "store", "name")), "id") == [("a",)]


def test_citation_bounds(frame):
    files = frame([("a", "1\n2\n"), ("b", "1\r\n2\r\n3"), ("c", "")], "path string, text string")
    cites = frame([("a", 2), ("a", 3), ("b", 3), ("a", 0), ("x", 1), ("c", 1), ("b", None)], "path string, line int")
    got = rows(audit.bad_citations(cites, files, "path", "line", "text", ["line"]), "path", "line", "reason")
    assert got == [
        ("a", 0, "invalid line"), ("a", 3, "line outside file"), ("b", None, "invalid line"), ("c", 1, "line outside file"),
        ("x", 1, "missing file"),
    ]


def test_ordinals(frame):
    df = frame([("a", 0), ("a", 1), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("d", 5)], "g string, o long")
    assert rows(catalog.ordinal_gaps(df, ["g"], "o"), "g", "n_missing", "n_repeats") == [("b", 1, 0), ("c", 0, 1)]
    assert rows(catalog.gap_starts(df, ["g"], "o")) == [("b", 1)]


def test_searches(frame):
    df = frame([("Alpha", ["Git_OID", "x"], "g1"), ("beta", ["y"], "g2"), ("none", None, "g1")], "name string, cols array<string>, grp string")
    assert rows(search.search_entities(df, " git ", "name", "cols"), "name") == [("Alpha",)]
    assert rows(search.search_entities(df, "BETA", "name", "cols"), "name") == [("beta",)]
    assert search.search_entities(df, "  ", "name", "cols").count() == 3
    assert rows(search.search_entities(df, "", "name", "cols", "grp", "g1"), "name") == [("Alpha",), ("none",)]
    assert rows(search.search_fields(df, "alpha git_oid X", ["name", "cols"]), "name") == [("Alpha",)]
    assert rows(search.search_records(df, '"GRP":"g2"'), "name") == [("beta",)]
    assert rows(search.match_counts(df, F.col("grp") == "g1")) == [(2, 3)]


def test_bytes_that_are_no_text_stay_apart(frame):
    child = frame([(bytearray(b"\xff\x01"), 1), (bytearray(b"\xfe\x01"), 1)], "k binary, n int")
    parent = frame([(bytearray(b"\xff\x01"), 1)], "k binary, n int")
    on = [("k", "k"), ("n", "n")]
    assert rows(audit.fk_summary([("r", child, parent, on)])) == [("r", 2, 0, 1)]
    assert audit.fk_orphans(child, parent, on, []).count() == 1


def test_a_table_of_several_references_is_read_once(spark):
    from conftest import SF
    from quirelens.queries.audits import references

    plan = audit.fk_summary(references(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("l_linenumber" in x or "l_orderkey" in x for x in plan.splitlines() if "Relation" in x) == 1


def test_citation_paths(frame):
    cites = frame([("docs/a.md", 1), ("/docs/a.md", 1), ("docs/../x", 1), ("docs\\\\a.md", 1), ("src/b.py", 1), ("docs/none", 1), ("docs/a.md", 9)], "p string, n int")
    files = frame([("docs/a.md", "x\ny"), ("src/b.py", "x")], "p string, t string")
    got = rows(audit.bad_citations(cites, files, "p", "n", "t", roots=["docs"]), "p", "reason")
    assert got == [
        ("/docs/a.md", "invalid path"), ("docs/../x", "invalid path"), ("docs/a.md", "line outside file"), ("docs/none", "missing file"),
        ("docs\\\\a.md", "invalid path"), ("src/b.py", "invalid path"),
    ]


def test_null_fields_are_part_of_a_record(frame):
    df = frame([(1, None), (2, "x")], "a int, b string")
    assert rows(search.search_records(df, '"b":null'), "a") == [(1,)]
