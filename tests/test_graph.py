import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quirelens.operators import catalog, graph

EDGE = "source string, target string"


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "two stars", "loop"])
def test_components_equal_union_find(frame, shape):
    r = random.Random(7)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 60)],
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)],
        "two stars": [(0, i) for i in range(2, 30)] + [(1, i) for i in range(30, 60)] + [(29, 30)],
        "loop": [(i, (i + 1) % 20) for i in range(20)],
    }[shape]
    edges = [(a, b) for a, b in edges if a != b]
    got = rows(graph.components(frame(edges, "source int, target int")))
    assert got == sorted(brute_components(edges), key=repr)


def test_singletons_represent_themselves(frame):
    got = graph.components(frame([("b", "a"), ("c", "c")], EDGE), frame([("a",), ("b",), ("c",), ("d",)], "node string"))
    assert rows(got) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
    assert rows(graph.components(frame([], EDGE), frame([("x",)], "node string"))) == [("x", "x")]


def test_closure_follows_active_relations_of_its_kind(frame):
    relations = frame(
        [("1", "repository", "a", "b"), ("2", "repository", "b", "c"), ("3", "service", "c", "d"), ("4", "repository", None, "e")],
        "relation_uuidv4 string, entity_kind string, left string, right string",
    )
    members = frame([(x,) for x in "abcde"], "node string")
    whole = catalog.equivalence_closure(relations, members, "repository")
    assert rows(whole) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]
    active = catalog.active_relations(relations, frame([("2",), ("2",)], "relation_uuidv4 string"))
    assert rows(catalog.equivalence_closure(active, members, "repository"))[2] == ("c", "c")


def test_reachability(frame):
    edges = frame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")], EDGE)
    assert rows(graph.reachable(edges, frame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.isolated(frame([("a",), ("z",)], "node string"), edges)) == [("z",)]


def test_ancestry_of_a_merge(frame):
    parents = frame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", None), ("e", "d")], "child string, parent string")
    got = rows(graph.ancestry(parents, frame([("d",), ("b",)], "node string")))
    assert got == [("b", "a", 1), ("b", "b", 0), ("d", "a", 2), ("d", "b", 1), ("d", "c", 1), ("d", "d", 0)]


def brute_hops(edges, seed):
    out, todo = {seed: 0}, [seed]
    while todo:
        todo = [b for a in todo for x, b in edges if x == a and out.setdefault(b, out[a] + 1) == out[a] + 1]
    return out


@pytest.mark.parametrize("shape", ["line", "merges", "dense", "cycle", "random"])
def test_walk_finds_least_hops(frame, shape):
    r = random.Random(3)
    edges = {
        "line": [(i, i + 1) for i in range(70)],
        "merges": [(i, i + 1) for i in range(60)] + [(i, i + 5) for i in range(0, 55, 7)],
        "dense": [(a, b) for a in range(12) for b in range(12) if a != b],
        "cycle": [(i, (i + 1) % 23) for i in range(23)],
        "random": [(r.randrange(40), r.randrange(40)) for _ in range(70)],
    }[shape]
    seeds = [0, 5]
    got = graph.walk(frame(edges, "source int, target int"), frame([(s, s) for s in seeds], "origin int, node int"))
    want = sorted((s, n, h) for s in seeds for n, h in brute_hops(edges, s).items())
    assert sorted((x.origin, x.node, x.hops) for x in got.collect()) == want


def test_a_long_line_takes_few_rounds(frame, monkeypatch):
    written = []
    add = graph.Pieces.add
    monkeypatch.setattr(graph.Pieces, "add", lambda self, df: written.append(1) or add(self, df))
    n = 1000
    got = graph.ancestry(frame([(i, i + 1) for i in range(n)], "child long, parent long"), frame([(0,)], "node long"))
    assert got.count() == n + 1 and got.filter("depth <> ancestor").isEmpty()
    assert len(written) < 40


def test_a_star_on_a_line_takes_few_rounds(frame, monkeypatch):
    """A line that is walked both ways, with a star in its middle and one near its end."""
    written = []
    add = graph.Pieces.add
    monkeypatch.setattr(graph.Pieces, "add", lambda self, df: written.append(1) or add(self, df))
    n = 1500
    edges = [(i, i + 1) for i in range(n)] + [(n // 2, 10_000 + i) for i in range(500)] + [(n - 10, 20_000 + i) for i in range(100)]
    got = graph.reachable(frame(edges, "source long, target long"), frame([(0,)], "node long"))
    hops = {r["node"]: r["hops"] for r in got.collect()}
    want = {i: i for i in range(n + 1)} | {10_000 + i: n // 2 + 1 for i in range(500)} | {20_000 + i: n - 9 for i in range(100)}
    assert hops == want
    assert len(written) < 130


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_around_hubs_finds_least_hops(frame, seed, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 6)
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(60), r.randrange(60)) for _ in range(12)]
    for hub in r.sample(range(60), 4):
        edges += [(hub, 100 + 10 * hub + j) for j in range(4)] + [(100 + 10 * hub + j, r.randrange(60)) for j in range(2)] + [(r.randrange(60), hub) for _ in range(3)]
    seeds = [0, 17]
    got = graph.walk(frame(edges, "source int, target int"), frame([(s, s) for s in seeds], "origin int, node int"))
    want = sorted((s, n, h) for s in seeds for n, h in brute_hops(edges, s).items())
    assert sorted((x.origin, x.node, x.hops) for x in got.collect()) == want


def test_closure_of_all_kinds(frame):
    relations = frame([("x", 1, 2), ("x", 2, 3), ("y", 1, 5), (None, 1, 7), ("x", None, 3)], "entity_kind string, left int, right int")
    members = frame([("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 5), ("y", 2), (None, 7), ("z", 9)], "entity_kind string, node int")
    assert rows(catalog.equivalence_closures(relations, members)) == [
        ("x", 1, 1), ("x", 2, 1), ("x", 3, 1), ("y", 1, 1), ("y", 2, 2), ("y", 5, 1), ("z", 9, 9), (None, 7, 7)]


def test_a_hub_is_never_doubled(frame):
    links = graph.both_ways(frame([(0, i) for i in range(1, 100)], "source int, target int"))
    assert graph._doubled(links, graph.GROWTH * links.count()) is None


def test_shared_subtree_appears_below_each_parent(frame):
    entries = frame(
        [("r", "src", "t1"), ("r", "lib", "t1"), ("t1", "a.py", "f1"), ("t1", "in", "t2"), ("t2", "b", "f2"), ("r", "top", "f1")],
        "tree string, name string, child string",
    )
    flat = graph.flatten_tree(entries, frame([("r",), ("t2",)], "root string"))
    assert rows(flat) == [
        ("r", "lib/a.py", "f1"), ("r", "lib/in/b", "f2"), ("r", "src/a.py", "f1"), ("r", "src/in/b", "f2"), ("r", "top", "f1"), ("t2", "b", "f2"),
    ]
    manifests = frame([("r", 5, True), ("t2", 2, True), ("t9", 0, False)], "root string, entry_count long, complete boolean")
    assert rows(graph.manifest_gaps(flat, manifests), "root") == [("t2",), ("t9",)]


def test_peeling(frame):
    tags = frame([("t3", "t2", "tag"), ("t2", "t1", "tag"), ("t1", "c", "commit"), ("u", "lost", "tag")], "oid string, target_oid string, target_type string")
    refs = frame([("a", "t3"), ("b", "c"), ("d", "u"), ("e", "t1")], "ref string, target_oid string")
    assert rows(graph.peel(refs, tags)) == [("a", "t3", "c", 3), ("b", "c", "c", 0), ("d", "u", None, 1), ("e", "t1", "c", 1)]


def test_long_chains_and_cycles_of_links(frame):
    n = 50
    got = rows(graph.follow(frame([(i, i + 1) for i in range(n)], "node long, next long")))
    assert sorted(got) == [(i, n, n - i) for i in range(n)]
    with pytest.raises(ValueError, match="cycle"):
        graph.follow(frame([(1, 2), (2, 3), (3, 1)], "node long, next long"))


def test_threads(frame):
    comments = frame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "id string, reply string")
    got = catalog.threads(comments, "id", "reply")
    assert rows(got, "id", "root", "depth") == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)]
    assert rows(catalog.thread_totals(got)) == [("a", 3, 2), ("d", 1, 0)]


def test_paths_may_follow_an_edge_backwards(frame):
    steps = frame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c"), ("q", 1, "a"), ("q", 2, "c"), ("s", 1, "a")], "path string, pos int, node string")
    edges = frame([("b", "a"), ("b", "c")], EDGE)
    assert rows(graph.path_violations(steps, edges, "path", "pos", "node")) == [("q", 1, "a", "c")]
    assert rows(graph.short_paths(steps, "path")) == [("s", 1)]


def test_path_marks(frame):
    nodes = frame([("a",), ("b",), ("c",)], "node string")
    edges = frame([("b", "a"), ("b", "c"), ("a", "c")], EDGE)
    on_nodes, on_edges = graph.mark_path(nodes, edges, frame([(1, "a"), (2, "b")], "pos int, node string"))
    assert rows(on_nodes) == [("a", True), ("b", True), ("c", False)]
    assert rows(on_edges) == [("a", "c", False), ("b", "a", True), ("b", "c", False)]


def test_neighbours_and_degrees(frame):
    edges = frame(
        [("t", "u", "physical", ["a", "b"], ["x", "y"]), ("t", "v", "logical", ["c"], ["z"]), ("w", "t", "physical", ["d"], ["id"])],
        "source string, target string, kind string, from_columns array<string>, to_columns array<string>",
    )
    assert rows(graph.neighborhood(edges, "t")) == [
        ("downstream", "w", "d -> id", False), ("upstream", "u", "a, b -> x, y", False), ("upstream", "v", "c -> z", True),
    ]
    nodes = frame([("t", [1, 2]), ("q", [])], "node string, cols array<int>")
    assert rows(graph.degrees(nodes, edges, "cols")) == [("q", 0, 0, 0), ("t", 2, 2, 1)]


def test_edges_between_groups(frame):
    nodes = frame([("a", "g"), ("b", "g"), ("c", "h")], "node string, group string")
    edges = frame([("a", "c"), ("a", "c"), ("b", "c"), ("a", "b"), ("c", "a")], EDGE)
    assert rows(graph.group_edges(edges, nodes)) == [("g", "h", 3), ("h", "g", 1)]


def test_a_deep_tree_flattens_and_a_cycle_is_found_at_once(frame, monkeypatch):
    deep = [(f"t{i}", "d", f"t{i + 1}") for i in range(40)]
    flat = graph.flatten_tree(frame(deep, "tree string, name string, child string"), frame([("t0",)], "root string"))
    assert rows(flat) == [("t0", "/".join("d" * 40), "t40")]
    written = []
    add = graph.Pieces.add
    monkeypatch.setattr(graph.Pieces, "add", lambda self, df: written.append(1) or add(self, df))
    loop = [("a", "x", "b"), ("b", "y", "c"), ("c", "z", "b"), *deep]
    with pytest.raises(ValueError, match="cycle"):
        graph.flatten_tree(frame(loop, "tree string, name string, child string"), frame([("a",), ("t0",)], "root string"))
    assert len(written) <= 5  # two for the tables, one for each level


def test_deep_trees_take_few_rounds_and_cycles_of_any_length_are_found(frame, monkeypatch):
    rounds = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    n = 1200
    deep = [(f"t{i}", "d", f"t{i + 1}") for i in range(n)] + [(f"t{i}", "f", f"leaf{i}") for i in range(0, n, 100)]
    kind = "tree string, name string, child string"
    flat = graph.flatten_tree(frame(deep, kind), frame([("t0",), (f"t{n - 5}",)], "root string"))
    want = [("t0", "d/" * i + "f", f"leaf{i}") for i in range(0, n, 100)] + [("t0", "/".join("d" * n), f"t{n}"), (f"t{n - 5}", "/".join("d" * 5), f"t{n}")]
    assert rows(flat) == sorted(want, key=repr) and len(rounds) <= 16
    for size in (1, 3, 5):
        loop = [(f"c{i}", f"n{j}", f"c{(i + 1) % size}") for i in range(size) for j in range(2)]
        with pytest.raises(ValueError, match="cycle"):
            graph.flatten_tree(frame(deep[:60] + loop, kind), frame([("t0",)], "root string"))


def test_an_id_means_an_object_of_its_format(frame):
    tags = frame(
        [("sha1", "t", "c", "commit", None), ("sha256", "t", "d", "commit", None), ("sha1", "u", "t", "tag", "sha256")],
        "object_format string, oid string, target_oid string, target_type string, target_format string",
    )
    refs = frame([("a", "sha1", "t"), ("b", "sha256", "t"), ("c", "sha1", "u"), ("d", None, "t")], "ref string, object_format string, target_oid string")
    assert rows(graph.peel(refs, tags), "ref", "peeled_oid", "n_tags") == [("a", "c", 1), ("b", "d", 1), ("c", "d", 2), ("d", "t", 0)]
