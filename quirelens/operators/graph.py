"""Neighbours, reachability, components, ancestry and paths over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.plans.frames import union_all
from quirelens.plans.lineage import Pieces, cut, release
from quirelens.plans.skew import lookup_join
from quirelens.plans.windows import next_in_group


def neighborhood(edges: DataFrame, node) -> DataFrame:
    """Both sides of one node. ``edges`` holds source, target, kind, from_columns and
    to_columns (arrays); an edge leads from the referring to the referred node."""
    label = F.concat(F.array_join("from_columns", ", "), F.lit(" -> "), F.array_join("to_columns", ", "))
    cols = [label.alias("label"), (F.col("kind") == "logical").alias("logical")]
    up = edges.filter(F.col("source") == node).select(F.lit("upstream").alias("side"), F.col("target").alias("name"), *cols)
    down = edges.filter(F.col("target") == node).select(F.lit("downstream").alias("side"), F.col("source").alias("name"), *cols)
    return up.unionByName(down)


def degrees(nodes: DataFrame, edges: DataFrame, members: str | None = None) -> DataFrame:
    """Outgoing and incoming edges of every node, zero included, and its members."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    keep = [F.size(members).alias("n_members")] if members else []
    return (
        nodes.select("node", *keep)
        .join(out, "node", "left")
        .join(into, "node", "left")
        .na.fill(0, ["n_out", "n_in"])
    )


def group_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Computed number of edges between each two different groups.

    Repeated edges are counted before they meet the groups.
    """
    from quirelens.operators.search import with_groups

    pairs = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("_n"))
    return (
        with_groups(pairs, nodes)
        .filter("source_group <> target_group")
        .groupBy("source_group", "target_group")
        .agg(F.sum("_n").alias("n_edges"))
    )


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge either way."""
    ends = edges.select(F.col("source").alias("node")).distinct().unionByName(edges.select(F.col("target").alias("node")).distinct())
    return nodes.select("node").join(ends, "node", "left_anti")


def _unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")]


def consecutive_pairs(steps: DataFrame, path: str, position: str, node: str, **options) -> DataFrame:
    """Each step with the next one of its path."""
    pairs = next_in_group(steps.select(path, position, node), [path], [position], [position, node], **options)
    return pairs.filter(F.col(f"next_{position}").isNotNull()).select(
        path, position, F.col(node).alias("a"), F.col(f"next_{node}").alias("b")
    )


def path_violations(steps: DataFrame, edges: DataFrame, path: str, position: str, node: str, **options) -> DataFrame:
    """Consecutive steps that no registered edge joins, in either direction."""
    pairs = consecutive_pairs(steps, path, position, node, **options)
    known = edges.select(*_unordered("source", "target")).distinct()
    return lookup_join(
        pairs.select(path, position, "a", "b", *_unordered("a", "b")), known, ["_lo", "_hi"], "left_anti", [path, position]
    ).drop("_lo", "_hi")


def short_paths(steps: DataFrame, path: str) -> DataFrame:
    """Paths of fewer than two steps."""
    return steps.groupBy(path).agg(F.count(F.lit(1)).alias("n_steps")).filter("n_steps < 2")


def mark_path(nodes: DataFrame, edges: DataFrame, steps: DataFrame, position: str = "pos", node: str = "node"):
    """Nodes and edges with a flag for lying on one path of ``steps``."""
    walked = steps.select(F.lit(0).alias("_path"), position, node)
    pairs = consecutive_pairs(walked, "_path", position, node)
    links = pairs.select(*_unordered("a", "b")).distinct().withColumn("on_path", F.lit(True))
    on_edges = lookup_join(
        edges.select("*", *_unordered("source", "target")), links, ["_lo", "_hi"], "left", edges.columns
    ).na.fill(False, ["on_path"])
    stops = steps.select(F.col(node).alias("node")).distinct().withColumn("on_path", F.lit(True))
    on_nodes = nodes.join(stops, "node", "left").na.fill(False, ["on_path"])
    return on_nodes.select(*nodes.columns, "on_path"), on_edges.select(*edges.columns, "on_path")


# Doubled links may outnumber the edges by this factor before hops stay single.
GROWTH = 8
# A node is a hub when more two-hop walks than this lead through it.
HUB = 64


def _through(links: DataFrame) -> DataFrame:
    """For each node that links lead through, how many come in (a) and go out (b)."""
    into = links.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("a"))
    out = links.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("b"))
    return into.join(out, "node")


def _doubled(links: DataFrame, budget: int, hubs: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame | None:
    """Pairs joined by two of ``links`` in a row, or None when there could be more than
    ``budget`` of them. The bound is counted before any pair is made.

    No walk leads through one of ``hubs``. Pairs of ``known`` have a shorter walk, as has a node to
    itself, and are left out: on a line that can be walked both ways two ends are left to
    each node, where all walks would give as many as there are steps.
    """
    through = _through(links)
    if hubs is not None:
        through = through.join(hubs, "node", "left_anti")
    bound = through.agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0]
    if bound is None or bound > budget:
        return None
    first = links.withColumnRenamed("target", "mid")
    second = links.withColumnRenamed("source", "mid")
    if hubs is not None:
        first = first.join(hubs.select(F.col("node").alias("mid")), "mid", "left_anti")
    pairs = lookup_join(first, second, ["mid"], "inner", ["source"]).select("source", "target").distinct()
    if known is not None:
        pairs = pairs.filter("source <> target").join(known, ["source", "target"], "left_anti")
    return cut(pairs)


def walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reached from each origin along edge direction, with the least hops.

    ``seeds`` holds origin and node. Links of 2, 4, 8, ... hops that lead through no hub are
    made first. Between two hubs a shortest path is a run of strides along the longest links
    and at most one link of each shorter length, longest first, so a segment of n
    edges takes about log2(n) rounds. Hubs are where segments end: those that were
    reached, each with its distance, are the sources of the next segments. So a line takes
    rounds in the logarithm of its length also where a star sits on it, and a path through h
    hubs that many times h. Where all nodes are hubs, as in a dense graph, hops are single.
    """
    links = [cut(edges.select("source", "target").filter("source <> target").distinct())]
    n_edges = links[0].count()
    hubs = cut(_through(links[0]).filter(F.col("a").cast("double") * F.col("b") > HUB).select("node"))
    # No shortest path has more hops than there are edges.
    while 1 << len(links) <= n_edges:
        longer = _doubled(links[-1], GROWTH * n_edges, hubs, union_all(links))
        if longer is None or longer.isEmpty():
            break
        links.append(longer)
    top = len(links) - 1
    reached = Pieces()
    frontier = reached.add(seeds.select("origin", "node").distinct().withColumn("hops", F.lit(0).cast("bigint")))
    while True:
        # What this round has found, in pieces; a later stage goes on from all of them.
        found = [frontier]
        while not found[-1].isEmpty():
            found.append(_nearer(reached, found[-1], links[top], 1 << top))
        found.pop()
        for i in reversed(range(top)):
            step = _nearer(reached, union_all(found) if found else frontier, links[i], 1 << i)
            if not step.isEmpty():
                found.append(step)
        if not top or len(found) < 2:
            return _least(reached)
        frontier = cut(union_all(found[1:]).join(hubs, "node", "left_semi").groupBy("origin", "node").agg(F.min("hops").alias("hops")))
        if frontier.isEmpty():
            return _least(reached)


def _least(reached: Pieces) -> DataFrame:
    return reached.all().groupBy("origin", "node").agg(F.min("hops").alias("hops"))


def _nearer(reached: Pieces, places: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """Places that one of ``links`` leads to from ``places`` in fewer hops than any known way, added to ``reached``."""
    step = _along(places, links).groupBy("origin", "node").agg((F.min("hops") + hops).alias("hops"))
    before = _least(reached).withColumnRenamed("hops", "_hops")
    new = step.join(before, ["origin", "node"], "left").filter("_hops is null or hops < _hops")
    return reached.add(new.select("origin", "node", "hops"))


def _along(places: DataFrame, links: DataFrame) -> DataFrame:
    """Places moved by one link, with what they carry."""
    ends = links.select(F.col("source").alias("node"), F.col("target").alias("_to"))
    return lookup_join(ends, places, ["node"], "inner", ["_to"]).drop("node").withColumnRenamed("_to", "node")


def both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select("source", "target")
    return there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target")))


def reachable(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """Nodes joined to the seed nodes by edges in either direction, with hops."""
    out = walk(both_ways(edges), seed.select(F.lit(0).alias("origin"), "node"))
    return out.select("node", F.col("hops").cast("int").alias("hops"))


# How often a node goes on to its neighbour's choice within one round.
JUMPS = 2


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(member, representative): members joined by edges share the least of them.

    Contraction: in each round every node moves to the neighbour with the most
    edges, equal ones by hash, unless it has most itself; then it goes on to its
    neighbour's choice, and the graph shrinks to the chosen nodes. Nodes that stay
    are never next to each other and never outnumber their neighbours, so stars
    and long chains both shrink fast. Choices are aggregates that combine before
    their shuffle, so a node with very many edges is no hot spot.
    """
    edges = cut(edges.select(*_unordered("source", "target")).filter("_lo <> _hi").distinct())
    moves = []
    while not edges.isEmpty():
        ends = edges.select(F.col("_lo").alias("a"), F.col("_hi").alias("b"))
        sides = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = sides.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        best = (
            lookup_join(sides, degree, ["b"], "inner", ["a"], moves_on=True)
            .groupBy("a")
            .agg(
                F.max(F.struct("n", F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("near"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        own = F.struct("n", F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        move = best.select(F.col("a").alias("member"), F.greatest(own, F.col("near"))["v"].alias("head"))
        for _ in range(JUMPS):
            ahead = move.select(F.col("member").alias("head"), F.col("head").alias("_head"))
            move = lookup_join(move, ahead, ["head"], "inner", ["member"], moves_on=True).select("member", F.col("_head").alias("head"))
        move = cut(move)
        moves.append(move)
        moved = edges
        for end, other in (("_lo", "_hi"), ("_hi", "_lo")):
            side = move.select(F.col("member").alias(end), F.col("head").alias("_head"))
            moved = lookup_join(moved, side, [end], "inner", [other], moves_on=True).select(F.col("_head").alias(end), other)
        before, edges = edges, cut(moved.select(*_unordered("_lo", "_hi")).filter("_lo <> _hi").distinct())
        release(before)
    if moves:
        # Later moves speak of the few nodes left by earlier ones; fold them back.
        final = moves[-1]
        for move in reversed(moves[:-1]):
            later = final.select(F.col("member").alias("head"), F.col("head").alias("_next"))
            final = lookup_join(move, later, ["head"], "left", ["member"], moves_on=True).select(
                "member", F.coalesce("_next", "head").alias("head")
            )
        final = cut(final)
        release(*moves)
        least = final.groupBy("head").agg(F.min("member").alias("representative"))
        out = lookup_join(final, least, ["head"], "inner", ["member"], moves_on=True).select("member", "representative")
    else:
        out = edges.select(F.col("_lo").alias("member"), F.col("_hi").alias("representative"))
    if nodes is None:
        return out
    every = nodes.select(F.col("node").alias("member")).distinct()
    return every.join(out, "member", "left").select("member", F.coalesce("representative", "member").alias("representative"))


def follow(links: DataFrame) -> DataFrame:
    """Where each node's chain of single links ends, and after how many.

    ``links`` holds node and next, one row per node. Each round joins the table
    to itself and doubles the reach of every pointer, so a chain of n links takes
    about log2(n) rounds. A cycle is an error.
    """
    active = cut(links.select("node", F.col("next").alias("last"), F.lit(1).cast("bigint").alias("hops")))
    bound, rounds, everything = active.count(), Pieces(), active
    while True:
        ahead = everything.select(F.col("node").alias("last"), F.col("last").alias("_last"), F.col("hops").alias("_hops"))
        moved = rounds.add(
            lookup_join(active, ahead, ["last"], "left", ["node"]).select(
                "node", F.coalesce("_last", "last").alias("last"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.col("_last").isNotNull().alias("_moved"),
            )
        )
        state = moved.agg(F.count_if("_moved").alias("moved"), F.max("hops").alias("hops")).first()
        if state["hops"] is not None and state["hops"] > bound:
            raise ValueError("The links form a cycle")
        # A pointer that found nothing ahead has reached its end and rests.
        done = rounds.all().filter("not _moved").drop("_moved")
        if not state["moved"]:
            return done
        active = moved.filter("_moved").drop("_moved")
        everything = done.unionByName(active)


def ancestry(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """Distinct ancestors of each head with their least distance.

    ``parents`` holds child and parent, ``heads`` holds node; a head is its own
    ancestor at depth 0.
    """
    edges = parents.filter("parent is not null").select(F.col("child").alias("source"), F.col("parent").alias("target"))
    out = walk(edges, heads.select(F.col("node").alias("origin"), "node"))
    return out.select(F.col("origin").alias("head"), F.col("node").alias("ancestor"), F.col("hops").cast("int").alias("depth"))


def flatten_tree(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Full path of every leaf below each root.

    ``entries`` holds tree, name and child; ``roots`` holds root (a tree). Relative paths from tree to
    subtree are composed with themselves: a round has all paths of 2^k names and doubles the depth to
    which roots are followed, so depth d takes about log2(d) rounds. A subtree shared by several
    trees appears below each. Trees in a circle are an error: one that contains itself is
    seen at once, others when there are paths of more names than trees. Where two paths join the same
    pair of trees, the pairs are followed first, so that a circle cannot multiply paths without end.
    """
    entries = cut(entries.select("tree", "name", "child"))
    trees = entries.select("tree").distinct()
    n_trees, sure = trees.count(), False
    inside = lookup_join(entries, trees.select(F.col("tree").alias("child")), ["child"], "left_semi", ["name"])
    steps = cut(inside.select("tree", F.col("name").alias("path"), "child"))
    found, k = Pieces(), 0
    found.add(roots.select("root", F.col("root").alias("tree"), F.lit("").alias("prefix")).distinct())
    while True:
        state = steps.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("tree") == F.col("child")), F.lit(False)).alias("own")).first()
        if state["own"] or (state["n"] and 1 << k >= n_trees):
            raise ValueError("The trees form a cycle")
        if not state["n"]:
            break
        if not sure and steps.select("tree", "child").distinct().count() < state["n"]:
            _refuse_cycles(inside.select("tree", "child").distinct(), n_trees)
            sure = True
        ahead = steps.select("tree", F.col("path").alias("_path"), F.col("child").alias("_to"))
        deeper = lookup_join(found.all(), ahead, ["tree"], "inner", ["prefix"])
        found.add(deeper.select("root", F.col("_to").alias("tree"), F.concat("prefix", "_path", F.lit("/")).alias("prefix")))
        second = ahead.withColumnRenamed("tree", "child")
        longer = lookup_join(steps, second, ["child"], "inner", ["path"])
        before, steps = steps, cut(longer.select("tree", F.concat_ws("/", "path", "_path").alias("path"), F.col("_to").alias("child")))
        release(before)
        k += 1
    leaves = lookup_join(entries, trees.select(F.col("tree").alias("child")), ["child"], "left_anti", ["name"])
    out = lookup_join(leaves, found.all(), ["tree"], "inner", ["name"])
    return out.select("root", F.concat("prefix", "name").alias("path"), F.col("child").alias("leaf"))


def _refuse_cycles(pairs: DataFrame, n_trees: int) -> None:
    """Raise if the trees of (tree, child) form a cycle: pairs that 2^k steps join run out unless they do."""
    pairs, k = cut(pairs), 0
    while not pairs.isEmpty():
        if 1 << k >= n_trees:
            raise ValueError("The trees form a cycle")
        second = pairs.select(F.col("tree").alias("child"), F.col("child").alias("_to"))
        longer = lookup_join(pairs, second, ["child"], "inner", ["tree"]).select("tree", F.col("_to").alias("child")).distinct()
        before, pairs = pairs, cut(longer)
        release(before)
        k += 1


def manifest_gaps(flat: DataFrame, manifests: DataFrame) -> DataFrame:
    """Roots whose number of leaves differs from the declared one, or that are not
    declared complete. ``manifests`` holds root, entry_count and complete."""
    n = flat.groupBy("root").agg(F.count(F.lit(1)).alias("n_found"))
    return (
        manifests.join(n, "root", "left")
        .na.fill(0, ["n_found"])
        .filter((F.col("n_found") != F.col("entry_count")) | ~F.col("complete"))
    )


def peel(refs: DataFrame, tags: DataFrame) -> DataFrame:
    """Each ref with the first object behind its target that is no tag.

    ``tags`` holds oid, target_oid and target_type, ``refs`` holds ref and
    target_oid. An id names an object within its format: both may hold
    object_format, and tags target_format (their own where it is null). A chain that
    ends at a tag which is not there peels to null.
    """
    own = F.col("object_format") if "object_format" in tags.columns else F.lit(None).cast("string")
    next_format = F.coalesce("target_format", own) if "target_format" in tags.columns else own
    ref_format = F.col("object_format") if "object_format" in refs.columns else F.lit(None).cast("string")

    def name(form, oid):
        # A null format is a format of its own.
        return F.struct(F.coalesce(form, F.lit("")).alias("format"), F.col(oid).alias("oid"))

    links = tags.select(name(own, "oid").alias("node"), name(next_format, "target_oid").alias("next"), "target_type")
    ends = follow(links.select("node", "next"))
    lost = (
        links.filter("target_type = 'tag'")
        .select(F.col("next").alias("last"))
        .distinct()
        .join(links.select(F.col("node").alias("last")), "last", "left_anti")
        .withColumn("_lost", F.lit(True))
    )
    known = lookup_join(ends, lost, ["last"], "left", ["node"]).select(F.col("node").alias("_node"), "last", "hops", "_lost")
    out = lookup_join(refs.withColumn("_node", name(ref_format, "target_oid")), known, ["_node"], "left", ["ref"])
    return out.select(
        *refs.columns,
        F.when(F.col("_lost").isNull(), F.coalesce("last.oid", "target_oid")).alias("peeled_oid"),
        F.coalesce("hops", F.lit(0)).alias("n_tags"),
    )
