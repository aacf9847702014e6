"""Near copies by SimHash, made whole by the exact Jaccard similarity of sets of word shingles.

Fingerprints of the sets within three bits of each other give the first candidates, which
the sets themselves confirm. A fingerprint misses most copies of a similarity near eight tenths,
so more candidates come from prefixes: of two sets that share eight tenths of their union, each
has a common shingle among its first fifth, whatever one order both are sorted in. So no
pair is missed; an order with rare shingles first only keeps the candidates few. Every set
has a bit sketch a twentieth of its size: bits that differ are shingles that differ, so a
sketch can rule a pair out, never lose one, and only what is left compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm import simhash
from quirelens.llm.common import fresh, ship, text_of
from quirelens.operators.graph import components
from quirelens.plans.lineage import cut, release
from quirelens.plans.skew import lookup_join

WORDS = 5
RADIUS = 3  # bits between fingerprints of likely near copies
OVER, UNDER = 4, 5  # near copies share OVER of UNDER parts of their union, or more
SAMPLE = 32  # one text of so many tells which shingles are common
COMMON = 200_000  # most common shingles that are put last
SMALL = 500_000  # node ids that are safe to broadcast


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The XXH3 hashes of the different word shingles, ascending.

    A-Z count as a-z; words end at ASCII white space. With fewer words than a shingle
    needs the whole sequence, be it empty, is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    starts = [0, *ends[:-1].tolist()][: max(1, len(parts) - words + 1)]
    ends = (ends - 1)[min(words, len(parts)) - 1 :].tolist() if parts else [0]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def common_shingles(documents: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, ascending, and of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words).view(np.int64))], ["token"])

    sample = documents.select(text_of().alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = counted.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens = found["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy()[order]


def prefix(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first tokens in the order of the whole, as many as a near copy cannot all lack."""
    weight = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        weight = np.where(common[at] == tokens, counts[at], 0)
    size = len(tokens)
    return tokens[np.lexsort((tokens, weight))][: size - -(-OVER * size // UNDER) + 1]


def sketch(tokens: np.ndarray) -> bytes:
    """A bit per shingle, at its hash in three to six times as many places as there are shingles."""
    bits = np.zeros(max(64, 1 << (3 * len(tokens) - 1).bit_length()), bool)
    bits[tokens & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def fingerprint(tokens: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    return simhash.majority(tokens[i : i + simhash.CHUNK] for i in range(0, len(tokens), simhash.CHUNK))


def possible(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes) -> bool:
    """Whether sets of these sketches can be near copies. A place set in one sketch alone is a shingle of one set alone."""
    a, b = (np.frombuffer(v, np.uint8) for v in sorted((bits_a, bits_b), key=len))
    # The places of a larger sketch fold onto those of the smaller: both count in powers of two.
    apart = int(np.bitwise_count(a ^ np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    return (size_a + size_b - apart) * (OVER + UNDER) >= 2 * (size_a + size_b) * OVER


def _fits(size_a: Column, pos_a: Column, size_b: Column, pos_b: Column) -> Column:
    """Whether two sets can be near copies if this is the first token they share."""
    most = F.least(size_a - pos_a, size_b - pos_b)
    sizes = (size_a * UNDER >= size_b * OVER) & (size_b * UNDER >= size_a * OVER)
    return sizes & (most * (OVER + UNDER) >= (size_a + size_b) * OVER)


def _plausible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs that their sketches do not rule out, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x_size", "x_bits", "y_size", "y_bits")]
            keep = pa.array([possible(*sides) for sides in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("source").filter(keep), batch.column("target").filter(keep)], ["source", "target"])

    side = lambda name, mark: prints.select(
        F.col("node").alias(name), F.col("size").alias(mark + "_size"), F.col("bits").alias(mark + "_bits"))
    held = lookup_join(pairs, side("source", "x"), ["source"], "inner", ["target"], moves_on=True)
    held = lookup_join(held, side("target", "y"), ["target"], "inner", ["source"], moves_on=True)
    return cut(held.mapInArrow(run, "source bigint, target bigint"))


def _confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (source, target) whose sets are near copies, written down. ``sketches`` has node, size and bits,
    one row per node; ``texts`` has row, node and text, and a node's row is its least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node"), batch.column("text")):
                tokens = pa.array([shingles(text.as_py(), words).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), tokens], ["node", "tokens"])

    likely = _plausible(pairs, sketches)
    ids = cut(likely.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    small = ids.count() <= SMALL
    held = texts.join(F.broadcast(ids) if small else ids, "node", "left_semi")
    least = cut(held.groupBy("node").agg(F.min("row").alias("row")))
    held = held.join(F.broadcast(least.select("row")) if small else least.select("row"), "row", "left_semi")
    sets = cut(held.select("node", "text").mapInArrow(run, "node bigint, tokens array<bigint>"))
    a = sets.select(F.col("node").alias("source"), F.col("tokens").alias("a"))
    b = sets.select(F.col("node").alias("target"), F.col("tokens").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    near = shared * (OVER + UNDER) >= (F.size("a") + F.size("b")) * OVER
    both = lookup_join(likely, a, ["source"], "inner", ["target"], moves_on=True)
    out = cut(lookup_join(both, b, ["target"], "inner", ["source"], moves_on=True).filter(near).select("source", "target"))
    release(likely, ids, least, sets)
    return out


def shared_postings(prints: DataFrame, common: np.ndarray) -> DataFrame:
    """token, node, size and pos of the tokens that more than one set may hold, written down.

    What the sample knows to be common is kept as it is. The rest moves once, by token, in rows of
    three numbers; a token of one set only, as most are, ends there. So no task
    gathers a common token's rows only to learn that there are several.
    """
    known = np.sort(common.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes, nodes = batch.column("prefix"), np.asarray(batch.column("size")), np.asarray(batch.column("node"))
            lengths = np.diff(np.asarray(first.offsets))
            tokens = np.asarray(first.flatten())
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            often = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(nodes[owner]), pa.array(sizes[owner].astype(np.int64) << 32 | pos), pa.array(often)],
                ["token", "node", "place", "often"])

    postings = prints.select("node", "size", "prefix").mapInArrow(run, "token bigint, node bigint, place bigint, often boolean")
    place = [F.shiftright("place", 32).cast("int").alias("size"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("pos")]
    token = Window.partitionBy("token")
    rare = postings.filter("not often").select("token", "node", "place")
    rare = rare.withColumn("lo", F.min("node").over(token)).withColumn("hi", F.max("node").over(token)).filter("lo <> hi")
    often = postings.filter("often").select("token", "node", "place")
    return cut(often.unionByName(rare.select("token", "node", "place")).select("token", "node", *place))


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("source"), F.greatest(x, y).alias("target")


def alike(prints: DataFrame) -> DataFrame:
    """source and target of the nodes that SimHash puts together, written down. ``prints`` has node and fp.

    Nodes of one fingerprint meet the least of them, which meets those of other fingerprints
    within RADIUS bits, as many as hold such a group together.
    """
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = lookup_join(prints.select("fp", "node"), first, ["fp"], "inner", ["node"], moves_on=True).filter("node <> first")
    near = simhash.links(first.select("fp"), RADIUS)
    for side in ("source", "target"):
        near = lookup_join(near, first.select(F.col("fp").alias(side), F.col("first").alias("_" + side)), [side], "inner", ["source", "target"], moves_on=True)
    out = cut(same.select(*_pair("node", "first")).unionByName(near.select(*_pair("_source", "_target"))).distinct())
    release(first)
    return out


def links(prints: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """source and target of links that join all near copies. ``prints`` has row, node, text, size, bits, fp and prefix.

    First the sets meet that SimHash puts together, then every set meets the smallest one
    with which it shares a token; what links join already need not meet again, so a large
    group of near copies stays linear. Then all pairs that share a token and are still apart meet.
    """
    texts = prints.select("row", "node", "text")
    # Copies have the same node, sketch and postings: the first row stands for all of them.
    narrow = prints.select("row", "node")
    firsts = narrow.groupBy("node").agg(F.min("row").alias("_first"))
    copies = cut(lookup_join(narrow, firsts, ["node"], "inner", ["row"], moves_on=True).filter("row <> _first").select("row"))
    alone = lookup_join(prints.select("row", "node", "size", "bits", "fp", "prefix"), copies, ["row"], "left_anti", ["node"])
    sketches = alone.select("node", "size", "bits")
    likely = alike(alone.select("node", "fp"))
    printed = _confirmed(likely, sketches, texts, words)
    release(likely)
    joined = components(printed).select("member", "representative")
    shared = shared_postings(alone, common)
    heads = shared.groupBy("token").agg(F.min(F.struct("size", "node", "pos")).alias("h"))
    heads = cut(heads.select("token", F.col("h.node").alias("h_node"), F.col("h.size").alias("h_size"), F.col("h.pos").alias("h_pos")))
    met = lookup_join(shared, heads, ["token"], "inner", ["node"], moves_on=True)
    star = met.filter(F.col("node") != F.col("h_node")).filter(_fits(F.col("size"), F.col("pos"), F.col("h_size"), F.col("h_pos")))
    star = star.select(*_pair("node", "h_node")).distinct()
    for side in ("source", "target"):
        group = joined.select(F.col("member").alias(side), F.col("representative").alias("_" + side))
        star = lookup_join(star, group, [side], "left", ["source", "target"], moves_on=True)
    star = cut(star.filter(F.coalesce("_source", "source") != F.coalesce("_target", "target")).select("source", "target"))
    first = printed.unionByName(_confirmed(star, sketches, texts, words))
    found = components(first).select(F.col("member").alias("node"), "representative")
    placed = lookup_join(shared, found, ["node"], "left", ["token"], moves_on=True)
    placed = cut(placed.select("token", "node", "size", "pos", F.coalesce("representative", "node").alias("group")))
    release(shared, heads)
    mixed = placed.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi")
    apart = cut(lookup_join(placed, mixed.select("token"), ["token"], "left_semi", ["node"], moves_on=True))
    release(placed)
    x = apart.select("token", *[F.col(c).alias("x_" + c) for c in ("node", "size", "pos", "group")])
    y = apart.select("token", *[F.col(c).alias("y_" + c) for c in ("node", "size", "pos", "group")])
    meet = lookup_join(x, y, ["token"], "inner", ["x_node"], moves_on=True).filter((F.col("x_node") < F.col("y_node")) & (F.col("x_group") != F.col("y_group")))
    meet = meet.filter(_fits(F.col("x_size"), F.col("x_pos"), F.col("y_size"), F.col("y_pos")))
    rest = meet.select(*_pair("x_node", "y_node")).distinct().join(star, ["source", "target"], "left_anti")
    rest = cut(rest)
    release(apart, star)
    second = _confirmed(rest, sketches, texts, words)
    release(rest, copies)
    return first.unionByName(second)


def one_of_each(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with their columns, of each group of near copies the row with the smallest doc_id.

    Documents whose sets of shingles share eight tenths of their union are linked, and
    links make groups; texts without a word are one group. Null ids come last, and of
    rows that repeat an id within a group one stays. Whole texts count; an empty table
    gives no rows.
    """
    ship(documents.sparkSession)
    row, node, size, first, bits, fp = (fresh(documents, c) for c in ("_row", "_node", "_size", "_prefix", "_bits", "_fp"))
    common, counts = common_shingles(documents, words)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(at)]
            firsts = [prefix(s, common, counts) for s in sets]
            offsets = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)))
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            sketches = pa.array([sketch(s) for s in sets], pa.binary())
            fps = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), sizes, tokens, sketches, fps], [*batch.schema.names, node, size, first, bits, fp])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    made = documents.mapInArrow(run, f"{kinds}, `{node}` bigint, `{size}` int, `{first}` array<bigint>, `{bits}` binary, `{fp}` bigint")
    prints = cut(made.withColumn(row, F.monotonically_increasing_id()))
    narrow = prints.select(F.col(node).alias("node"), "doc_id", F.col(row).alias("row"))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    each = narrow.groupBy("node").agg(F.min(best).alias("best"))
    given = prints.select(
        F.col(row).alias("row"), F.col(node).alias("node"), "text", F.col(size).alias("size"),
        F.col(first).alias("prefix"), F.col(bits).alias("bits"), F.col(fp).alias("fp"))
    found = components(links(given, words, common))
    heads = each.join(found, F.col("node") == F.col("member"), "left").select("best", F.coalesce("representative", "node").alias("head"))
    stay = heads.groupBy("head").agg(F.min("best")["row"].alias("_stays"))
    return prints.join(cut(stay.select("_stays")), F.col(row) == F.col("_stays"), "left_semi").select(*documents.columns)
