"""Near duplicates by SimHash, compared exactly in tiles.

Tiles are made by the bit counts of the four 16-bit quarters of a fingerprint. The
distance of two fingerprints is at least the sum of the differences of those counts,
so tiles that differ by more than the radius are never put together; all others are
compared bit for bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import fresh, ship, text_of
from quirelens.operators.graph import components
from quirelens.plans.lineage import cut

BITS = 64
QUARTERS = 4
TILE = 4096  # fingerprints of one tile, on average
STRIPE = 256  # rows of a tile compared at once
CHUNK = 1 << 15  # shingles whose bits are counted at once
SEED = 42


# ---- fingerprints --------------------------------------------------------------


def fingerprint(text: str | None, words: int = 3) -> int:
    """The majority of the bits of the XXH64 of all word shingles, repeats included.

    A-Z count as a-z; words end at ASCII white space. With fewer words than a shingle
    needs the whole sequence is one shingle; without any the fingerprint is zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()][: max(1, len(parts) - words + 1)]
    ends = (ends - 1)[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    pieces = (zip(starts[i : i + CHUNK], ends[i : i + CHUNK]) for i in range(0, len(starts), CHUNK))
    return majority(np.array([digest(joined[a:b], SEED) for a, b in piece], np.uint64) for piece in pieces)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes of all pieces."""
    count, total = np.zeros(BITS, np.int64), 0
    for hashes in pieces:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count, total = count + bits.sum(axis=0, dtype=np.int64), total + len(hashes)
    return int(np.packbits(count * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and fp (the fingerprint as a signed long) of every document."""
    fp, held = fresh(documents, "fp"), fresh(documents, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(held)
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps)], [*keep, fp])

    rows = documents.select(*keep, text_of().alias(held))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, `{fp}` bigint")


# ---- tiled comparison ----------------------------------------------------------


def nearby(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that add up to ``radius`` at most, of two opposite ones the larger."""
    span = range(-radius, radius + 1)
    zero = (0,) * QUARTERS
    return [d for d in itertools.product(span, repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= zero]


def links_within(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``radius`` bits: each member to the least of its group here.

    Every pair is compared; of the links of a group only as many are kept as it takes
    to hold the group together.
    """
    values = left if same else np.concatenate([left, right])
    offset = 0 if same else len(left)
    label = np.arange(len(values))
    pairs: list[np.ndarray] = []
    for i in range(0, len(left), STRIPE):
        a, b = np.nonzero(np.bitwise_count(left[i : i + STRIPE, None] ^ right[None, :]) <= radius)
        a, b = a + i, b + offset
        keep = a < b
        if keep.any():
            label = _joined(label, a[keep], b[keep])
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: the least place of each group."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, ahead := label[label]):
            label = ahead


def links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """source and target of links that join all ``fp`` within ``radius`` bits of each other."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint"))).cast("int")
    keys = [f"q{i}" for i in range(QUARTERS)]
    counted = nodes.select("fp", *[quarter(i).alias(k) for i, k in enumerate(keys)])
    # At most 17**4 tiles, so their sizes are safe to broadcast.
    sized = counted.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"))
    tiles = (
        counted.join(F.broadcast(sized), keys)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy(*keys, "part", "parts").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = cut(tiles)
    steps = F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(d, keys)]) for d in nearby(radius)])
    there = tiles.select(*keys, "part", "fps", F.explode(steps).alias("step"))
    there = there.select(
        *[(F.col(k) + F.col(f"step.{k}")).alias(k) for k in keys],
        F.expr(" and ".join(f"step.{k} = 0" for k in keys)).alias("own"), F.col("part").alias("from_part"), F.col("fps").alias("left"),
    )
    here = tiles.select(*keys, "part", F.col("fps").alias("right"))
    met = there.join(here, keys).filter("not own or from_part <= part")
    met = met.select("left", "right", F.expr("own and from_part = part").alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(*(batch.column(c) for c in ("left", "right", "same"))):
                left = a.values.to_numpy().view(np.uint64)
                right = b.values.to_numpy().view(np.uint64)
                source, target = links_within(left, right, radius, same.as_py())
                if len(source):
                    yield pa.RecordBatch.from_arrays([pa.array(source.view(np.int64)), pa.array(target.view(np.int64))], ["source", "target"])

    return met.mapInArrow(compare, "source bigint, target bigint")


def groups(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """fp and head of its group, for every distinct ``fp``."""
    nodes = cut(fps.select("fp").distinct())
    found = components(links(nodes, radius, tile))
    return cut(nodes.join(found, nodes["fp"] == F.col("member"), "left").select("fp", F.coalesce("representative", "fp").alias("head")))


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, and
    component_id is the smallest doc_id that links lead to. Documents of one
    fingerprint are one node, so copies of any number cost nothing below; of a group
    of near copies a tile gives only as many links as hold it together.

    Null and empty texts have fingerprint zero and are linked like others. A null
    doc_id takes no part in the smallest; a component of such rows only has a null id.
    Repeated rows each give a row. Whole texts count; an empty table gives no rows;
    other columns are left alone.
    """
    ship(documents.sparkSession)
    prints = cut(fingerprints(documents.select("doc_id", "text"), words))
    heads = groups(prints, radius, tile)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(heads, "fp")
    least = least.groupBy("head").agg(F.min("least").alias("component_id"))
    placed = cut(heads.join(least, "head").select(F.col("fp").alias("_fp"), "component_id"))
    out = prints.join(placed, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
