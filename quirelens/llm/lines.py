"""Line dedup: later documents lose the blocks of lines that they share with earlier ones.

Rare lines, those of five words or more, tell which documents overlap. A line's first
document stands for all that hold it, so a line in a third of all documents links each
of them to one, and never each to each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import fresh, ship, text_of
from quirelens.plans.lineage import cut

LEAST_WORDS = 5

LINE = "doc_id bigint, digest bigint, pos int, h1 bigint, h2 bigint, gap bigint, reach int"
BLOCKS = "array<struct<first:int, last:int, partner:bigint, moved:boolean>>"


def rare_lines(documents: DataFrame, least_words: int) -> DataFrame:
    """A row per rare line: its document (id and digest of the text), place and 128-bit hash.

    Lines end at a line feed, white space at their ends does not count. ``gap`` is the
    hash of the short lines up to the next rare one, ``reach`` how far on that is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, owner, hashes, gaps, reaches = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                short: list[bytes] = []
                first = len(places)
                for pos, line in enumerate(text.as_py().encode("utf-8", "surrogatepass").split(b"\n")):
                    line = line.strip()
                    if len(line.split(None, least_words - 1)) < least_words:
                        short.append(line)
                        continue
                    if len(places) > first:
                        gaps.append(_gap(short))
                        reaches.append(len(short) + 1)
                    short = []
                    places.append(pos)
                    owner.append(i)
                    hashes.append(xxhash.xxh3_128_digest(line))
                if len(places) > first:
                    gaps.append(_gap(short))
                    reaches.append(len(short) + 1)
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            take = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take), batch.column("digest").take(take), pa.array(places, pa.int32()),
                    pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(gaps, pa.int64()), pa.array(reaches, pa.int32()),
                ],
                ["doc_id", "digest", "pos", "h1", "h2", "gap", "reach"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("digest"), text_of().alias("text"))
    return rows.mapInArrow(run, LINE)


def _gap(lines: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\n".join(lines)) - (1 << 63) if lines else 0


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(piles, v)
        before[i] = tops[at - 1] if at else -1
        if at == len(piles):
            piles.append(v)
            tops.append(i)
        else:
            piles[at], tops[at] = v, i
    out = []
    i = tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(shared: list[dict]) -> list[tuple[int, int, int | None, bool]]:
    """Blocks (first line, last line, partner, moved) of one later document.

    ``shared`` holds its shared lines: pos, gap and reach here, and partner, place and
    gap in the first document that has the line, with n, the number of such lines in all. Partners
    come rarest line first. With each, lines that come once on both sides and rise
    together are the spine of a patience diff, lines between two of the spine that fit
    between their places are aligned with them, and what is left was moved and makes
    blocks of its own. Lines that follow each other on both sides make one block, with
    the short lines between them if those are equal.
    """
    partners: dict[tuple, list[dict]] = defaultdict(list)
    for line in sorted(shared, key=lambda s: s["pos"]):
        partners[(line["partner"], line["partner_digest"])].append(line)
    out = []
    for (partner, _), lines in sorted(partners.items(), key=lambda p: (min(s["n"] for s in p[1]), p[0][0] is None, p[0])):
        times = Counter(s["at"] for s in lines)
        once = [i for i, s in enumerate(lines) if times[s["at"]] == 1]
        spine = {once[i] for i in longest_rise([lines[i]["at"] for i in once])}
        low, aligned = -1, set()
        ceilings = [0] * len(lines)
        high = float("inf")
        for i in reversed(range(len(lines))):
            high = lines[i]["at"] if i in spine else high
            ceilings[i] = high
        for i, s in enumerate(lines):
            if i in spine or low < s["at"] < ceilings[i]:
                aligned.add(i)
                low = s["at"]
        start = 0
        for i in range(1, len(lines) + 1):
            if i < len(lines):
                a, b = lines[i - 1], lines[i]
                step = b["pos"] - a["pos"]
                if step == b["at"] - a["at"] == a["reach"] and a["gap"] == a["partner_gap"] and (i - 1 in aligned) == (i in aligned):
                    continue
            out.append((lines[start]["pos"], lines[i - 1]["pos"], partner, start not in aligned))
            start = i
    return sorted(out, key=lambda b: b[:2])


def common_blocks(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, digest and blocks of every document that repeats lines of an earlier one.

    Earlier is the smaller doc_id, a null one comes last, and of equal ids with
    different texts the smaller text digest.
    """
    ship(documents.sparkSession)
    lines = cut(rare_lines(documents, least_words))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "pos", "gap")
    owner = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    shared = (
        lines.groupBy("h1", "h2")
        .agg(F.min(place).alias("f"), F.max(owner).alias("l"), F.count(F.lit(1)).alias("n"))
        .filter("f.none <> l.none or not (f.doc_id <=> l.doc_id) or f.digest <> l.digest")
    )
    shared = cut(shared.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "f", "n"))
    met = lines.join(shared, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(
        "not (doc_id <=> f.doc_id) or digest <> f.digest"
    )
    line = F.struct(
        "pos", "gap", "reach", F.col("f.pos").alias("at"), F.col("f.gap").alias("partner_gap"), F.col("f.doc_id").alias("partner"),
        F.col("f.digest").alias("partner_digest"), "n",
    )
    # A row of the group per line of one document; a repeated row repeats its lines.
    grouped = met.select("doc_id", "digest", line.alias("line")).groupBy("doc_id", "digest").agg(F.collect_set("line").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("partner", pa.int64()), ("moved", pa.bool_())]))
        for batch in batches:
            found = []
            for s in batch.column("shared"):
                found.append([dict(zip(("first", "last", "partner", "moved"), b)) for b in align(s.as_py())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found, kind)], ["doc_id", "digest", "blocks"])

    return grouped.mapInArrow(run, f"doc_id bigint, digest bigint, blocks {BLOCKS}")


def line_dedup(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with their columns, text without the common blocks, and ``blocks``.

    ``blocks`` lists first and last line (from 0), the partner's doc_id and whether the
    block had moved; it is empty for documents that keep all. A document left with white
    space only has an empty text. Repeated rows are one document, so none of them loses
    lines to the other; null and empty texts come back as they are; lines of fewer than
    five words go only inside a block; texts of any length are whole; an empty table
    gives no rows; other columns are carried along.
    """
    own, other, digest, held = (fresh(documents, c) for c in ("_hash", "_id", "_digest", "_blocks"))
    found = common_blocks(documents, least_words)
    found = found.select(F.col("doc_id").alias(other), F.col("digest").alias(digest), F.col("blocks").alias(held))
    rows = documents.withColumn(own, F.xxhash64(text_of()))
    rows = rows.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(other)) & (F.col(own) == F.col(digest)), "left")
    lines = F.split("text", "\n", -1)
    gone = F.flatten(F.transform(held, lambda b: F.sequence(b["first"], b["last"])))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.trim(F.translate(text, "\n\t\r", "   ")) == "", F.lit("")).otherwise(text)
    kept = F.when(F.col(held).isNull(), F.col("text")).otherwise(text)
    columns = [kept.alias("text") if c == "text" else F.col(c) for c in documents.columns if c != "blocks"]
    return rows.select(*columns, F.coalesce(held, F.array().cast(BLOCKS)).alias("blocks"))
