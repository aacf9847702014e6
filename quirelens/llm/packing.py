"""Packing documents into sequences whose mixture of sources is controlled.

Deficit round-robin: in every round a source's deficit grows by its quantum and it
sends documents while they fit the deficit; what is left is carried on. A source that
always has documents thus sends a document in the first round whose quanta add up to
the end of the document in its queue, so rounds follow from prefix sums, and deficits
pass between windows, partitions and tasks without a task that walks over all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import running, ship, text_of
from quirelens.llm.tokens import DTYPE, coder
from quirelens.plans.lineage import cut

END = 1  # id that closes every document
SEQUENCE = 2048
WINDOW = 64 * SEQUENCE
ROWS = 64  # documents whose ids are held at once


def tokenized(documents: DataFrame, path: str, end: int = END) -> DataFrame:
    """row, doc_id, source, n and ids of every document, written down once.

    Ids are 16-bit when all of the tokenizer's are (``wide`` says which).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        last = np.array([end], DTYPE)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.concatenate([code.ids(t.as_py()), last]) for t in part.column("text")]
                small = [bool(len(x) == 0 or x.max() < 1 << 16) for x in ids]
                packed = [x.astype("<u2").tobytes() if s else x.tobytes() for x, s in zip(ids, small)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([not s for s in small]), pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "source", "n", "wide", "ids"],
                )

    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), text_of().alias("text")
    )
    out = rows.mapInArrow(run, "doc_id bigint, source string, n bigint, wide boolean, ids binary")
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def order(rows: DataFrame, weights: Mapping[str, float] | None, window: int) -> DataFrame:
    """row, window and at (the place of its first token in the stream of all documents).

    ``rows`` holds row, doc_id, source and n. A source's quantum is its share of the
    weights times ``window``; without weights its share of all tokens, so that all
    sources last to the end and every window shows the corpus' own mixture.
    """
    totals = rows.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is not None:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None), F.lit(0.0))
        totals = totals.withColumn("weight", weight)
    else:
        totals = totals.withColumn("weight", F.col("tokens").cast("double"))
    totals = cut(totals)
    whole = totals.agg(F.sum("weight").alias("w")).scalar()
    # A source without weight has no place in the mixture: it comes after all others.
    share = totals.select(F.col("source").alias("_source"), (F.coalesce(F.try_divide(F.col("weight"), whole), F.lit(0.0)) * F.lit(float(window))).alias("quantum"))
    queued = running(rows.withColumn("key", F.xxhash64("doc_id")), ["source"], ["key", "doc_id", "row"], "n")
    rounds = queued.join(share, F.col("source").eqNullSafe(F.col("_source")))
    late = F.lit((1 << 62) // window)
    turn = F.when(F.col("quantum") > 0, F.ceil(F.try_divide("total", "quantum"))).otherwise(late).cast("bigint")
    turned = cut(rounds.select("row", "source", "rank", "n", turn.alias("window")))
    placed = running(turned.withColumn("all", F.lit(0)), ["all"], ["window", "source", "rank"], "n")
    return placed.select("row", "window", (F.col("total") - F.col("n")).alias("at"))


def bounds(total: int, sequence: int) -> list[int]:
    """Where the sequences behind the last full one begin and end: powers of two, larger first."""
    out, at = [total - total % sequence], total - total % sequence
    for bit in reversed(range((total % sequence).bit_length())):
        if (total % sequence) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def pack(
    documents: DataFrame, path: str, weights: Mapping[str, float] | None = None,
    sequence: int = SEQUENCE, window: int = WINDOW, end: int = END,
) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and window.

    The documents, in the order of their windows, make one stream of ids that is cut
    into sequences of ``sequence`` ids. What is left at the end is cut into powers of
    two, which need no padding, so nothing is padded at all. Each window of about
    ``window`` ids holds every source in the proportion of its weight, to within one
    document; the deficit is carried on. When a source runs out the others go on.

    A null text is empty and packs as its end id alone. Null sources are one source,
    equal and null doc_ids each keep their rows, a document of any length is cut over
    as many sequences as it takes, an empty table gives no rows, and other columns are
    left alone.
    """
    if sequence < 1 or window < 1:
        raise ValueError("sequence and window must be positive")
    ship(documents.sparkSession)
    tokens = tokenized(documents, path, end)
    narrow = tokens.select("row", "doc_id", "source", "n")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    places = cut(order(narrow, weights, window).withColumnRenamed("row", "_row"))
    tail = bounds(total, sequence)
    full = total // sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "n", "wide", "ids", "window", "at"]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                out = []
                columns = [batch.column(c).slice(first, ROWS) for c in names]
                for doc, source, n, wide, ids, turn, at in zip(*columns):
                    n, at = n.as_py(), at.as_py()
                    body = np.frombuffer(ids.as_py(), DTYPE if wide.as_py() else "<u2").astype(DTYPE)
                    cuts = [*range((at // sequence + 1) * sequence, min(at + n, tail[0]), sequence), *tail]
                    cuts = [at, *[c for c in cuts if at < c < at + n], at + n]
                    for a, b in zip(cuts, cuts[1:]):
                        if a < tail[0]:
                            number, begin = divmod(a, sequence)
                        else:
                            part = int(np.searchsorted(tail, a, "right")) - 1
                            number, begin = full + part, a - tail[part]
                        crc = zlib.crc32(body[a - at : b - at].tobytes())
                        out.append((doc.as_py(), source.as_py(), a - at, b - a, crc, n, number, begin, turn.as_py()))
                fields = list(zip(*out)) if out else [[] for _ in PIECES]
                kinds = [pa.string() if k == "string" else pa.int64() for _, k in PIECES]
                yield pa.RecordBatch.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds)], [n for n, _ in PIECES])

    joined = tokens.join(places, F.col("row") == F.col("_row"))
    return joined.select("doc_id", "source", "n", "wide", "ids", "window", "at").mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in PIECES))


PIECES = (
    ("doc_id", "bigint"), ("source", "string"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"),
    ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"), ("window", "bigint"),
)
