"""Exact top-k search by inner product over an impact-ordered index.

Vectors are dealt to shards by the side of random planes on which they lie, so that near ones meet, and
a few balls hold each shard's vectors. In a shard every component is a posting whose impact is quantised;
postings of one impact are a segment. A block of queries adds up segments in descending order of impact,
all dimensions at once as matrix products; what is still missing for a vector is bounded by the
norm of its components that are not yet added (Cauchy-Schwarz). Vectors that the bound leaves possible are
scored exactly. A query first searches the shard that promises most; a shard that cannot reach the
k-th score found there is not searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm.common import ship
from quirelens.plans.lineage import cut, release
from quirelens.plans.skew import lookup_join

SHARD = 12_288  # vectors of one shard at most
QUERIES = 512  # queries of one block, on average
LEVELS = 64  # quantised impacts
STEPS = 3  # a query looks whether it may stop after each of so many runs of segments
ENOUGH = 16  # adding up may stop when one vector of so many is still possible
FEW = 64  # or when so many are
BITS = 24  # planes
BALLS = 8  # balls that hold a shard's vectors
GROUP = 4_096  # shard summaries that one task holds


def integers(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and floor(scale * x) of every component, in double arithmetic, a row per different vector of an id.

    Left out: null ids and vectors that are null or hold null or non-finite components.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return rows.select("vec_id", whole.alias("v")).distinct()


# ---- the index -----------------------------------------------------------------

INDEX = "shard bigint, width int, itemsize int, ids binary, matrix binary, centres array<array<double>>, radii array<double>"


def _rows(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's code: a bit for the side of each plane on which it lies. Planes are the same in every task."""
    planes = np.zeros((0, BITS))
    for batch in batches:
        rows = [np.asarray(v, np.float64) for v in batch.column("v").to_pylist()]
        width = max(map(len, rows), default=0)
        if width > len(planes):
            # Row i depends on i alone, so that a longer vector elsewhere changes no code.
            planes = np.stack([np.random.default_rng(i).normal(size=BITS) for i in range(width)])
        code = np.zeros(len(rows), np.int64)
        for i, row in enumerate(rows):
            code[i] = int(((row @ planes[: len(row)]) > 0) @ (1 << np.arange(BITS)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=["vec_id", "v", "code"])


def balls(matrix: np.ndarray) -> tuple[list[list[float]], list[float]]:
    """Centres and radii of balls that hold all rows. Each next ball starts from the row that is farthest from the others' starts."""
    if not len(matrix):
        return [], []
    whole = matrix.astype(np.float64)
    away, nearest = ((whole - whole[0]) ** 2).sum(axis=1), np.zeros(len(whole), int)
    for i in range(1, BALLS):
        far = int(away.argmax())
        if away[far] == 0:
            break
        now = ((whole - whole[far]) ** 2).sum(axis=1)
        nearest[now < away] = i
        away = np.minimum(away, now)
    parts = [whole[nearest == i] for i in np.unique(nearest)]
    centres = [part.mean(axis=0) for part in parts]
    return [c.tolist() for c in centres], [float(np.sqrt(((p - c) ** 2).sum(axis=1).max())) for p, c in zip(parts, centres)]


def build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard: ids, vectors as small integers, and the balls that hold the vectors."""
    width = int(frame["v"].map(len).max()) if len(frame) else 0
    matrix = _rows(frame["v"], width)
    small = next(t for t in (np.int16, np.int32, np.int64) if not matrix.size or np.abs(matrix).max() <= np.iinfo(t).max)
    ids = frame["vec_id"].to_numpy(np.int64)
    row = (int(frame["shard"].iloc[0]), width, np.dtype(small).itemsize, ids.tobytes(), matrix.astype(small).tobytes(), *balls(matrix))
    return pd.DataFrame([row], columns=["shard", "width", "itemsize", "ids", "matrix", "centres", "radii"])


def build_index(vectors: DataFrame, shards: int, shard: int) -> DataFrame:
    """The index, written down, a row per shard. Ranges of codes make shards; a longer range makes several, so
    none holds more than ``shard`` vectors however many share a code."""
    coded = vectors.mapInArrow(_sides, "vec_id bigint, v array<bigint>, code bigint")
    placed = coded.repartitionByRange(shards, "code", "vec_id").withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed)  # the number is read from what was written, not made again
    first = F.shiftright("at", 33)
    number = F.shiftleft(first, 33) + F.floor((F.col("at") - F.shiftleft(first, 33)) / shard)
    out = cut(placed.withColumn("shard", number).groupBy("shard").applyInPandas(build_shard, INDEX))
    release(placed)
    return out


# ---- search --------------------------------------------------------------------


class Shard:
    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.width = int(row.width)
        self.matrix = np.frombuffer(row.matrix, f"i{int(row.itemsize)}").reshape(len(self.ids), self.width)
        self.repeats = len(np.unique(self.ids)) < len(self.ids)
        whole = self.matrix.astype(np.float64)
        size = np.abs(whole)
        step = max(1.0, size.max(initial=0.0) / LEVELS)
        impact = np.minimum((size / step).astype(np.int64), LEVELS - 1)
        # Runs of segments, highest impacts first, that hold about equal shares of the vectors' energy.
        energy = np.bincount(impact.ravel(), weights=(whole**2).ravel(), minlength=LEVELS)[::-1].cumsum()
        ends = np.searchsorted(energy, energy[-1] * np.arange(1, STEPS) / STEPS) + 1
        bounds = LEVELS - np.unique(np.r_[0, ends, LEVELS])
        self.runs, self.left = [], []
        for high, low in zip(bounds, bounds[1:]):
            self.runs.append(np.where((impact < high) & (impact >= low), whole, 0.0).T)
            self.left.append(np.sqrt(np.where(impact < low, whole**2, 0.0).sum(axis=1)))
        self.norm = np.sqrt((whole**2).sum(axis=1))

    def _kth(self, low: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k different ids reach, or minus infinity."""
        if not self.repeats:
            n = low.shape[1]
            return np.partition(low, n - k, axis=1)[:, n - k] if n >= k else np.full(len(low), -np.inf)
        out = np.full(len(low), -np.inf)
        for i, row in enumerate(low):
            order = np.argsort(-row, kind="stable")
            first = np.sort(np.unique(self.ids[order], return_index=True)[1])
            if len(first) >= k:
                out[i] = row[order[first[k - 1]]]
        return out

    def possible(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the places of all vectors that may be among its k best (``own`` ids aside) and reach
        ``floor``; and after how many runs that was proven."""
        b, n = len(q), len(self.ids)
        members: list[np.ndarray] = [np.arange(n)] * b
        proven = np.full(b, len(self.runs))
        norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        # Sums of doubles are off by less than this.
        slack = 1e-9 * (1.0 + norms * self.norm.max(initial=0.0))
        active = np.arange(b)
        qf = q.astype(np.float64)
        sums = np.zeros((b, n))
        mine = self.ids[None, :] == own[:, None]
        for done, (run, left) in enumerate(zip(self.runs, self.left), 1):
            sums += qf[active] @ run
            gap = norms[active, None] * left + slack[active, None]
            low = np.where(mine, -np.inf, sums - gap)
            least = np.maximum(self._kth(low, k), floor[active])
            may = (sums + gap >= least[:, None]) & ~mine
            stop = (may.sum(axis=1) <= max(FEW, n // ENOUGH)) | (done == len(self.runs))
            for i in np.flatnonzero(stop):
                members[active[i]] = np.flatnonzero(may[i])
                proven[active[i]] = done
            active, sums, mine = active[~stop], sums[~stop], mine[~stop]
            if not len(active):
                break
        return members, proven

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        """(query's place, ids, scores) of the k best ids of each query, fewer if there are no more."""
        q = np.zeros((len(queries), self.width), np.int64)
        shared = min(self.width, queries.shape[1])
        q[:, :shared] = queries[:, :shared]
        step = max(1, (1 << 20) // max(1, len(self.ids)))
        for i in range(0, len(q), step):
            members, _ = self.possible(own[i : i + step], q[i : i + step], k, floor[i : i + step])
            for j, places in enumerate(members, i):
                scores = self.matrix[places].astype(np.int64) @ q[j]
                ids = self.ids[places]
                order = np.lexsort((ids, -scores))
                if self.repeats:
                    order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
                order = order[:k]
                yield j, ids[order], scores[order]


PAIRS = "q bigint, query_id bigint, shard bigint, bound double"
FOUND = "q bigint, query_id bigint, vec_id bigint, score bigint"


def promise(asked: pd.DataFrame, shards: pd.DataFrame, home: bool) -> pd.DataFrame:
    """Shards that may hold a score of a query's floor or more, with the most that each can hold; with ``home``
    only the one that promises most."""
    width = max([len(v) for v in asked["v"]] + [len(c) for cs in shards["centres"] for c in cs], default=0)
    q = _rows(asked["v"], width).astype(np.float64)
    norms = np.sqrt((q**2).sum(axis=1))
    reach = np.full((len(q), len(shards)), -np.inf)
    for i, (centres, radii) in enumerate(zip(shards["centres"], shards["radii"])):
        for c, radius in zip(centres, radii):
            np.maximum(reach[:, i], q[:, : len(c)] @ np.asarray(c) + norms * radius, out=reach[:, i])
    reach += 1e-9 * (1.0 + np.abs(reach))
    names = shards["shard"].to_numpy()
    if home:
        row, column = np.arange(len(q)), reach.argmax(axis=1) if len(names) else np.zeros(0, int)
    else:
        row, column = np.nonzero((reach >= asked["floor"].to_numpy()[:, None]) & (names[None, :] != asked["home"].to_numpy()[:, None]))
    return pd.DataFrame({
        "q": asked["q"].to_numpy()[row], "query_id": asked["query_id"].to_numpy()[row],
        "shard": names[column], "bound": reach[row, column]})


def _promised(asked: DataFrame, summaries: DataFrame, blocks: int, groups: int, home: bool) -> DataFrame:
    """Pairs of query and shard. Blocks of queries meet groups of summaries, both of bounded size."""
    dealt = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    known = summaries.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    known = known.withColumn("for", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return promise(a, s, home)[["q", "query_id", "shard", "bound"]] if len(a) and len(s) else pd.DataFrame(
            columns=["q", "query_id", "shard", "bound"]).astype({"q": "int64", "query_id": "int64", "shard": "int64", "bound": "float64"})

    return dealt.groupBy("block", "g").cogroup(known.groupBy("for", "g")).applyInPandas(meet, PAIRS)


def _searched(pairs: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k best ids of each pair of query and shard. A shard goes once to each block that has a query for it."""
    held = lookup_join(pairs.select("q", "shard"), asked, ["q"], "inner", ["shard"], moves_on=True)
    wanted = held.select(F.col("shard").alias("at"), F.col("block").alias("for")).distinct()
    copies = wanted.join(index, F.col("at") == F.col("shard")).drop("shard")

    def search(a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(s):
            shard = Shard(s.iloc[0])
            queries = _rows(a["v"], max(map(len, a["v"]), default=0))
            names, numbers = a["query_id"].to_numpy(np.int64), a["q"].to_numpy(np.int64)
            for j, ids, scores in shard.best(names, queries, k, a["floor"].to_numpy(np.float64)):
                out.append(pd.DataFrame({"q": numbers[j], "query_id": names[j], "vec_id": ids, "score": scores}))
        none = pd.DataFrame(columns=["q", "query_id", "vec_id", "score"])
        return (pd.concat(out) if out else none).astype("int64")

    return held.groupBy("shard", "block").cogroup(copies.groupBy("at", "for")).applyInPandas(search, FOUND)


def search(asked: DataFrame, index: DataFrame, shards: int, k: int, block: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Scores (q, query_id, vec_id, score), among them the k best ids of every query, and the pairs of query and shard
    that were searched after the first shard. ``asked`` has q (one per row), query_id and v."""
    blocks = max(1, -(-asked.count() // block))
    groups = max(1, -(-shards // GROUP))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(blocks)).cast("int"))
    nothing, nowhere = F.lit(float("-inf")).alias("floor"), F.lit(-1).cast("bigint").alias("home")
    summaries = index.select("shard", "centres", "radii")
    fresh = asked.select("*", nothing, nowhere)
    most = _promised(fresh, summaries, blocks, groups, True).groupBy("q").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    most = cut(most)
    first = cut(_searched(most, fresh, index, k))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("q", F.col("score").cast("double").alias("floor"))
    known = asked.join(most.withColumnRenamed("shard", "home"), "q").join(kth, "q", "left").na.fill({"floor": float("-inf")})
    known = cut(known.select(*asked.columns, "floor", "home"))
    pairs = cut(_promised(known, summaries, blocks, groups, False))
    return first.unionByName(_searched(pairs, known, index, k)), pairs


def top_k(
    embeddings: DataFrame, queries: DataFrame | None = None, k: int = 5, every: int = 50,
    shard: int = SHARD, block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best vectors for each query but itself.

    Queries are the rows whose vec_id is divisible by ``every``, or ``queries``
    (vec_id, embedding). The score is the inner product of the components floored at
    256 steps; missing trailing components count as zero; ties go to the smaller
    vec_id. Every row is a candidate; an id that several rows hold is ranked once, by its best row,
    and as a query it gets the best of its rows.

    Null and non-finite vectors take no part; fewer than k others give fewer rows, none give none;
    an empty table gives no rows. Components are taken to be below 2**25, so that sums fit a
    long. Other columns are left alone.
    """
    ship(embeddings.sparkSession)
    vectors = cut(integers(embeddings))
    asked = vectors.filter(F.col("vec_id") % every == 0) if queries is None else integers(queries)
    asked = cut(asked.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "v"))
    index = build_index(vectors, max(1, -(-vectors.count() // shard)), shard)
    found, _ = search(asked, index, index.count(), k, block)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
