"""Case-sensitive substring search over a rebuildable trigram index.

The index only narrows the documents to compare. A scan of all texts gives the
same answer and stands in whenever the index cannot be trusted: it is missing, its
fence is not the current revision, or it does not hold as many postings as it was
made with. Stored generations (``sources.generations``) also carry a digest per bucket of
grams, and a query checks the buckets it reads. Nothing that answers a query writes.

Grams are the one step of the catalog that is numpy over Arrow instead of built-in functions, of which
none cuts a text into runs at less than a match and a string object per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quirelens.plans.skew import lookup_join
from quirelens.plans.windows import next_in_group

GRAM = 3
# Characters whose grams are sorted at a time; a longer text is a slice of its own.
SLICE = 1 << 21
# Postings are dealt to so many buckets, each with a digest; a query reads a bucket for each of its grams.
BUCKETS = 1024
LOW = (1 << 32) - 1  # the lower half of a hash

# The states of an index generation, in order.
STATES = ("building", "ready", "retired", "removed")


def search_projection(objects: DataFrame, references: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row per (kind, source_key).

    ``objects`` holds kind, git_object_id and text, one row per object;
    ``references`` holds kind and sha256 (hex) of the texts other kinds refer to,
    as often as they do; ``bodies`` holds each sha256 once with its text.
    References fold before any text moves.
    """
    code = objects.select("kind", F.concat(F.lit("git:"), F.col("git_object_id").cast("string")).alias("source_key"), "text")
    prose = bodies.select("sha256", "text").join(references.select("kind", "sha256").distinct(), "sha256")
    return code.unionByName(prose.select("kind", F.col("sha256").alias("source_key"), "text")).filter("text is not null")


def _listing(slice_chars: int):
    """The task of ``gram_lists``. All it calls is inside, so that executors need numpy and Arrow but not this package."""

    def lists(texts, keys):
        codes = np.concatenate(texts)
        used = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
        used[codes] = True
        alphabet, symbol = np.flatnonzero(used).astype("<u4"), np.cumsum(used) - 1
        width, row_bits = max(len(alphabet) - 1, 0).bit_length(), (len(texts) - 1).bit_length()
        if 3 * width + row_bits > 63:  # never for a single text: 21 bits hold any character
            half = len(texts) // 2
            yield from lists(texts[:half], keys[:half])
            yield from lists(texts[half:], keys[half:])
            return
        s = symbol[codes]
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        inside = rows[:-2] == rows[2:]  # a run ends in the text it begins in
        found = (((((s[:-2] << width) | s[1:-1]) << width) | s[2:]) << row_bits | rows[:-2])[inside]
        if not len(found):
            return
        found.sort()
        found = found[np.append(True, found[1:] != found[:-1])]
        gram = found >> row_bits
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        gram, mask = gram[starts], (1 << width) - 1
        runs = alphabet[np.stack([gram >> 2 * width, gram >> width & mask, gram & mask], axis=1)].tobytes().decode("utf-32-le")
        names = pa.array([runs[i : i + 3] for i in range(0, len(runs), 3)], pa.string())
        ends = pa.array(np.append(starts, len(found)), pa.int32())
        held = pa.ListArray.from_arrays(ends, keys.take(pa.array(found & ((1 << row_bits) - 1))))
        yield pa.RecordBatch.from_arrays([names, held], ["gram", "keys"])

    def run(batches):
        for batch in batches:
            keys, first, chars, texts = batch.column(0), 0, 0, []
            for i, t in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                codes = np.frombuffer((t or b"").decode("utf-8", "replace").encode("utf-32-le"), "<u4")
                if texts and chars + len(codes) > slice_chars:
                    yield from lists(texts, keys[first:i])
                    first, chars, texts = i, 0, []
                chars += len(codes)
                texts.append(codes)
            if texts:
                yield from lists(texts, keys[first:])

    return run


def gram_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """gram and keys: for slices of the texts each run of three characters with the rows that hold it, once a row. A
    gram comes once for each slice that holds it. Null texts have none."""
    schema = StructType([StructField("gram", StringType()), StructField("keys", ArrayType(docs.schema[key].dataType))])
    return docs.select(key, F.col(text).cast("string")).mapInArrow(_listing(SLICE), schema)


def trigram_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key): each distinct run of three characters of each text."""
    return gram_lists(docs, key, text).select("gram", F.explode("keys").alias(key))


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Store postings sorted by gram, so that a query reads few row groups. A common
    gram spreads over several files by its keys."""
    postings = trigram_index(docs, key, text).repartitionByRange("gram", key)
    postings.sortWithinPartitions("gram", key).write.parquet(path)


def bucket_of(gram) -> Column:
    """The bucket of a gram, one of BUCKETS."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def bucket_place(gram) -> Column:
    """A number that sorts postings by bucket, in a bucket by gram: the hash with its bucket in front. A
    single number sorts several times as fast as the columns do."""
    h = F.xxhash64(gram)
    return F.shiftleft(h, 54).bitwiseXOR(F.shiftrightunsigned(h, 10))


def bucket_digests(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """bucket and digest of the postings (gram, key) of each bucket, whatever their order.

    A digest is the number of postings and two sums of 64-bit hashes of each: a posting changed, lost, repeated
    or moved to another gram or document changes it. Sums combine before the shuffle, so a bucket
    is never gathered.
    """
    hashes = {"a": F.xxhash64("gram", key), "b": F.xxhash64(F.lit("digest"), key, "gram")}
    # The halves of a hash add up as longs, without a decimal per posting.
    halves = {name + "_high": F.shiftright(h, 32) for name, h in hashes.items()} | {name + "_low": h.bitwiseAND(F.lit(LOW)) for name, h in hashes.items()}
    counted = postings.groupBy(bucket_of("gram").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(name) for name, h in halves.items()])
    whole = [(F.col(f"{x}_high").cast("decimal(20,0)") * F.lit(LOW + 1).cast("decimal(11,0)") + F.col(f"{x}_low")).cast("decimal(38,0)").cast("string") for x in hashes]
    return counted.select("bucket", F.concat_ws(":", F.col("n").cast("string"), *whole).alias("digest"))


def add_digests(some: dict, others: dict) -> dict:
    """The digests of all postings, from those of two parts of them."""
    parts = [{b: [int(x) for x in d.split(":")] for b, d in part.items()} for part in (some, others)]
    add = lambda x, y: ":".join(str(p + q) for p, q in zip(x, y))
    return {b: add(parts[0].get(b, (0, 0, 0)), parts[1].get(b, (0, 0, 0))) for b in parts[0] | parts[1]}


def query_grams(query: str) -> list[str]:
    return sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})


def files_fence(docs: DataFrame) -> str:
    """A fence that changes with any file of a file-based frame: its files' names, sizes and times, not their rows."""
    file = F.col("_metadata")
    files = docs.select(file["file_path"].alias("p"), file["file_size"].alias("n"), file["file_modification_time"].alias("t")).distinct()
    row = files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.xxhash64("p", "n", "t").cast("decimal(20,0)")).alias("h")).first()
    return f"{row['files']}:{row['h']}"


def lives(attempts: DataFrame, key: str = "generation", at: str = "at") -> DataFrame:
    """Each generation's life, replayed from attempts to change its state.

    ``attempts`` holds key, at (unique per key) and the wanted state. An attempt succeeds if the state before the
    wanted one is current: a generation enters each state once, by the first attempt after it entered the one
    before. Gives when each state was entered (``building_at`` and so on), the state, and how many attempts were
    refused. Generations that nobody began have none. Each step is a least value that combines before its shuffle.
    """
    tries = attempts.select(key, at, "state")
    out = tries.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.min(F.when(F.col("state") == STATES[0], F.col(at))).alias(f"{STATES[0]}_at"))
    for before, state in zip(STATES, STATES[1:]):
        since = out.filter(F.col(f"{before}_at").isNotNull()).select(key, F.col(f"{before}_at").alias("_since"))
        later = lookup_join(tries.filter(F.col("state") == state), since, [key], "inner", [at]).filter(F.col(at) > F.col("_since"))
        out = out.join(later.groupBy(key).agg(F.min(at).alias(f"{state}_at")), key, "left")
    times = [f"{s}_at" for s in STATES]
    current = F.coalesce(*[F.when(F.col(f"{s}_at").isNotNull(), F.lit(s)) for s in reversed(STATES)])
    taken = sum((F.col(t).isNotNull().cast("bigint") for t in times), F.lit(0).cast("bigint"))
    return out.select(key, *times, current.alias("state"), (F.col("n_attempts") - taken).alias("n_refused"))


def removable(generations: DataFrame, leases: DataFrame, now, key: str = "generation") -> DataFrame:
    """Retired generations that nobody holds at ``now``.

    ``generations`` holds key and state; ``leases`` holds key, acquired_at, expires_at and released_at (null: not
    released). A lease holds from when it was acquired until it was released or expires.
    """
    now = F.lit(now) if not isinstance(now, Column) else now
    held = leases.filter((F.col("acquired_at") <= now) & (F.col("expires_at") > now) & (F.col("released_at").isNull() | (F.col("released_at") > now)))
    return generations.filter("state = 'retired'").join(held.select(key).distinct(), key, "left_anti").select(key)


def index_identity(index: DataFrame, fence) -> DataFrame:
    """The row that tells later whether an index is whole and of which revision it is."""
    return index.agg(F.lit(fence).cast("bigint").alias("core_revision_fence"), F.count(F.lit(1)).alias("n_postings"))


def build_generation(docs: DataFrame, root: str, generation: int, kind: str, fence, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a generation's index below ``root`` and return its row, ready for use."""
    path = f"{root}/{kind}-{generation}"
    write_index(docs, path, key, text)
    row = index_identity(docs.sparkSession.read.parquet(path), fence)
    return row.select(
        F.lit(generation).cast("bigint").alias("index_generation_id"), F.lit(kind).alias("kind"), F.lit("ready").alias("state"),
        "core_revision_fence", "n_postings", F.lit(path).alias("path"),
    )


def direct_scan(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    return docs.filter(F.col(text).contains(query))


def trigram_search(index: DataFrame, docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose text contains ``query``. Queries under three characters have
    no gram and are scanned."""
    wanted = query_grams(query)
    if not wanted:
        return direct_scan(docs, query, text)
    # Different grams count: an id that comes twice has some of its postings twice.
    hits = index.filter(F.col("gram").isin(wanted)).groupBy(key).agg(F.size(F.collect_set("gram")).alias("_n"))
    candidates = hits.filter(F.col("_n") == len(wanted)).select(key)
    return direct_scan(docs.join(candidates, key, "left_semi"), query, text)


def index_stale(identity: DataFrame, core: DataFrame) -> DataFrame:
    """The index fence against the one current revision."""
    revision = core.select(F.max("local_revision").alias("local_revision")).scalar()
    fence = F.col("core_revision_fence")
    return identity.withColumn("local_revision", revision).withColumn(
        "stale", fence.isNull() | (fence != F.col("local_revision"))
    )


def ready_generation(generations: DataFrame) -> DataFrame:
    """The newest ready generation of each kind; searches use no other."""
    return (
        generations.filter("state = 'ready'")
        .groupBy("kind")
        .agg(F.max("index_generation_id").alias("index_generation_id"))
    )


def illegal_transitions(history: DataFrame, key: str, position: str, **options) -> DataFrame:
    """Steps that do not lead to the next state of the life cycle.

    ``history`` holds key, position and state; position is unique per key.
    """
    steps = next_in_group(history.select(key, position, "state"), [key], [position], ["state"], **options)
    rank = F.create_map(*[x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i))])
    move = F.try_element_at(rank, F.col("next_state")) - F.try_element_at(rank, F.col("state"))
    return steps.filter(F.col("next_state").isNotNull() & ~F.coalesce(move == 1, F.lit(False)))


def _distrust(query: str, index: DataFrame | None, identity: DataFrame | None, core: DataFrame | None, key: str) -> str | None:
    """Why the index cannot answer, or None. Reads one row of the identity."""
    if index is None or identity is None or core is None:
        return "index missing"
    if len(query) < GRAM:
        return "query too short"
    rows = index_stale(identity, core).limit(2).collect()
    if not rows:
        return "index missing"
    if len(rows) > 1:
        return "index corrupt"
    if rows[0]["stale"]:
        return "index stale"
    if not {"gram", key} <= set(index.columns):
        return "index corrupt"
    if "n_postings" in identity.columns and index.count() != rows[0]["n_postings"]:
        return "index corrupt"
    return None


def search(docs: DataFrame, query: str, index: DataFrame | None, identity: DataFrame | None, core: DataFrame | None,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Answer from the index when it is present, fresh and whole, else by scanning; the
    answer is the same and carries why the scan was needed.

    ``identity`` holds core_revision_fence and, as ``index_identity`` gives it,
    n_postings: an index that has lost or gained a posting is not used.
    """
    reason = _distrust(query, index, identity, core, key)
    found = trigram_search(index, docs, query, key, text) if reason is None else direct_scan(docs, query, text)
    return found.withColumn("fallback_reason", F.lit(reason).cast("string"))


def search_ready(docs: DataFrame, query: str, generations: DataFrame, kind: str, core: DataFrame,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Answer from the newest ready generation of ``kind``, under its own fence.

    ``generations`` holds the rows of ``build_generation``. A generation whose files
    are gone or cannot be read gives the scan's answer with the reason.
    """
    spark = docs.sparkSession
    ready = generations.filter(F.col("kind") == kind).join(ready_generation(generations), ["kind", "index_generation_id"], "left_semi")
    row = ready.filter("state = 'ready'").limit(1).collect()
    index = identity = None
    if row:
        identity = ready.select("core_revision_fence", "n_postings")
        try:
            index = spark.read.parquet(row[0]["path"])
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return search(docs, query, index, identity, core, key, text)
