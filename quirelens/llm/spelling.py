"""Spelling variants: words one edit apart, the rarer one led to the more frequent one.

Letters are hashed to a few symbols. Every reduced word offers the keys of all reduced
words within one edit of it, the reduced vocabulary answers, and whatever answers is
verified on the original strings. A key is a polynomial hash over the symbols, so that
the key of each neighbour follows from prefixes and suffixes: a word of n letters costs
n steps a symbol, not n squared, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import ship, text_of
from quirelens.operators.graph import follow
from quirelens.plans.lineage import cut, release
from quirelens.plans.skew import lookup_join

# The letters of a run, those that are lower-cased, the divisor of damaged runs.
LETTER = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199
SYMBOLS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# Places of the bitmap of reduced words, 16 MB whatever their number. A place that several share only lets more through.
PLACES = 1 << 27
# A block of words holds at most so many keys at a time.
_KEYS = 1 << 21


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of all texts and how often they occur, map-side combined.

    Runs of letters are lower-cased (A-Z only); with h the crc32 of ``doc_id:run``, a run whose h
    ``damage`` divides loses its code point h % length. Null texts have none, a null doc_id counts
    as empty. All letters of a run are in the basic plane, so characters are code points.
    """
    # A run only gets shorter, so a short one is none of the words; a longer one is matched whole.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(text_of(), F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    hashed = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    damaged = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.pmod("h", F.lit(damage)) == 0, damaged).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The key of each row of symbols: the sum of symbol i times base to the i, wrapping."""
    return (codes * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbour_keys(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The keys of all reduced words within one edit of each row, with repeats; the row's own too."""
    m, n = codes.shape
    power = _powers(n + 1)
    terms = codes * power[:n]
    before = np.zeros((m, n + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    after = before[:, -1:] - before  # the terms from place i on
    # One symbol fewer shifts what follows down by a place: the same sum with powers of one less.
    low = np.zeros((m, n + 1), dtype=np.uint64)
    np.cumsum(codes[:, 1:] * power[: n - 1], axis=1, out=low[:, 1:n])
    low[:, n] = low[:, n - 1]
    gone = before[:, :n] + (low[:, n - 1 : n] - low[:, :n])
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    kept = before[:, :n] + after[:, 1:]
    changed = kept[:, :, None] + every * power[:n, None]
    longer = before[:, :, None] + every * power[: n + 1, None] + (after * _BASE)[:, :, None]
    return np.concatenate([gone, changed.reshape(m, -1), longer.reshape(m, -1)], axis=1)


def _codes(words: list[str], symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of words of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
    return (points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)


def _same_length(words: list[str], symbols: int) -> Iterator[list[int]]:
    """Places of words of one length, in blocks whose keys fit into memory."""
    by: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by.setdefault(len(word), []).append(i)
    for n, places in by.items():
        step = max(1, _KEYS // (2 * (n + 1) * (symbols + 1)))
        for i in range(0, len(places), step):
            yield places[i : i + step]


def _keyed(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            keys = np.zeros(len(words), dtype=np.uint64)
            for places in _same_length(words, symbols):
                keys[places] = keys_of(_codes([words[i] for i in places], symbols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=["word", "n", "key"])

    return run


def _known_places(keyed: DataFrame) -> np.ndarray:
    """The bitmap of the reduced vocabulary: a bit for each key, at its place. Combined on the map side."""
    place = F.pmod("key", F.lit(PLACES)) + 1  # buckets count from 1
    parts = keyed.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(PLACES // 8, dtype=np.uint8)
    for row in parts.collect():  # PLACES / 8 bytes at most
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        out[(row["b"] - 1) * len(bits) :][: len(bits)] = bits
    return out


def _offers(symbols: int, known):
    """From each word of the reduced vocabulary (one that stands for its key) the keys near it that may be known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            own = np.asarray(batch.column("key"))
            for places in _same_length(words, symbols):
                near = neighbour_keys(_codes([words[i] for i in places], symbols), symbols).view(np.int64)
                mine = np.broadcast_to(own[places][:, None], near.shape)
                at = near % PLACES
                keep = (near >= mine) & (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)  # the other side offers the other half
                found = np.unique(np.stack([mine[keep], near[keep]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["key", "near"])

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, other_n): words one inserted, deleted or replaced code point apart, each pair once.

    ``words`` holds distinct words, none empty, and n; it is read several times and should be written down.
    Words that share a key are told apart by the verification alone, so a join on a key may be
    skewed; its condition is part of the join, and no candidate leaves it unverified.
    """
    ship(words.sparkSession)
    keyed = cut(words.select("word", "n").mapInArrow(_keyed(symbols), "word string, n bigint, key bigint"))
    reduced = keyed.groupBy("key").agg(F.min("word").alias("word"))
    bits = words.sparkSession.sparkContext.broadcast(_known_places(keyed))
    offers = reduced.select("word", "key").mapInArrow(_offers(symbols, bits), "key bigint, near bigint")
    known = keyed.select(F.col("key").alias("near")).distinct()
    meet = offers.join(known, "near", "left_semi").distinct()
    left = lookup_join(keyed, meet, ["key"], "inner", ["word"], moves_on=True).select("word", "n", "key", "near")
    right = keyed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("near"))
    once = (F.col("key") < F.col("near")) | (F.col("word") < F.col("other"))
    verified = F.levenshtein("word", "other", 1) == 1
    pairs = left.join(right, "near").filter(once & verified).select("word", "n", "other", "other_n")
    pairs._scratch = keyed._scratch
    return pairs


def spelling_variants(docs: DataFrame, times: int = 5, shortest: int = 6, least: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """Every word with its near words' number, its form (the near word of largest n, if that is at least
    ``times`` its own; ties: the smallest in code-point order) and its root, where the forms end.

    Needs doc_id and text; other columns, of whatever name, do not matter. Null texts have no words, empty
    ones neither; repeated rows count each; an empty table gives no rows. A form is more frequent than its
    word, so forms never turn in a circle.
    """
    words = cut(vocabulary(docs, shortest, least))
    pairs = near_pairs(words, symbols)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )).alias("p")).select("p.*")
    best = cut(both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")))
    release(pairs)
    best_n = -F.col("best.rank")
    formed = F.when(best_n >= F.lit(times) * F.col("n"), F.col("best.near"))
    known = cut(words.join(best, "word", "left").select(
        "word", formed.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed.isNotNull(), best_n).alias("form_n")))
    ends = follow(known.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("next")))
    ends = ends.select(F.col("node").alias("word"), F.col("last").alias("root"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
