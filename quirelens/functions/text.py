"""Text expressions: slugs, truncation, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelens.functions.paths import let

# Text over 600 characters keeps its first 400 and a marker.
LONG_TEXT = 600
KEPT_TEXT = 400
CUT_MARK = "\n-- ... [truncated long JSON guard contract; see json_contracts.sql] ..."

# What ends a line.
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"

# What separates two words when texts are compared by words.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_long(text, limit: int = LONG_TEXT, kept: int = KEPT_TEXT, mark: str = CUT_MARK) -> Column:
    t = _col(text)
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, kept), F.lit(mark))).otherwise(t)


# What a slug drops, and what a heading is.
SLUG_DROPS = r"[^\p{L}\p{N}_\- ]"
HEADING = r"(?m)^#+ (.+)$"


def heading_slug(text) -> Column:
    """Anchor of a heading: lower case, word characters only, '-' for spaces."""
    kept = F.regexp_replace(F.lower(_col(text)), SLUG_DROPS, "")
    return F.translate(kept, " ", "-")


def headings(text) -> Column:
    """Heading lines of a markdown text, without their marks."""
    return F.regexp_extract_all(_col(text), F.lit(HEADING), F.lit(1))


def line_count(text) -> Column:
    """Lines of a text; a final line end opens no further line."""
    t = _col(text)
    lines = F.size(F.split(t, LINE_END))
    return F.when(t == "", 0).when(t.rlike(LINE_END + r"\z"), lines - 1).otherwise(lines)


def grams(text, size: int) -> Column:
    """Distinct runs of ``size`` characters, read in one pass over the text."""
    return F.array_distinct(
        F.regexp_extract_all(_col(text), F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))
    )


def words(text) -> Column:
    return F.split(_col(text), WORD_BREAK)


def inner_words(text) -> Column:
    """Words with a break on both sides inside ``text``. Wherever the text occurs as
    a substring these are whole words of the text around it."""
    return let(
        words(text),
        lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))),
    )


def _runs(word_array, size: int, value) -> Column:
    def runs(w):
        starts = F.sequence(F.lit(0), F.size(w) - size)
        every = F.transform(starts, lambda i: value([F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) >= size, every)

    return let(_col(word_array), runs)


def word_run_hashes(word_array, size: int) -> Column:
    """Hash of each run of ``size`` neighbouring words; null when there are fewer."""
    return _runs(word_array, size, lambda parts: F.xxhash64(*parts))


def word_runs(word_array, size: int) -> Column:
    """The same with the length of each run, to choose among few runs."""
    return _runs(
        word_array,
        size,
        lambda parts: F.struct(
            F.char_length(F.concat(*parts)).alias("length"), F.xxhash64(*parts).alias("hash")
        ),
    )
