"""Quality rules whose cutoffs are certified on labelled documents.

Signals of every text are compared with a cutoff per rule and stratum. Half of the labelled
documents choose which rules are worth having in a stratum; the other half, which
chose nothing, certifies the cutoffs: a rule rejects what lies above the (k+1)-th highest value
among the n good documents, with k the largest number for which the exact binomial bound
P(Bin(n, share) <= k) <= error still holds. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import WORD, running, text_of
from quirelens.plans.frames import null_safe_join
from quirelens.plans.lineage import cut, release

# White space, the symbols that count, the words of a window.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# ASCII marks and capitals, two further signals.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
CAPITALS = "".join(chr(c) for c in range(65, 91))

# Of the good documents of a stratum, all rules together may falsely reject SHARE; the chance that any
# stratum exceeds it is at most ERROR. A rule has to reject LIFT times as large a share of the bad.
SHARE, ERROR, LIFT = 0.05, 0.05, 4.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(reach: int) -> Callable[[Column], Column]:
    """Each hash joined with the one ``reach`` places on."""
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + reach)))


def _repeated(words: Column) -> Column:
    """How many of ``words`` lie in a window of eight that occurs twice or more.

    Windows are compared by a 64-bit hash of their words first; texts where two agree are
    compared by the windows themselves, so a shared hash never counts as a repeat.
    """
    last = F.size(words) - WINDOW + 1

    def exact(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def beside(s: Column) -> Column:
            # Neighbours in the sorted order that share a hash: only their windows are built.
            def same(x: Column, k: Column) -> Column:
                return ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

            return F.filter(s, same)

        def windows(s: Column) -> Column:
            return F.sort_array(F.transform(s, lambda x: F.struct(F.slice(words, x["i"] + 1, WINDOW).alias("w"), x["i"].alias("i"))))

        def places(s: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | (F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)))

            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))),
                F.lit(0).cast("bigint"), lambda a, b: a + b)

        return _let(_let(_let(_let(by_hash, beside), windows), places), covered)

    def count(hashes: Column) -> Column:
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0).cast("bigint")).otherwise(exact(hashes))

    # Hashes of one word, then of two, four and eight.
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    for reach in (1, 2, 4):
        hashed = _let(hashed, _joined(reach))
    return F.when(last < 2, F.lit(0).cast("bigint")).otherwise(_let(F.slice(hashed, 1, last), count))


def signals(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, the five base counts, n_lines, n_marks and n_capitals of every text."""
    rows = docs.select(*keep, text_of().alias("_text"))
    words = F.array_remove(F.split("_text", SPACE + "+"), "")
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(WORD))
    long = lambda c: c.cast("bigint")
    word_counts = _let(words, lambda w: F.struct(
        long(F.size(w)).alias("n_words"), long(F.char_length(F.array_join(w, ""))).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    line_counts = _let(lines, lambda s: F.struct(
        long(F.size(s)).alias("n_lines"), long(F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines")))
    # Marks, digits and capitals alone, which are few, hold all the characters that count.
    few = F.regexp_replace("_text", "[^\\x21-\\x60\\x7B-\\x7E]+", "")
    without = lambda s, chars: long(F.char_length(s) - F.char_length(F.translate(s, chars, "")))
    mark_counts = _let(few, lambda s: F.struct(
        without(s, SYMBOLS).alias("n_symbols"), without(s, MARKS).alias("n_marks"), without(s, CAPITALS).alias("n_capitals")))
    return rows.select(*keep, word_counts.alias("_w"), line_counts.alias("_l"), mark_counts.alias("_m")).select(
        *keep, "_w.n_words", "_w.word_chars", "_m.n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        "_l.n_lines", "_m.n_marks", "_m.n_capitals")


def _ratio(above: str, below: str) -> Column:
    return F.col(above).cast("double") / F.greatest(F.col(below), F.lit(1)).cast("double")


# Every rule rejects high values.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _ratio("n_symbols", "word_chars"),
    "marks": lambda: _ratio("n_marks", "word_chars"),
    "capitals": lambda: _ratio("n_capitals", "word_chars"),
    "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeats": lambda: _ratio("n_repeat_words", "n_words"),
    "long_words": lambda: _ratio("word_chars", "n_words"),
    "short_words": lambda: -_ratio("word_chars", "n_words"),
    "long_lines": lambda: _ratio("n_words", "n_lines"),
}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def allowed(n: Column, share: Column, error: Column) -> Column:
    """The largest k with P(Bin(n, share) <= k) <= error, -1 where even k = 0 exceeds it.

    Terms are added in logarithms, so that none vanishes for a large n. The k of interest lies below
    n * share, so no more terms than that are formed.
    """
    start = F.struct(
        (n * F.log1p(-share)).alias("term"), F.lit(float("-inf")).alias("total"), F.lit(-1).cast("bigint").alias("k"))

    def step(state: Column, i: Column) -> Column:
        high = F.greatest(state["term"], state["total"])
        total = high + F.log1p(F.exp(F.least(state["term"], state["total"]) - high))
        term = state["term"] + F.log((n - i) / (i + 1)) + F.log(share) - F.log1p(-share)
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= F.log(error), i).otherwise(state["k"]).alias("k"))

    some = F.least(n - 1, F.floor(n * share))
    return F.when(n < 1, F.lit(-1).cast("bigint")).otherwise(
        F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(some, F.lit(0).cast("bigint"))), start, step)["k"])


def _cutoffs(values: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Values with the number of good documents above each; ``values`` holds value, good and bad per group."""
    ranked = running(values.withColumn("down", -F.col("value")), groups, ["down"], "good")
    return cut(ranked.select(*groups, "value", "good", "bad", (F.col("total") - F.col("good")).alias("above")))


def certify(
    measured: DataFrame, labels: DataFrame, strata: Sequence[str],
    share: float = SHARE, error: float = ERROR, lift: float = LIFT,
) -> DataFrame:
    """(strata, rule, n_good, k, cutoff) of the rules that are certified.

    ``measured`` holds doc_id, the strata and the signals; documents that fail the base rules take no part.
    A document with several labels counts by the least. The first hexadecimal digit of the md5 of doc_id
    deals documents to the choosing half (0-7) or the certifying half. In a stratum with r chosen rules each
    has the budget share / r, and with t chosen pairs of rule and stratum each bound holds with error / t
    (Bonferroni), so with probability 1 - error no stratum loses more than share of its good documents.
    The order of values is fixed beforehand, so one order statistic needs no further correction.
    Nulls are a stratum of their own. Where nothing can be certified, nothing is rejected.
    """
    strata = list(strata)
    quality = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.filter(~base_failed()).join(quality, "doc_id")
    choosing = F.substr(F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit(1)) < "8"
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), rule().alias("value")) for name, rule in RULES.items()]))
    long = known.select(*strata, choosing.alias("choosing"), "quality", each.alias("r"))
    counted = long.groupBy(*strata, "choosing", F.col("r.rule").alias("rule"), F.col("r.value").alias("value")).agg(
        F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    table = _cutoffs(counted, [*strata, "choosing", "rule"])
    sums = table.groupBy(*strata, "choosing", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))

    half = null_safe_join(table.filter("choosing").drop("choosing"), sums.filter("choosing").drop("choosing"), [*strata, "rule"], "inner")
    within = F.col("above") <= F.floor(F.lit(share / len(RULES)) * F.col("n_good"))
    first = null_safe_join(
        half, half.filter(within).groupBy(*strata, "rule").agg(F.min("value").alias("cut_at")), [*strata, "rule"], "inner")
    over = F.col("value") > F.col("cut_at")
    rates = first.groupBy(*strata, "rule").agg(
        F.sum(F.when(over, F.col("good")).otherwise(0)).alias("good_over"), F.sum(F.when(over, F.col("bad")).otherwise(0)).alias("bad_over"),
        F.max("n_good").alias("n_good"), F.max("n_bad").alias("n_bad"))
    # Cross-multiplied, so that a stratum without bad or good documents divides by nothing.
    useful = (F.col("bad_over") > 0) & (F.col("bad_over") * F.col("n_good") >= F.lit(lift) * F.col("good_over") * F.col("n_bad"))
    chosen = cut(rates.filter(useful).select(*strata, "rule"))
    per = chosen.groupBy(*strata).agg(F.count(F.lit(1)).alias("r"))
    tests = max(1, chosen.count())

    bound = null_safe_join(
        null_safe_join(sums.filter("not choosing").drop("choosing", "n_bad"), chosen, [*strata, "rule"], "inner"), per, strata, "inner")
    bound = bound.select(*strata, "rule", "n_good", allowed(F.col("n_good"), F.lit(share) / F.col("r"), F.lit(error / tests)).alias("k"))
    held = null_safe_join(table.filter("not choosing").drop("choosing", "bad"), bound.filter("k >= 0"), [*strata, "rule"], "inner")
    out = cut(held.filter("above <= k").groupBy(*strata, "rule").agg(
        F.max("n_good").alias("n_good"), F.max("k").alias("k"), F.min("value").alias("cutoff")))
    release(table, chosen)
    return out


def quality_rules(
    docs: DataFrame, labels: DataFrame, strata: Sequence[str] = ("lang",),
    share: float = SHARE, error: float = ERROR, lift: float = LIFT,
) -> DataFrame:
    """doc_id, the signals, base_failed, the certified rules that reject the document (failed_rules) and kept.

    Needs doc_id, text and the strata, and labels with doc_id and quality (1 good, 0 bad; others and nulls are
    no label). A null or empty text has no words and fails the base rules. Repeated rows are judged each;
    an empty table gives no rows; without labels the base rules alone decide. Other columns do not matter.
    Texts are read once; what moves is a row of counts per document.
    """
    strata = list(strata)
    inner = [f"_s{i}" for i in range(len(strata))]
    rows = docs.select("doc_id", "text", *[F.col(c).alias(i) for c, i in zip(strata, inner)])
    measured = cut(signals(rows, ["doc_id", *inner]))
    cutoffs = certify(measured, labels, inner, share, error, lift)
    wide = cutoffs.groupBy(*inner).agg(*[
        F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias("_c_" + name) for name in RULES])
    judged = null_safe_join(measured, wide, inner, "left")
    failed = F.concat_ws(",", *[F.when(rule() > F.col("_c_" + name), F.lit(name)) for name, rule in RULES.items()])
    out = judged.select("doc_id", *BASE, "n_lines", "n_marks", "n_capitals", base_failed().alias("base_failed"), failed.alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
