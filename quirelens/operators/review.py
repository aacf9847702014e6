"""Which pages need review after which sources changed, and what has to be rebuilt."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelens.functions.text import grams, inner_words, word_run_hashes, word_runs, words
from quirelens.plans.frames import union_all
from quirelens.plans.lineage import cut
from quirelens.plans.skew import lookup_join

# The two reason texts, and what an unknown acknowledgement is called.
UNKNOWN = "Not a previously pending review path"
FIRST_RUN = "Initial or unavailable baseline: review applicability manually"
CHANGED = "Changed source: "

# Ways to anchor a source text, best first: a run of three whole words, one whole
# word, or a run of characters. A gram of the text's own length always exists.
GRAM_SIZES = (8, 3, 2, 1)


def _marks(text: str, way: str) -> Column:
    """Hashes of everything of one kind a text holds."""
    if way == "run":
        return word_run_hashes(words(text), 3)
    if way == "word":
        return word_run_hashes(words(text), 1)
    return F.transform(grams(text, int(way)), lambda g: F.xxhash64(g))


def _offers(sources: DataFrame, key: str, text: str) -> DataFrame:
    """The marks each source offers as its anchor: _source, way, length and mark.

    Words cut by the source's own ends are left out, since they may be parts of
    longer words in a page.
    """
    size = F.char_length("_text")
    staged = sources.select(F.col(key).alias("_source"), F.col(text).alias("_text")).filter(size > 0)
    staged = staged.withColumn("_inner", inner_words("_text"))
    staged = staged.withColumn("_runs", word_runs("_inner", 3)).withColumn("_words", word_runs("_inner", 1))

    def offer(way, marks):
        return F.struct(F.lit(way).alias("way"), marks.alias("marks"))

    pick = F.when(F.size("_runs") > 0, offer("run", F.col("_runs"))).when(F.size("_words") > 0, offer("word", F.col("_words")))
    for n in GRAM_SIZES:
        hashes = F.transform(grams("_text", n), lambda g: F.struct(F.lit(n).alias("length"), F.xxhash64(g).alias("hash")))
        pick = pick.when(size >= n, offer(str(n), hashes))
    offers = staged.select("_source", pick.alias("p")).select("_source", "p.way", F.explode("p.marks").alias("m"))
    return cut(offers.select("_source", "way", "m.length", F.col("m.hash").alias("mark")))


def _anchors(sources: DataFrame, key: str, text: str, offers: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """One anchor per source: something every text that contains it must hold.

    Of the marks a source offers, the one fewest pages hold is taken (``hits`` has
    way, mark and page), then the one fewest sources share, the longest among those,
    so that common words do not bring many sources and many pages together.
    """
    offers = _offers(sources, key, text) if offers is None else offers
    shared = offers.groupBy("way", "mark").agg(F.count(F.lit(1)).alias("n"))
    if hits is None:
        known = shared.withColumn("pages", F.lit(0).cast("bigint"))
    else:
        held = hits.groupBy("way", "mark").agg(F.count(F.lit(1)).alias("pages"))
        known = shared.join(held, ["way", "mark"], "left").na.fill(0, ["pages"])
    best = F.min(F.struct("pages", "n", (-F.col("length")).alias("l"), "mark"))["mark"]
    return (
        lookup_join(offers, known, ["way", "mark"], "inner", ["_source"])
        .groupBy("_source", "way")
        .agg(best.alias("mark"))
    )


def text_dependents(
    sources: DataFrame,
    pages: DataFrame,
    source_key: str = "source",
    source_text: str = "source",
    page_key: str = "page",
    page_text: str = "text",
) -> DataFrame:
    """(source, page) where the page's text contains the source's text.

    Page texts are read once for their marks, of which only those that a source
    offers are kept, and once more for the pages that share a source's anchor; there
    the pairs bring the short source texts along. Hashes keep the exploded rows
    narrow; a collision only adds a pair to compare. Empty source texts name nothing.
    """
    offers = _offers(sources, source_key, source_text)
    wanted = cut(offers.select("way", "mark").distinct())
    # At most one row per way of marking a text.
    ways = sorted(r["way"] for r in wanted.select("way").distinct().collect())
    key_types = [sources.schema[source_key].dataType, pages.schema[page_key].dataType]
    if not ways:
        schema = T.StructType([T.StructField(source_key, key_types[0]), T.StructField(page_key, key_types[1])])
        return pages.sparkSession.createDataFrame([], schema)

    def tagged(way):
        marks = F.array_distinct(F.coalesce(_marks(page_text, way), F.array().cast("array<bigint>")))
        return F.transform(marks, lambda m: F.struct(F.lit(way).alias("way"), m.alias("mark")))

    marks = pages.select(F.col(page_key).alias("_page"), F.explode(F.concat(*[tagged(w) for w in ways])).alias("m"))
    hits = cut(lookup_join(marks.select("_page", "m.way", "m.mark"), wanted, ["way", "mark"], "left_semi", ["_page"]))
    anchors = cut(_anchors(sources, source_key, source_text, offers, hits))
    pairs = lookup_join(hits, anchors, ["way", "mark"], "inner", ["_page"]).select("_source", "_page")
    needles = sources.select(F.col(source_key).alias("_source"), F.col(source_text).alias("_needle"))
    # Written down so that its true size decides how the long texts are fetched.
    near = cut(lookup_join(pairs, needles, ["_source"], "inner", ["_page"]))
    texts = pages.select(F.col(page_key).alias("_page"), F.col(page_text).alias("_text"))
    checked = near.join(texts, "_page")
    return checked.filter(F.col("_text").contains(F.col("_needle"))).select(
        F.col("_source").alias(source_key), F.col("_page").alias(page_key)
    )


@dataclass(frozen=True)
class Rule:
    """A class of sources and the pages it touches."""

    name: str
    source: Callable[[], Column]
    page: Callable[[], Column]


@dataclass
class Impact:
    """Review reasons in factored form.

    A reason is (page, source). Sources a rule sends to a class of pages and
    sources that hit every page are kept once, not once per page.
    """

    pages: DataFrame  # page
    text_matches: DataFrame  # source, page
    rule_sources: DataFrame  # rule, source
    rule_pages: DataFrame  # rule, page
    everywhere: DataFrame  # source

    def counts(self) -> DataFrame:
        """Pending pages with the number of their reasons and the first of them."""
        every = self.everywhere.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("source").alias("first")).alias("e")).scalar()
        n_every, first_every = every["n"], every["first"]
        per_rule = self.rule_sources.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first"))
        by_rule = (
            self.rule_pages.join(per_rule, "rule")
            .groupBy("page")
            .agg(F.sum("n").alias("n_rule"), F.min("first").alias("first_rule"))
        )
        # A text match counts on its own only where the source's rule misses the page.
        ruled = lookup_join(self.text_matches, self.rule_sources, ["source"], "left", ["page"])
        alone = ruled.join(self.rule_pages.select("rule", "page"), ["rule", "page"], "left_anti")
        by_text = alone.groupBy("page").agg(F.count(F.lit(1)).alias("n_text"), F.min("source").alias("first_text"))
        out = self.pages.join(by_rule, "page", "left").join(by_text, "page", "left")
        total = F.coalesce("n_rule", F.lit(0)) + F.coalesce("n_text", F.lit(0)) + F.coalesce(n_every, F.lit(0))
        return (
            out.select(
                "page", total.alias("n_reasons"),
                F.least("first_rule", "first_text", first_every).alias("first_source"),
            )
            .filter("n_reasons > 0")
        )

    def reasons(self, pages: DataFrame) -> DataFrame:
        """The (page, reason) rows of the given pages, distinct. Sources that hit
        every page come once, with a null page."""
        wanted = pages.select("page").distinct()
        by_rule = lookup_join(self.rule_pages, wanted, ["page"], "left_semi", ["rule"]).join(self.rule_sources, "rule")
        by_text = lookup_join(self.text_matches, wanted, ["page"], "left_semi", ["source"])
        page_type = self.pages.schema["page"].dataType
        every = self.everywhere.select(F.lit(None).cast(page_type).alias("page"), "source")
        rows = [x.select("page", "source") for x in (by_rule, by_text, every)]
        return (
            union_all(rows)
            .distinct()
            .select("page", F.concat(F.lit(CHANGED), F.col("source").cast("string")).alias("reason"))
        )


def rule_dependents(
    sources: DataFrame,
    pages: DataFrame,
    rules: Sequence[Rule],
    source_key: str = "source",
    source_text: str = "source",
    page_key: str = "page",
    page_text: str = "text",
) -> Impact:
    """Pages each changed source touches: those that contain its text, those of the
    first rule it matches, and every page when neither finds any."""
    rule = F.lit(None).cast("string")
    for r in reversed(rules):
        rule = F.when(r.source(), F.lit(r.name)).otherwise(rule)
    ruled = sources.select(F.col(source_key).alias("source"), rule.alias("rule"))
    classes = F.array_compact(F.array(*[F.when(r.page(), F.lit(r.name)) for r in rules]))
    rule_pages = pages.select(F.explode(classes).alias("rule"), F.col(page_key).alias("page"))
    matches = cut(
        text_dependents(sources, pages, source_key, source_text, page_key, page_text).select(
            F.col(source_key).alias("source"), F.col(page_key).alias("page")
        )
    )
    everywhere = (
        ruled.filter("rule is null").select("source").join(matches.select("source").distinct(), "source", "left_anti")
    )
    return Impact(
        pages=pages.select(F.col(page_key).alias("page")),
        text_matches=matches,
        rule_sources=ruled.filter("rule is not null").select("rule", "source"),
        rule_pages=rule_pages,
        everywhere=everywhere,
    )


def first_run_reasons(pages: DataFrame) -> DataFrame:
    """Without a baseline every page is unassessed, which is not 'no changes'."""
    return pages.select("page", F.lit(FIRST_RUN).alias("reason"))


def merge_reasons(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct (page, reason) rows of both; a page's reasons stay rows, so a page
    with very many of them is never one value."""
    return old.select("page", "reason").unionByName(new.select("page", "reason")).distinct()


def unknown_acknowledgements(pending: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return acknowledged.select("page").distinct().join(pending.select("page").distinct(), "page", "left_anti")


def update_pending(pending: DataFrame, acknowledged: DataFrame, reasons: DataFrame) -> DataFrame:
    """Drop acknowledged pages, then add the reasons of new changes again.

    Acknowledging a page that is not pending is an error.
    """
    unknown = unknown_acknowledgements(pending, acknowledged).limit(1).collect()
    if unknown:
        raise ValueError(f"{UNKNOWN}: {unknown[0]['page']}")
    done = acknowledged.select("page").distinct()
    left = lookup_join(pending.select("page", "reason"), done, ["page"], "left_anti", ["reason"])
    return merge_reasons(left, reasons)


def plan_refresh(current: DataFrame, baseline: DataFrame | None, key: str = "part") -> DataFrame:
    """What each part needs.

    ``current`` holds key, inputs, renderer, generated, ir_sha256 and cache_valid;
    ``baseline`` the same without the last, as saved. A null cache counts as not
    valid. Generating forces preparing.
    """
    fields = ["inputs", "renderer", "generated", "ir_sha256"]
    if baseline is None:
        known = current.select("*", F.lit(None).cast("boolean").alias("_known"), *[F.lit(None).cast("string").alias("_" + f) for f in fields])
    else:
        old = baseline.select(key, F.lit(True).alias("_known"), *[F.col(f).alias("_" + f) for f in fields])
        known = current.join(old, key, "left")

    def moved(f):
        return ~F.col(f).eqNullSafe(F.col("_" + f))

    first = F.col("_known").isNull()
    generate = first | moved("renderer") | moved("generated")
    prepare = ~F.coalesce("cache_valid", F.lit(False)) | moved("inputs") | generate
    return known.select(
        key,
        F.when(first, "unassessed").otherwise("recorded").alias("baseline"),
        prepare.alias("prepare_needed"),
        (generate | first | moved("ir_sha256")).alias("generate_needed"),
        (generate | prepare).alias("generation_planned"),
    )


def review_status(plan: DataFrame, pending: DataFrame, key: str = "part") -> DataFrame:
    """updated, review-needed or up-to-date; ``pending`` holds parts with open items."""
    open_items = pending.select(key).distinct().withColumn("_open", F.lit(True))
    status = (
        F.when(F.col("prepare_needed") | F.col("generate_needed"), "updated")
        .when(F.col("_open"), "review-needed")
        .otherwise("up-to-date")
    )
    return plan.join(open_items, key, "left").withColumn("status", status).drop("_open")


def cache_valid(checks: DataFrame, key: str = "part") -> DataFrame:
    """A part's cache holds when every recorded file is 'ok'. ``checks`` holds key
    and status as ``verify_manifest`` gives it; a part without files has no row."""
    return checks.groupBy(key).agg((F.count_if(F.col("status") != "ok") == 0).alias("cache_valid"))
