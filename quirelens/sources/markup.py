"""Links, records and blocks out of HTML, markdown, XML and tree listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.functions.paths import strip
from quirelens.functions.urls import decode_entities

# Text inside these is not markup: comments, and script or style bodies. Whichever
# opens first goes up to its own end, or to the end of the page if it has none.
NOT_MARKUP = r"(?is)<!--.*?(?:-->|\z)|(<(script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>).*?(?:</\2\s*>|\z)"
START_TAGS = r"""<[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTES = r"""([^\s=/>"'<]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)"""


def extract_links(pages: DataFrame, key: str = "page_id", html: str = "html", *keep: str) -> DataFrame:
    """Every ``href`` of every start tag, numbered in page order.

    Attributes are read one after another, so an ``href=`` inside another
    attribute's value is not a link. Returns key, kept columns, link_no, target.
    """
    clean = F.regexp_replace(F.col(html), NOT_MARKUP, "$1")
    tags = F.filter(
        F.regexp_extract_all(clean, F.lit(START_TAGS), F.lit(0)), lambda t: t.rlike(r"(?i)\bhref\b")
    )

    def hrefs(tag):
        pairs = F.arrays_zip(
            F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(1)).alias("name"),
            F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(2)).alias("value"),
        )
        return F.transform(
            F.filter(pairs, lambda p: F.lower(p["name"]) == "href"),
            lambda p: decode_entities(F.regexp_replace(p["value"], r"""(?s)^(["'])(.*)\1\z""", "$2")),
        )

    found = F.flatten(F.transform(tags, hrefs))
    return pages.select(key, *keep, F.posexplode(found).alias("link_no", "target"))


def parse_tree_listing(df: DataFrame, listing: str, *keep: str) -> DataFrame:
    """Records ``mode type oid<TAB>path``, separated by NUL."""
    record = F.explode(F.split(F.col(listing), "\x00")).alias("_record")
    meta = F.split(F.substring_index("_record", "\t", 1), " ")
    return (
        df.select(*keep, record)
        .filter(F.col("_record") != "")
        .select(
            *keep,
            F.get(meta, F.lit(0)).alias("mode"),
            F.get(meta, F.lit(1)).alias("type"),
            F.get(meta, F.lit(2)).alias("oid"),
            F.regexp_extract("_record", r"(?s)\t(.*)\z", 1).alias("path"),
        )
    )


# A table row that opens with a link, and a fenced block.
MD_ROW = r"^\| \[[^\]]+\]\(([^)]+)\)"
FENCED = r"(?s)```{tag}\n(.*?)\n```"


def parse_md_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Table rows that open with a link: link target and the whole row."""
    row = F.explode(F.split(F.col(text), r"\r\n|\n|\r")).alias("row")
    target = F.regexp_extract("row", MD_ROW, 1).alias("target")
    return df.select(*keep, row).select(*keep, target, "row").filter(F.col("target") != "")


def extract_block(df: DataFrame, text: str, tag: str, *keep: str) -> DataFrame:
    """First fenced block with the given tag, trimmed. A text without one fails the job."""
    pattern = FENCED.replace("{tag}", tag)
    body = F.regexp_extract(text, pattern, 1)
    missing = F.raise_error(F.lit(f"no {tag} block found"))
    return df.select(
        *keep, F.when(F.col(text).rlike(pattern), strip(body)).otherwise(missing).alias("block")
    )


def read_cases(spark: SparkSession, path: str, home: str = "") -> DataFrame:
    """Test cases of XML reports: node name, and whether it failed or was skipped.

    Names that begin with ``tests/`` are below ``home``.
    """
    schema = (
        "_classname string, _name string, failure array<string>, error array<string>, "
        "skipped array<string>"
    )
    df = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    node = F.concat(F.replace("_classname", F.lit("."), F.lit("/")), F.lit(".py::"), F.col("_name"))
    bad = F.coalesce(F.col("failure"), F.col("error"), F.col("skipped")).isNotNull()
    return df.select(F.regexp_replace(node, "^tests/", f"{home}tests/").alias("node"), bad.alias("not_passed"))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Page locations of a sitemap."""
    df = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .option("ignoreNamespace", "true")
        .schema("loc string")
        .load(path)
    )
    return df.select(strip("loc").alias("location"))
