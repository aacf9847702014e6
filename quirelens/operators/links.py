"""Links between pages: classes, resolution, breakage, rewriting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions.paths import dirname, join_path, normalize_path, relative_path, strip
from quirelens.functions.urls import host, is_internal, link_class, link_path, link_tail, page_file, resolve_file
from quirelens.plans.skew import lookup_join
from quirelens.sources.markup import extract_links


def page_routes(pages: DataFrame, url: str = "url") -> DataFrame:
    """Names each page answers to on its host: its file, and the folder when the
    file is a folder's index page."""
    files = pages.select(host(url).alias("host"), page_file(url).alias("file")).distinct()
    folders = files.filter(F.col("file").rlike(r"(^|/)index\.html\z")).select(
        "host", F.regexp_replace("file", r"/?index\.html\z", "").alias("file"), F.lit(True).alias("is_folder")
    )
    return files.withColumn("is_folder", F.lit(False)).unionByName(folders)


def classify_links(links: DataFrame) -> DataFrame:
    """Links with their class and, when internal, their decoded path."""
    kind = link_class("target")
    return links.withColumn("link_class", kind).withColumn(
        "path", F.when(F.col("link_class") == "internal", link_path("target"))
    )


def resolve_links(pages: DataFrame, url: str = "url") -> DataFrame:
    """Internal links of pages with the file they mean.

    ``from_root`` holds the second reading of a link that ends with '/': the
    folder of that name below the site root.
    """
    placed = pages.select("page_id", host(url).alias("host"), page_file(url).alias("page"), "html")
    links = extract_links(placed, "page_id", "html", "host", "page").filter(is_internal("target"))
    # One step per column, so that no expression is repeated inside the next.
    inside = links.withColumn("path", link_path("target")).filter("path <> ''")
    return inside.select(
        "page_id", "link_no", "host", "page", strip("target").alias("target"),
        resolve_file("page", "path").alias("file"),
        F.when(F.col("path").endswith("/"), normalize_path(F.trim(F.col("path"), F.lit("/")))).alias("from_root"),
    )


def broken_links(links: DataFrame, routes: DataFrame) -> DataFrame:
    """Resolved links that are no file, no folder with an index page, and no folder
    below the root either."""
    salt = ["page_id", "link_no"]
    gone = lookup_join(links, routes.select("host", "file").distinct(), ["host", "file"], "left_anti", salt)
    folders = routes.filter("is_folder").select("host", F.col("file").alias("_again"))
    again = gone.withColumn("_again", F.coalesce("from_root", "file"))
    return lookup_join(again, folders, ["host", "_again"], "left_anti", salt).drop("_again")


def link_audit(pages: DataFrame) -> DataFrame:
    """Every internal link of every page that leads nowhere on the page's host."""
    broken = broken_links(resolve_links(pages), page_routes(pages))
    return broken.select("page_id", "link_no", "host", "target", F.col("file").alias("resolved"))


# Which links of a markdown text count.
MD_LINK = r"!?\[[^\]]*\]\([^\s)]+\)"
MD_PARTS = r"(?s)^(!?\[[^\]]*\]\()([^\s)]+)\)\z"


def rewrite_links(
    docs: DataFrame,
    link_map: DataFrame,
    external_base: str,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    home: str = "",
    aliases: DataFrame | None = None,
    bases: Sequence[tuple[str, str]] = (),
    moved_prefix: tuple[str, str] | None = None,
) -> DataFrame:
    """Rewrite the links of markdown texts.

    A relative target is read from the folder of ``source``. Found in
    ``link_map(path, published)`` it becomes a path from ``home``; otherwise it
    points to ``external_base``, or to the base of the first of ``bases`` (pattern of
    paths, base) that fits. Query and fragment stay. External, absolute and empty
    targets stay as they are, but a target that begins with the first of
    ``moved_prefix`` begins with the second instead. ``aliases(old_key, new_key)``
    renames resolved paths before the lookup.
    """
    found = F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(0))
    links = docs.select(key, source, F.posexplode(found).alias("pos", "link")).select(
        key, "pos", "link", source,
        F.regexp_extract("link", MD_PARTS, 1).alias("_open"),
        F.regexp_extract("link", MD_PARTS, 2).alias("target"),
    )
    bare = F.regexp_replace("target", r"(?s)[?#].*\z", "")
    moves = ~F.col("target").rlike(r"^([?#/]|[A-Za-z][A-Za-z0-9+.\-]*:)")
    local = links.withColumn("path", F.when(moves, normalize_path(join_path(dirname(source), bare))))
    moving = local.filter("path is not null")
    if aliases is not None:
        names = aliases.select(F.col("old_key").alias("path"), "new_key")
        moving = (
            lookup_join(moving, names, ["path"], "left", [key, "pos"])
            .withColumn("path", F.coalesce("new_key", "path"))
            .drop("new_key")
        )
    moved = lookup_join(moving, link_map.select("path", "published"), ["path"], "left", [key, "pos"])
    base = F.lit(external_base)
    for pattern, other in reversed(bases):
        base = F.when(F.col("path").rlike(pattern), F.lit(other)).otherwise(base)
    url = F.when(F.col("published").isNotNull(), relative_path(F.col("published"), F.lit(home))).otherwise(
        F.concat(base, F.col("path"))
    )
    new = F.concat(F.col("_open"), url, link_tail("target"), F.lit(")"))
    changed = moved.select(key, F.struct("pos", new.alias("link")).alias("_l"))
    if moved_prefix is not None:
        before, after = moved_prefix
        if not re.match(r"[/]|[A-Za-z][A-Za-z0-9+.\-]*:", before):
            raise ValueError("Only an absolute prefix can move")
        renamed = links.filter(F.col("target").startswith(before)).select(
            key, F.struct("pos", F.concat("_open", F.lit(after), F.substring("target", len(before) + 1, 1 << 30), F.lit(")")).alias("link")).alias("_l")
        )
        changed = changed.unionByName(renamed)
    # A text's links are gathered again; they came from one row and fit in one.
    per_doc = (
        changed.groupBy(key)
        .agg(F.map_from_entries(F.array_agg("_l")).alias("_new"))
    )
    pieces = F.split(F.col(text), MD_LINK, -1)
    fitted = F.transform(
        F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(0)),
        lambda old, i: F.coalesce(F.try_element_at(F.col("_new"), i), old),
    )
    woven = F.array_join(
        F.flatten(F.zip_with(pieces, fitted, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""
    )
    out = docs.join(per_doc, key, "left")
    return out.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(woven)).drop("_new")
