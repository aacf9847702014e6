"""Page links: extraction, classes, breakage, rewriting, safety."""

from pyspark.sql import functions as F

from quirelens.functions.urls import host, join_url, page_file, url_path
from quirelens.operators import diff, graph, links, safety
from quirelens.plans.lineage import scratch_path
from quirelens.queries.registry import query
from quirelens.session import table
from quirelens.sources.markup import extract_links, parse_md_rows, parse_tree_listing, read_cases, read_locations

LINKS_SQL = r"""
clean AS (
  SELECT page_id, url,
         regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|(<script\b[^>]*>).*?(?:</script\s*>|\z)|(<style\b[^>]*>).*?(?:</style\s*>|\z)',
           '\1\2', 'g') AS html
  FROM pages),
found AS (
  SELECT page_id, url, regexp_extract_all(html, '(?i)<[a-z][^>]*\shref\s*=\s*"([^"]*)"', 1) AS l FROM clean),
links AS (
  SELECT page_id, url, CAST(i AS INTEGER) AS link_no,
         replace(replace(replace(replace(replace(replace(replace(l[i + 1], '&lt;', '<'), '&gt;', '>'),
           '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&amp;', '&') AS target
  FROM found, unnest(range(len(l))) AS u(i)),
classed AS (
  SELECT *, CASE WHEN trim(target) = '' THEN 'empty'
                 WHEN target LIKE 'http://%' OR target LIKE 'https://%' THEN 'external'
                 WHEN target LIKE '//%' THEN 'protocol-relative'
                 WHEN target LIKE 'mailto:%' THEN 'mailto'
                 WHEN target LIKE 'javascript:%' THEN 'javascript'
                 WHEN target LIKE '#%' THEN 'fragment'
                 ELSE 'internal' END AS link_class
  FROM links),
pathed AS (
  SELECT *, CASE WHEN link_class = 'internal' THEN
      url_decode(regexp_replace(regexp_replace(trim(target), '(?s)[?#].*$', ''), ';[^/]*$', '')) END AS path,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host
  FROM classed),
files AS (
  SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host,
    CASE WHEN p = '' OR p LIKE '%/' THEN p || 'index.html' ELSE p END AS file
  FROM (SELECT url, ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/') AS p FROM pages)),
resolved AS (
  SELECT page_id, link_no, host, target, rtrim(ltrim(path, '/'), '/') AS file
  FROM pathed WHERE link_class = 'internal' AND path <> '')
"""


@query("link_extract", f"WITH {LINKS_SQL} SELECT page_id, link_no, target FROM links")
def link_extract(spark, sf):
    return extract_links(table(spark, sf, "pages"))


@query("link_classes", f"WITH {LINKS_SQL} SELECT page_id, link_no, target, link_class, path FROM pathed")
def link_classes(spark, sf):
    return links.classify_links(extract_links(table(spark, sf, "pages")))


@query(
    "link_audit",
    f"""WITH {LINKS_SQL} SELECT page_id, link_no, host, target, file AS resolved FROM resolved r
    WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.host = r.host
      AND (f.file = r.file OR f.file = r.file || '/index.html' OR (r.file = '' AND f.file = 'index.html')))""",
)
def link_audit(spark, sf):
    return links.link_audit(table(spark, sf, "pages"))


@query(
    "link_degree",
    f"""WITH {LINKS_SQL},
    own AS (SELECT DISTINCT host || '/' || file AS node FROM files),
    edges AS (SELECT r.host || '/' || f.file AS source, r.host || '/' || r.file AS target
      FROM resolved r JOIN (SELECT page_id, CASE WHEN p = '' OR p LIKE '%/' THEN p || 'index.html' ELSE p END AS file
        FROM (SELECT page_id, ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/') AS p
              FROM pages)) f USING (page_id))
    SELECT node, (SELECT count(*) FROM edges e WHERE e.source = node) AS n_out,
           (SELECT count(*) FROM edges e WHERE e.target = node) AS n_in FROM own""",
)
def link_degree(spark, sf):
    pages = table(spark, sf, "pages")
    nodes = pages.select(F.concat_ws("/", host("url"), page_file("url")).alias("node")).distinct()
    edges = links.resolve_links(pages).select(
        F.concat_ws("/", "host", "page").alias("source"), F.concat_ws("/", "host", "file").alias("target")
    )
    return graph.degrees(nodes, edges)


@query(
    "required_routes",
    f"""WITH {LINKS_SQL} SELECT DISTINCT host, regexp_extract(file, '^([^/]*)/', 1) || '/index.html' AS file
    FROM files f WHERE file LIKE '%/%' AND NOT EXISTS (SELECT 1 FROM files g WHERE g.host = f.host
      AND g.file = regexp_extract(f.file, '^([^/]*)/', 1) || '/index.html')""",
)
def required_routes(spark, sf):
    files = table(spark, sf, "pages").select(host("url").alias("host"), page_file("url").alias("file"))
    required = files.filter(F.col("file").contains("/")).select(
        "host", F.concat(F.split_part("file", F.lit("/"), F.lit(1)), F.lit("/index.html")).alias("file")
    )
    return diff.missing_members(required, files, ["host", "file"])


@query(
    "url_union",
    """WITH base AS (SELECT regexp_replace(url, '[?#].*$', '') AS location FROM pages),
    extra AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/' || x AS location
      FROM pages, (VALUES ('en/'), ('sitemap.xml')) v(x))
    SELECT location FROM base UNION ALL SELECT location FROM extra WHERE location NOT IN (SELECT location FROM base)""",
)
def url_union(spark, sf):
    pages = table(spark, sf, "pages")
    base = pages.select(F.regexp_replace("url", r"(?s)[?#].*\z", "").alias("location"))
    site = F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0)
    routes = F.array(*[join_url(site, F.lit(r)) for r in ("en/", "sitemap.xml")])
    return diff.append_absent(base, pages.select(F.explode(routes).alias("location")), ["location"])


@query(
    "url_parts",
    r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '[?#].*$', 0) AS tail FROM pages""",
)
def url_parts(spark, sf):
    from quirelens.functions.urls import link_tail

    return table(spark, sf, "pages").select(
        "page_id", host("url").alias("host"), url_path("url").alias("path"), link_tail("url").alias("tail")
    )


def _menus(spark, sf):
    """Each page's links as a markdown list of relative links."""
    href = F.regexp_replace("target", "^/+", "")
    item = F.concat(F.lit("- [link "), F.col("link_no").cast("string"), F.lit("](../nav/"), href, F.lit("?v=1#top)"))
    # A page's own links fit in one value, as the page does.
    lists = extract_links(table(spark, sf, "pages")).groupBy("page_id").agg(
        F.array_sort(F.array_agg(F.struct("link_no", item.alias("item")))).alias("items")
    )
    text = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    return table(spark, sf, "pages").select("page_id").join(lists, "page_id", "left").select(
        "page_id", F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("source"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


@query(
    "link_rewrite",
    rf"""WITH {LINKS_SQL},
    named AS (SELECT *, regexp_replace(ltrim(target, '/'), '[,.]+$', '') AS word FROM links),
    often AS (SELECT word FROM named GROUP BY word HAVING count(*) > 3),
    new AS (SELECT page_id, link_no, '- [link ' || link_no || '](' || CASE WHEN word IN (SELECT word FROM often)
        THEN '../pub/' || word || '.html' WHEN word LIKE 't%' THEN 'https://data.example.org/nav/' || word
        ELSE 'https://code.example.org/blob/nav/' || word END || '?v=1#top)' AS item FROM named)
    SELECT page_id, 'site/p' || page_id || '.md' AS source,
      coalesce((SELECT string_agg(item, chr(10) ORDER BY link_no) FROM new n WHERE n.page_id = p.page_id), '') AS text
    FROM pages p""",
)
def link_rewrite(spark, sf):
    menus = _menus(spark, sf)
    words = menus.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\(\.\./nav/([^?)]*)\?"), F.lit(1))).alias("href")
    ).select("href", F.regexp_replace("href", r"[,.]+\z", "").alias("word"))
    nav = F.concat(F.lit("nav/"), F.col("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    link_map = often.select(nav.alias("path"), F.concat(F.lit("pub/"), F.col("word"), F.lit(".html")).alias("published"))
    aliases = words.filter("href <> word").distinct().select(
        F.concat(F.lit("nav/"), F.col("href")).alias("old_key"), nav.alias("new_key")
    )
    return links.rewrite_links(
        menus, link_map, "https://code.example.org/blob/", "page_id", home="site", aliases=aliases,
        bases=[("^nav/t", "https://data.example.org/")],
    )


@query(
    "md_rows",
    rf"""WITH {LINKS_SQL} SELECT page_id, target, '| [' || link_no || '](' || target || ') | ' || page_id || ' |' AS row
    FROM links WHERE target <> '' AND NOT contains(target, ')') AND NOT contains(target, chr(10)) AND NOT contains(target, chr(13))""",
)
def md_rows(spark, sf):
    line = F.concat(
        F.lit("| ["), F.col("link_no").cast("string"), F.lit("]("), F.col("target"), F.lit(") | "), F.col("page_id").cast("string"), F.lit(" |")
    )
    plain = extract_links(table(spark, sf, "pages")).filter("not rlike(target, '[)\\r\\n]')")
    doc = plain.groupBy("page_id").agg(F.concat(F.lit("| page | id |\n| --- | --- |\n"), F.array_join(F.array_agg(line), "\n")).alias("text"))
    return parse_md_rows(doc, "text", "page_id")


@query(
    "tree_listing",
    f"""WITH {LINKS_SQL} SELECT page_id, '100644' AS mode, 'blob' AS type, sha1(target) AS oid, target AS path FROM links""",
)
def tree_listing(spark, sf):
    found = extract_links(table(spark, sf, "pages"))
    record = F.concat(F.lit("100644 blob "), F.sha1("target"), F.lit("\t"), F.col("target"))
    # A page's own links fit in one value, as a listing does.
    listing = found.groupBy("page_id").agg(F.array_join(F.array_agg(record), "\x00").alias("listing"))
    return parse_tree_listing(listing, "listing", "page_id")


SAFETY_ROWS = "\n UNION ALL ".join(
    f"SELECT path, '{p}' AS rule FROM p WHERE regexp_matches(path, '(?i){p}')" for p in safety.FORBIDDEN_PATTERNS
)
SUFFIX_LIST = ", ".join(f"'{s}'" for s in safety.ALLOWED_SUFFIXES)


@query(
    "publication_safety",
    rf"""WITH p AS (
      SELECT CASE WHEN f = '' OR f LIKE '%/' THEN f || 'index.html' ELSE f END AS path FROM (
        SELECT ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/') AS f FROM pages)
      UNION ALL
      SELECT source || '/' || doc_id || CASE WHEN n_chars < 200 THEN '/Secrets.JSON' WHEN lang = 'en' THEN '.html'
        WHEN lang = 'fr' THEN '.pyc' WHEN lang = 'de' THEN '/.env.local' ELSE '/dump.sqlite3' END FROM documents)
    SELECT path, 'extension' AS rule FROM p
    WHERE lower(regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1)) NOT IN ({SUFFIX_LIST})
    UNION ALL {SAFETY_ROWS}""",
)
def publication_safety(spark, sf):
    docs = table(spark, sf, "documents")
    end = (
        F.when(F.col("n_chars") < 200, "/Secrets.JSON").when(F.col("lang") == "en", ".html")
        .when(F.col("lang") == "fr", ".pyc").when(F.col("lang") == "de", "/.env.local").otherwise("/dump.sqlite3")
    )
    paths = table(spark, sf, "pages").select(page_file("url").alias("path")).unionByName(
        docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"))
    )
    return safety.safety_violations(paths)


@query("sitemap_read", "SELECT url AS location FROM pages")
def sitemap_read(spark, sf):
    """Write the pages as a sitemap and read its locations."""
    path = scratch_path(spark)
    urls = table(spark, sf, "pages").select(F.col("url").alias("loc"))
    urls.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return read_locations(spark, path)


@query(
    "case_report",
    """SELECT 'conv/' || conv_id || '.py::' || turn || ' ' || role AS node, role = 'system' AS not_passed FROM conversations""",
)
def case_report(spark, sf):
    """Write turns as a test report, system turns failed, and read its cases."""
    path = scratch_path(spark)
    cases = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv."), F.col("conv_id").cast("string")).alias("_classname"),
        F.concat_ws(" ", F.col("turn").cast("string"), "role").alias("_name"),
        F.when(F.col("role") == "system", F.array(F.lit("failed"))).alias("failure"),
    )
    cases.write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").save(path)
    return read_cases(spark, path)
