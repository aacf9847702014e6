from conftest import rows
from quirelens.functions import paths, urls
from quirelens.operators import links
from quirelens.sources.markup import extract_links

HOME = "https://a.org/docs/guide/"


def site(frame, body, extra=()):
    pages = [(1, HOME, body), (2, "https://a.org/docs/api.html", ""), (3, "https://a.org/top/", ""), (4, "https://b.org/only", "")]
    return frame(pages + list(extra), "page_id long, url string, html string")


def broken(frame, body, extra=()):
    return [t for (t,) in rows(links.link_audit(site(frame, body, extra)), "target")]


def test_links_that_resolve(frame):
    good = [
        "/docs/api.html", "../api.html", "/docs/guide/", "/docs/guide", "./", "../../top/", "/top", "top/",
        "../api.html?x=1#y", "\n\t../api.html ", "/docs/%61pi.html", "index.html",
    ]
    body = "".join(f'<a href="{g}">x</a>' for g in good)
    assert broken(frame, body) == []


def test_one_broken_link_until_it_exists(frame):
    body = '<p><a class="x" href="missing.html">m</a></p>'
    assert broken(frame, body) == ["missing.html"]
    assert broken(frame, body, [(5, "https://a.org/docs/guide/missing.html", "")]) == []


def test_other_hosts_do_not_count(frame):
    assert broken(frame, '<a href="/only">x</a>') == ["/only"]


def test_ignored_links(frame):
    skip = ["http://x", "https://x", "//x/y", "mailto:a@b", "javascript:void(0)", "#top", "", "  ", "?q=1", "\n https://x \t"]
    assert broken(frame, "".join(f'<a href="{s}">x</a>' for s in skip)) == []


def test_script_style_and_comment_text_is_no_link(frame):
    body = """<script>let t = `<a href="${x}">`;</script><style>a[href="z"]{}</style><!-- <a href="gone"> -->
    <a title="a > b href='fake'" HREF='real.html'>x</a><link href=bare.css>"""
    got = rows(extract_links(site(frame, body)), "page_id", "link_no", "target")
    assert got == [(1, 0, "real.html"), (1, 1, "bare.css")]


def test_entities_and_escapes_decode_once(frame):
    df = frame([("a&amp;lt;b",), ("x%2520y",), ("1+1%",), ("%C3%A8",)], "t string")
    assert [r[0] for r in df.select(urls.decode_entities("t")).collect()][0] == "a&lt;b"
    assert [r[0] for r in df.select(urls.percent_decode("t")).collect()][1:] == ["x%20y", "1+1%", "è"]


def test_link_path_strips_all_but_the_path(frame):
    df = frame([("/a;p=1?q#f",), ("tel:123",), (" b/c ",), ("ftp://h/p",)], "t string")
    assert [r[0] for r in df.select(urls.link_path("t")).collect()] == ["/a", "123", "b/c", "/p"]


def test_links_climbing_above_the_root_stay_in_the_site(frame):
    assert broken(frame, '<a href="../../../../top/">x</a>') == []


def test_paths_follow_posix(frame):
    import posixpath

    cases = ["", "a", "a/b/", "./a", "a/../b", "../a", "../../x", "/a/../../b", "//a//b", "///a", "/", "a/./b", "a/b/../../..", "/."]
    df = frame([(c,) for c in cases], "p string")
    for r in df.select("p", paths.normalize_path("p").alias("n"), paths.dirname("p").alias("d")).collect():
        assert (r.n, r.d) == (posixpath.normpath(r.p), posixpath.dirname(r.p))
    pairs = [("a/b", "a"), ("a", "a/b"), ("a/x/y", "a/z"), ("a", "a"), ("x", "."), ("a/b/c", "a/b/d/e")]
    df = frame(pairs, "t string, s string")
    for r in df.select("t", "s", paths.relative_path("t", "s").alias("r")).collect():
        assert r.r == posixpath.relpath(r.t, r.s)


def test_random_paths_follow_posix(frame):
    import posixpath
    import random

    r = random.Random(5)
    paths_ = ["".join(r.choice(["a", "b", "/", ".", "..", "//", "./"]) for _ in range(r.randrange(0, 9))) for _ in range(400)]
    for row in frame([(p,) for p in paths_], "p string").select("p", paths.normalize_path("p").alias("n"), paths.dirname("p").alias("d")).collect():
        assert (row.n, row.d) == (posixpath.normpath(row.p), posixpath.dirname(row.p)), row.p


def test_suffixes(frame):
    names = {"a/b.HTML": ".html", ".env": "", ".env.local": ".local", "x.tar.gz": ".gz", "a.b/c": "", "end.": ""}
    df = frame([(n,) for n in names], "p string")
    assert dict(df.select("p", paths.suffix("p")).collect()) == names


def test_globs(frame):
    cases = [
        ("site/**", "site/a/b.md", True), ("site/**", "site", True), ("site/**", "sit", False),
        ("*.md", "a.md", True), ("*.md", "a/b.md", False), ("**/x.py", "a/b/x.py", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ]
    for glob, path, want in cases:
        assert frame([(path,)], "p string").select(paths.matches_glob("p", glob)).first()[0] is want, (glob, path)


def test_rewriting(frame):
    text = (
        "[sib](beta.md#two) [up](../plan.txt) ![chart](c.webp) [web](https://q.net/z) [root](/home) [here](#h) [was](../past.md?k=2)"
    )
    docs = frame([(1, "notes/log/alpha.md", text), (2, "notes/log/none.md", "plain words")], "doc_id long, source string, text string")
    published = frame([("notes/log/beta.md", "log/beta.md"), ("notes/now.md", "log/now.md")], "path string, published string")
    aliases = frame([("notes/past.md", "notes/now.md")], "old_key string, new_key string")
    out = dict(links.rewrite_links(docs, published, "https://g/tree/", home="log", aliases=aliases).select("doc_id", "text").collect())
    assert out[2] == "plain words"
    assert out[1] == (
        "[sib](beta.md#two) [up](https://g/tree/notes/plan.txt) ![chart](https://g/tree/notes/log/c.webp) "
        "[web](https://q.net/z) [root](/home) [here](#h) [was](now.md?k=2)"
    )


def test_routes_of_an_index_page(frame):
    got = rows(links.page_routes(frame([("https://A.org/",), ("https://a.org/x/index.html",)], "url string")))
    assert got == [("a.org", "", True), ("a.org", "index.html", False), ("a.org", "x", True), ("a.org", "x/index.html", False)]


def test_publication_safety(frame):
    from quirelens.operators.safety import ALLOWED_SUFFIXES, FORBIDDEN_PATTERNS, safety_violations

    safe = [f"part{i}/Leaf{i}{s}" for i, s in enumerate(ALLOWED_SUFFIXES)]
    assert safety_violations(frame([(s,) for s in safe], "path string")).count() == 0
    bad = ["notes.parquet", "a/run.bat", "shelf/credential.txt", "SECRETS.json", "lemon"]
    found = rows(safety_violations(frame([(b,) for b in bad], "path string")))
    assert {p for p, _ in found} == set(bad)
    assert [r for p, r in found if p == "lemon"] == ["extension"]
    assert {r for p, r in found if p == "SECRETS.json"} == {x for x in FORBIDDEN_PATTERNS if "secret" in x}
    odd = frame([("b/TOKENS.txt",), ("b/nottoken.txt",)], "path string")
    assert {p for (p,) in rows(safety_violations(odd), "path")} == {"b/TOKENS.txt"}


def hrefs(frame, body):
    return [t for (_, t) in rows(extract_links(site(frame, body)).filter("page_id = 1"), "link_no", "target")]


def test_links_as_a_parser_sees_them(frame):
    cases = [
        ('<script>var x = "<!--";</script><a href="kept">', ["kept"]),
        ('<a href="one"><script>if (a) b("<a href=no>");', ["one"]),
        ('<!-- <script> --><a href="two"><!-- </script> -->', ["two"]),
        ('<a href="three"><!-- open <a href="gone">', ["three"]),
        ('<STYLE>a{}</STYLE ><a HREF=four>', ["four"]),
        ('<script data-x="a>b">"<a href=no>"</script><a href="five">', ["five"]),
        ("<a href='six\"x'><a title='>' href=\"seven'y\">", ['six"x', "seven'y"]),
        ('<a href="a&#47;b&#x2F;c&eacute;&amp;lt;&nosuch;">', ["a/b/c\u00e9&lt;&nosuch;"]),
        ('<a href="?a=1&copy=2&amp=3&lt;">', ["?a=1&copy=2&amp=3<"]),
        ('<a href="&#0;&#128;&#xD800;&#x110000;&#9999999999;&notin;">', ["\ufffd\u20ac\ufffd\ufffd\ufffd\u2209"]),
    ]
    for body, want in cases:
        assert hrefs(frame, body) == want, body


def test_a_broken_link_after_a_script_is_found(frame):
    assert broken(frame, '<script>s = "<!--"</script><a href="lost.html">x</a><!-- end -->') == ["lost.html"]


def test_several_bases_and_a_moved_prefix(frame):
    text = "[a](data/x.csv) [b](lib/y.py) [c](/old/page) [d](/older) [e](https://h/old/z?q#f)"
    docs = frame([(1, "w/doc.md", text)], "doc_id long, source string, text string")
    none = frame([], "path string, published string")
    out = links.rewrite_links(docs, none, "https://code/", bases=[("[.]csv$", "https://data/")], moved_prefix=("/old/", "/new/"))
    assert out.first()["text"] == "[a](https://data/w/data/x.csv) [b](https://code/w/lib/y.py) [c](/new/page) [d](/older) [e](https://h/old/z?q#f)"
    moved = links.rewrite_links(docs, none, "https://code/", moved_prefix=("https://h/old/", "https://h/"))
    assert "[e](https://h/z?q#f)" in moved.first()["text"]
