import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quirelens.operators import diff, review

H = "a" * 64


def test_snapshot_diff(frame):
    old = frame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "k string, h string")
    new = frame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "k string, h string")
    got = rows(diff.snapshot_diff(old, new, ["k"], "h"), "k", "status")
    assert got == [("a", "equal"), ("b", "changed"), ("c", "equal"), ("d", "removed"), ("e", "added")]


def test_freshness(frame):
    want = frame([("a", "x"), ("b", "yy"), ("c", "z")], "p string, t string")
    have = frame([("a", "x"), ("b", "yyy")], "p string, t string")
    assert rows(diff.freshness(want, have, ["p"], "t")) == [("b", "stale", 2, 3), ("c", "missing", 1, None)]


def test_manifest_faults_are_told_apart(frame):
    declared = frame(
        [("ok", H), ("gone", H), ("bad", "xyz"), ("diff", "b" * 64), ("../up", H), ("nul", None)], "path string, sha256 string"
    )
    actual = frame([("ok", H), ("diff", H), ("bad", H), ("nul", H)], "path string, sha256 string")
    assert dict(rows(diff.verify_manifest(declared, actual), "path", "status")) == {
        "ok": "ok", "gone": "missing file", "bad": "malformed hash", "diff": "mismatch", "../up": "unsafe path", "nul": "malformed hash",
    }
    assert rows(diff.verify_manifest(declared.limit(0), actual), "path", "status") == [(None, "empty manifest")]


def test_identity_binding(frame):
    artifact = frame([("c1", "t1", "i1")], "commit string, tree string, ir string")
    manifests = frame([("p", "c1", "t1", "i1"), ("q", "c1", "t2", None)], "name string, commit string, tree string, ir string")
    got = rows(diff.same_identity(manifests, artifact, ["commit", "tree", "ir"]), "name", "bound", "differs")
    assert got == [("p", True, []), ("q", False, ["tree", "ir"])]


def test_fingerprint_ignores_order_and_sees_every_change(frame):
    base = frame([("g", "x"), ("g", "y"), ("k", "z")], "g string, v string").withColumn("h", F.sha2("v", 256))
    shuffled = base.orderBy(F.desc("v"))
    twice = base.union(base)
    other = base.filter("v <> 'y'").union(frame([("g", "Y")], "g string, v string").withColumn("h", F.sha2("v", 256)))

    def prints(df, **kw):
        return dict(rows(diff.fingerprint(df, ["g"], "h", **kw), "g", "fingerprint"))

    assert prints(base) == prints(shuffled) == prints(twice)
    assert prints(base, bag=True) != prints(twice, bag=True)
    assert prints(base)["g"] != prints(other)["g"] and prints(base)["k"] == prints(other)["k"]


def test_reconcile(frame):
    plan = frame([("a",), ("b",), ("c",), ("c",), ("e",)], "node string")
    done = frame([("a", False), ("b", True), ("c", False), ("c", False), ("d", False), ("e", False), ("e", False)], "node string, not_passed boolean")
    assert dict(rows(diff.reconcile(plan, done, "node"), "node", "problem")) == {
        "b": "not passed", "c": "planned twice", "d": "unplanned", "e": "count differs",
    }
    assert rows(diff.reconcile(plan.filter("node = 'a'"), done.filter("node = 'a'"), "node")) == []
    assert rows(diff.reconcile(plan.limit(0), done.limit(0), "node"), "problem") == [("empty plan",)]


def test_sets(frame):
    a, b = frame([(1,), (2,), (2,)], "k int"), frame([(2,), (3,)], "k int")
    assert rows(diff.set_diff(a, b, ["k"])) == [(1, "left"), (3, "right")]
    assert rows(diff.append_absent(b, a, ["k"])) == [(1,), (2,), (3,)]
    assert rows(diff.union_distinct(a, b)) == [(1,), (2,), (3,)]
    assert diff.not_subset(b.filter("k = 2"), a, ["k"]).isEmpty()


def test_size_guard_boundary(frame):
    def guard(n, extra=()):
        return diff.size_guard(frame([(f"p{i}",) for i in range(n)], "p string"), frame([("p0",), *extra], "p string"), "p", 1000, ["^(src|docs)/"])

    assert rows(guard(1000)) == [(1000, 0, True)]
    assert rows(guard(1001)) == [(1001, 0, False)]
    assert rows(guard(5, [("src/x",)])) == [(6, 1, False)]


TEXTS = [
    "alpha beta gamma delta epsilon", "src/repo/catalog.py is here", "ab", "a", "", "beta gamma delta", "catalog",
    "xx src/repo/catalog.pyc yy", "日本語のテキスト src", "tail alpha beta gamma deltas",
]
NEEDLES = [
    "beta gamma delta", "alpha beta gamma delta", "src/repo/catalog.py", "ab", "a", "log.py", "catalog", "日本", "nope", "no such run of words here",
    "gamma delta", "é",
]


def test_text_dependents_equal_brute_force(frame):
    s = frame([(i, n) for i, n in enumerate(NEEDLES)], "sid int, name string")
    p = frame([(i, t) for i, t in enumerate(TEXTS)], "pid int, body string")
    want = sorted((i, j) for i, n in enumerate(NEEDLES) for j, t in enumerate(TEXTS) if n in t)
    got = review.text_dependents(s, p, "sid", "name", "pid", "body")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_anchor_is_what_fewest_sources_share(frame):
    names = [f"src/administration/{w}/main.py" for w in ("aa", "bb", "cc")]
    got = review._anchors(frame([(i, n) for i, n in enumerate(names)], "sid int, name string"), "sid", "name")
    assert len({r["mark"] for r in got.collect()}) == 3


def test_random_texts_equal_brute_force(frame):
    r = random.Random(11)

    def text(n, alphabet="ab .\né"):
        return "".join(r.choice(alphabet) for _ in range(n))

    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(6)]
    prose = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(60)]
    texts = [text(r.randrange(0, 30)) for _ in range(60)] + prose
    needles = [text(r.randrange(0, 12)) for _ in range(60)]
    for t in prose:
        i = r.randrange(0, max(1, len(t)))
        needles.append(t[i : i + r.randrange(1, 40)])
    s = frame(list(enumerate(needles)), "sid int, name string")
    p = frame(list(enumerate(texts)), "pid int, body string")
    want = sorted((i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n and n in t)
    assert sorted(tuple(x) for x in review.text_dependents(s, p, "sid", "name", "pid", "body").collect()) == want


def test_no_sources_touch_nothing(frame):
    s, p = frame([], "sid int, name string"), frame([(1, "x")], "pid int, body string")
    assert review.text_dependents(s, p, "sid", "name", "pid", "body").count() == 0


PAGES = [("site/architecture/x.md", "see docs/odd.txt"), ("site/schema/y.md", ""), ("site/development/index.md", "scripts/a.py")]
RULES = [
    review.Rule("design", lambda: F.col("source").rlike("^(src|docs/adr)/"), lambda: F.col("page").contains("/architecture/")),
    review.Rule("scripts", lambda: F.col("source").startswith("scripts/"), lambda: F.col("page").contains("/schema/")),
]


def impact(frame, *sources):
    s = frame([(x,) for x in sources], "source string")
    return review.rule_dependents(s, frame(PAGES, "page string, text string"), RULES)


def test_rules_text_and_fallback(frame):
    pages = frame([(p,) for p, _ in PAGES], "page string")
    got = impact(frame, "src/core.py", "scripts/a.py", "docs/odd.txt")
    assert rows(got.reasons(pages)) == [
        ("site/architecture/x.md", "Changed source: docs/odd.txt"), ("site/architecture/x.md", "Changed source: src/core.py"),
        ("site/development/index.md", "Changed source: scripts/a.py"), ("site/schema/y.md", "Changed source: scripts/a.py"),
    ]
    everything = impact(frame, "unknown.bin", "src/core.py")
    assert rows(everything.counts()) == [
        ("site/architecture/x.md", 2, "src/core.py"), ("site/development/index.md", 1, "unknown.bin"), ("site/schema/y.md", 1, "unknown.bin"),
    ]
    assert (None, "Changed source: unknown.bin") in rows(everything.reasons(pages))


def test_pending_review(frame):
    pending = frame([("a", "r1"), ("b", "r1"), ("b", "r2")], "page string, reason string")
    new = frame([("b", "r3"), ("c", "r1"), ("a", "r1")], "page string, reason string")
    got = review.update_pending(pending, frame([("b",)], "page string"), new)
    assert rows(got) == [("a", "r1"), ("b", "r3"), ("c", "r1")]
    with pytest.raises(ValueError, match="Not a previously pending"):
        review.update_pending(pending, frame([("zzz",)], "page string"), new)


STATE = "part string, inputs string, renderer string, generated string, ir_sha256 string"


def test_refresh_plan(frame):
    saved = frame([(p, "i", "r", "g", "x") for p in "abcdef"], STATE)
    now = frame(
        [("a", "i", "r", "g", "x", True), ("b", "i2", "r", "g", "x", True), ("c", "i", "r2", "g", "x", True),
         ("d", "i", "r", "g2", "x", True), ("e", "i", "r", "g", "x2", True), ("f", "i", "r", "g", "x", False), ("n", "i", "r", "g", "x", True)],
        STATE + ", cache_valid boolean",
    )
    plan = review.plan_refresh(now, saved)
    assert rows(plan) == [
        ("a", "recorded", False, False, False), ("b", "recorded", True, False, True), ("c", "recorded", True, True, True),
        ("d", "recorded", True, True, True), ("e", "recorded", False, True, False), ("f", "recorded", True, False, True),
        ("n", "unassessed", True, True, True),
    ]
    status = review.review_status(plan, frame([("a",), ("b",)], "part string"))
    assert rows(status.filter("part in ('a', 'b')"), "part", "status") == [("a", "review-needed"), ("b", "updated")]
    assert {r[1] for r in rows(review.plan_refresh(now, None))} == {"unassessed"}


def test_cache_validity(frame):
    checks = frame([("a", "ok"), ("a", "mismatch"), ("b", "ok")], "part string, status string")
    assert rows(review.cache_valid(checks)) == [("a", False), ("b", True)]


def test_nulls_equal_themselves(frame):
    old = frame([(None, "h"), (1, None), (2, "x")], "k int, h string")
    new = frame([(None, "h"), (1, None), (3, "x")], "k int, h string")
    got = {(r["k"], r["status"]) for r in diff.snapshot_diff(old, new, ["k"], "h").collect()}
    assert got == {(None, "equal"), (1, "equal"), (2, "removed"), (3, "added")}
    assert rows(diff.set_diff(old, new, ["k"])) == [(2, "left"), (3, "right")]
    assert rows(diff.freshness(old.filter("k = 1"), old.filter("k = 1").withColumn("h", F.lit("y")), ["k"], "h"), "status") == [("stale",)]
