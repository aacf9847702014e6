"""Mixing, exact duplicates, URL filters and pseudonyms against plain versions."""

import datetime
import hashlib
import random
import re

import pytest

import brute
from quirelens.llm import exact, mixing, pii, urls
from quirelens.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_mixing", "op8_exact_dedup", "op9_pii", "op10_url_filter"])
def test_native_plans_hold_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# ---- mixing ----


def test_mixing_equals_plain(spark):
    docs = brute.corpus()
    got = mixing.mix(spark.createDataFrame(docs, DOCS))
    want = brute.mix([(d, s, t) for d, t, _, s, _ in docs], mixing.offset_of(mixing.SEED))
    rows = got.select("doc_id", "source", "size", "copies").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    aim = {r["source"]: r["target"] for r in got.collect()}
    sizes = {r["source"]: r["source_size"] for r in got.collect()}
    assert aim == pytest.approx(brute.targets(sizes))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got.collect())


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 1, "b": 1000, "c": 3}, {"a": 10, "b": 10, "c": 10, "d": 2, None: 7}, {"a": 0, "b": 0}])
def test_targets_share_out_the_excess(spark, sizes):
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id bigint, source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sized, 1.5, (3, 1, 2), 2.0).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(1)
    docs = [(i, brute.prose(rng, rng.randrange(1, 60)), "en", f"s{i % 3}", 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 120


def test_mixing_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    same = [(1, "a b c", "en", "s", 1)] * 4
    got = mixing.mix(spark.createDataFrame(same, DOCS))
    assert sum(r["copies"] for r in got.collect()) in (5, 6, 7)
    extra = spark.createDataFrame([(None, None, None, None, None, 7, "x")], DOCS + ", size int, target string")
    assert [tuple(r) for r in mixing.mix(extra).collect()] == [(None, None, 0, 0, 0.0, 0, 0)]
    with pytest.raises(ValueError):
        mixing.mix(extra, cycle=())


# ---- exact duplicates ----


@pytest.mark.parametrize("block,bits", [(4, 64), (4, 3), (2048, 64), (16, 1)])
def test_exact_duplicates_equal_plain(spark, block, bits):
    docs = brute.corpus() + [(100, "x" * 37, "en", "a", 1), (101, "x" * 37, "en", "a", 1), (102, "x" * 36, "en", "a", 1), (103, "abcdabcd", "", "", 1), (104, "abcdabcdabcd", "", "", 1), (5, "w1", "", "", 1)]
    got = exact.exact_duplicates(spark.createDataFrame(docs, DOCS), block, bits).collect()
    groups = {}
    for d, t, *_ in docs:
        groups.setdefault(t or "", []).append(d)
    want = [(d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in docs]
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_duplicates_odd_tables(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(3, "a", 1), (3, "a", 2), (None, "a", 3), (None, "b", 4), (None, "b", 5)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, name int")).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 2, True), (None, None, 2, True)], key=repr
    )


# ---- URL filters ----

CASES = [
    ("http://A.Example.COM/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://x.www.example.com/en/1?q", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://com", "com", "", None, "allow"),
    ("http://a.net/es/?x", "a.net", "/es/", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, None),
    ("ftp://b.org?x=://c.net/es/", "b.org", "", None, "allow"),
    ("no scheme/x", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b.org#/x", "b.org", "", None, "allow"),
    ("a\n://b.org/\u00c4/x\ny", "b.org", "/\u00c4/x\ny", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(CASES)], "page_id bigint, url string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict is None or got[i]["verdict"] == verdict


def verdicts(spark, rules, rows):
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string"), rules).collect()
    return {r["host"] + r["path"]: (r["template"], r["verdict"], r["rule"]) for r in got}


def test_templates_and_purity(spark):
    rules = [("block", "h.org/bad/"), ("allow", "h.org/good/"), ("block", "all.org/x/")]
    rows = [f"http://h.org/{k}/{i}" for k in ("bad", "good", "new") for i in range(30)]
    rows += [f"http://all.org/x/{i}" for i in range(30)] + [f"http://all.org/y/{i}" for i in range(10)] + ["http://free.org/a/b"]
    got = verdicts(spark, rules, rows)
    assert got["h.org/bad/3"][:2] == ("/bad/*", "block") and got["h.org/good/3"][:2] == ("/good/*", "allow")
    assert got["h.org/new/3"][:2] == ("/new/**", "allow")
    # All that is known of the host is bad, but nothing is known of this branch.
    assert got["all.org/x/3"][:2] == ("/x/*", "block") and got["all.org/y/3"][:2] == ("/y/**", "allow")
    assert got["free.org/a/b"][:2] == ("/a/b", "allow")


@pytest.mark.parametrize("more", [0, 60])
def test_siblings_change_no_verdict(spark, more):
    rules = [("block", "h.org/es/"), ("block", "h.org/item/1/ads/"), ("allow", "h.org/item/1/ok/")]
    rows = [f"http://h.org/es/{i}" for i in range(40)] + [f"http://h.org/ok/{i}" for i in range(40)] + [f"http://h.org/w{'abc'[i % 3]}{'x' * i}" for i in range(more)]
    rows += [f"http://h.org/item/1/{k}/p{'x' * i}" for k in ("ads", "ok") for i in range(30)] + [f"http://h.org/item/{n}/{k}/q" for n in (2, 3) for k in ("ads", "ok", "other")]
    got = verdicts(spark, rules, rows)
    assert {v for u, (_, v, _) in got.items() if u.startswith("h.org/ok/")} == {"allow"}
    assert {v for u, (_, v, _) in got.items() if u.startswith("h.org/es/")} == {"block"}
    # What is known of one item holds for others of the template, and for nothing else.
    assert got["h.org/item/2/ok/q"][1] == "allow"
    assert got["h.org/item/3/other/q"][:2] == ("/item/*/other/**", "allow")


def test_a_blocked_fifth_segment(spark):
    rules = [("block", "h.org/a/b/c/1/bad/"), ("allow", "h.org/a/b/c/1/ok/")]
    rows = [f"http://h.org/a/b/c/1/{k}/{i}" for k in ("bad", "ok") for i in range(40)]
    rows += [f"http://h.org/a/b/c/{n}/{k}/{i}" for n in (2, 77) for k in ("bad", "ok", "new") for i in range(20)]
    got = verdicts(spark, rules, rows)
    for n in (2, 77):
        assert {got[f"h.org/a/b/c/{n}/bad/{i}"] for i in range(20)} == {("/a/b/c/*/bad/*", "block", None)}
        assert {got[f"h.org/a/b/c/{n}/ok/{i}"] for i in range(20)} == {("/a/b/c/*/ok/*", "allow", None)}
        assert {got[f"h.org/a/b/c/{n}/new/{i}"] for i in range(20)} == {("/a/b/c/*/new/**", "allow", None)}


def test_rare_segments_that_vary_make_one_template(spark):
    """Slugs of a page each: those of one blocked kind say what the others of the node are."""
    rules = [("block", f"h.org/blog/{c}{d}") for c in "abcdefgh" for d in "abcdefgh"]
    rows = [f"http://h.org/blog/{c}{d}-slug" for c in "abcdefgh" for d in "abcdefgh"] + [f"http://h.org/blog/{c}-title" for c in "nopqrstuvw"]
    got = verdicts(spark, rules, rows)
    assert got["h.org/blog/n-title"] == ("/blog/*", "block", None)
    few = verdicts(spark, rules[:4], rows[:4] + rows[-4:])
    assert few["h.org/blog/w-title"] == ("/blog/w-title/**", "allow", None)


def test_urls_odd_tables(spark):
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []
    rows = [(None, "http://a.com/x", "h", 1), (1, "http://a.com/x", "h", 2), (1, "http://a.com/x", "h", 2)]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, n int")).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"}


@pytest.mark.parametrize("name", ["op4_mixing", "op8_exact_dedup", "op10_url_filter", "op1_top_k", "op7_warc"])
def test_queries_have_sql(name):
    assert name in ORACLES and name in QUERIES


# ---- pseudonyms ----


def luhn(digits):
    odd = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(odd)) % 10 == 0


def card(body):
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def pseudonyms(spark, texts, key=pii.KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return [tuple(r) for r in pii.pseudonymize(df, key).orderBy("doc_id").select("text", "found").collect()]


def test_formats_stay_and_values_stay_linked(spark):
    number = card("453201511283036")
    spaced = " ".join(number[i : i + 4] for i in range(0, 16, 4))
    texts = [
        f"a {number} b {number}, and {spaced}.", f"{number}", "mail jo.Doe7@mail7.example.com now", "+1 (974) 555-3436!!", "at 235.58.234.215, yes",
        "ssn 078-05-1120", "born 1984-02-29 and 31.12.1999, 02/28/2001", f"no {int(number) + 1} 999.1.1.1 2023-02-30 000-12-3456 3.14 12:30",
    ]
    got = pseudonyms(spark, texts)
    found = re.findall(r"\d{16}", got[0][0])
    assert len(found) == 2 and found[0] == found[1] == got[1][0] != number and luhn(found[0])
    assert re.search(r"\d{4} \d{4} \d{4} \d{4}\.$", got[0][0]).group()[:-1].replace(" ", "") == found[0]
    assert got[0][1] == {"card": 3} and got[1][1] == {"card": 1}
    assert re.fullmatch(r"mail [a-z]{2}\.[A-Z][a-z]{2}\d@mail7\.example\.com now", got[2][0]) and got[2][0] != texts[2]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}!!", got[3][0]) and got[3][0] != texts[3]
    address = re.fullmatch(r"at ([\d.]+), yes", got[4][0]).group(1)
    assert all(0 <= int(x) < 256 for x in address.split(".")) and len(address.split(".")) == 4
    area, group, serial = re.fullmatch(r"ssn (\d{3})-(\d{2})-(\d{4})", got[5][0]).groups()
    assert 0 < int(area) < 900 and int(area) != 666 and int(group) and int(serial)
    a, b, c = re.fullmatch(r"born (\S+) and (\S+), (\S+)", got[6][0]).groups()
    assert datetime.date.fromisoformat(a).strftime("%m-%d") == "02-29"
    for text, form in ((b, "%d.%m.%Y"), (c, "%m/%d/%Y")):
        assert 1900 <= datetime.datetime.strptime(text, form).year < 2100
    assert got[6][1] == {"date": 3}
    assert got[7] == (texts[7], {})


def test_pseudonyms_are_permutations(spark):
    dates = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=37 * i)).isoformat() for i in range(1900)]
    leaps = [f"{y}-02-29" for y in range(1904, 2100, 4)]
    phones = [f"+49 30 {i:04d} 1234" for i in range(900)]
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in range(1, 60)]
    cards = [card(f"{i:015d}") for i in range(1, 900)]
    for values in (dates, leaps, phones, numbers, cards):
        values = sorted(set(values))
        out = [t for t, _ in pseudonyms(spark, values)]
        assert len(set(out)) == len(values)
        assert sum(a == b for a, b in zip(out, values)) <= max(3, len(values) // 20)
        assert out != [t for t, _ in pseudonyms(spark, values, "another key")]


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_cards(text):
    """Spans of card numbers, by going through the groups of each run of digits."""
    out = []
    for run in re.finditer(pii.CARD, text):
        groups = [m.span() for m in re.finditer("[0-9]+", run.group())]
        i = 0
        while i < len(groups):
            for j in reversed(range(i, len(groups))):
                span = (run.start() + groups[i][0], run.start() + groups[j][1])
                digits = re.sub("[^0-9]", "", text[slice(*span)])
                laid_out = re.search(pii.LAYOUT, text[slice(*span)]) or span == run.span()
                if laid_out and 13 <= len(digits) <= 19 and set(digits) != {"0"} and plain_luhn(digits):
                    out.append(span)
                    i = j
                    break
            i += 1
    return out


def test_cards_are_found_among_other_digits(spark):
    rng = random.Random(3)
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{card} 123", f"x {card} 1227 123", " ".join(card.replace(" ", "")), f"{card} 5500 0000 0000 0004", f"12 {card}",
             "4111111111111111 123", "9" * 40, "0000 0000 0000 0000", f"{card.replace(' ', '')}9"]
    for _ in range(60):
        groups = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(2, 9))]
        if rng.random() < 0.6:
            groups.insert(rng.randrange(len(groups)), rng.choice([card, "5500000000000004", "3400-000000-00009"]))
        texts.append("no " + rng.choice([" ", "-"]).join(groups) + ".")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)).collect()}
    hits = 0
    for i, text in enumerate(texts):
        spans = plain_cards(text)
        inside = {p for a, b in spans for p in range(a, b)}
        if re.search(pii.PHONE, text) or re.search(pii.SSN, text) or re.search(pii.DATE, text):
            continue
        hits += len(spans)
        assert len(got[i]) == len(text)
        assert all(got[i][p] == c for p, c in enumerate(text) if p not in inside), text
        for a, b in spans:
            assert got[i][a:b] != text[a:b] and plain_luhn(re.sub("[^0-9]", "", got[i][a:b]))
    assert hits > 30 and plain_cards(texts[0]) == [(0, 19)] and len(plain_cards(texts[4])) == 2


def test_phones_in_many_layouts(spark):
    phones = ["+14155552671", "+49 30 1234567", "+33 612345678", "+33 6 12 34 56 78", "+91 98765 43210", "415.555.2671", "415-555-2671", "(415) 555-2671",
              "+1 (415) 555-2671", "+44 (0)20 7946 0958"]
    others = ["+1234567", "415.555.267", "+1 415", "1.415.555.26711", "+" + "1" * 16]
    rows = [(i, f"call {t}, now", None, None, 0) for i, t in enumerate(phones + others)]
    got = pii.pseudonymize(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()
    for (_, before, *_), r in zip(rows, got):
        if r["doc_id"] < len(phones):
            assert r["found"] == {"phone": 1} and r["text"] != before, before
            assert re.sub("[0-9]", "0", r["text"]) == re.sub("[0-9]", "0", before)
        else:
            assert r["text"] == before


def test_pseudonyms_odd_texts(spark):
    marks = "x\x01y\x02z 235.58.234.215 \x021 \x01"
    got = pseudonyms(spark, [None, "", "plain", marks, "9" * 5000, "a@b " * 2000])
    assert got[0] == (None, {}) and got[1] == ("", {}) and got[2] == ("plain", {})
    assert re.fullmatch("x\x01y\x02z [0-9.]+ \x021 \x01", got[3][0]) and got[3][1] == {"ip": 1}
    assert got[4] == ("9" * 5000, {}) and got[5] == ("a@b " * 2000, {})
    df = spark.createDataFrame([(1, "t 1.2.3.4", "f", 2), (1, "t 1.2.3.4", "f", 2)], "doc_id bigint, text string, found string, _made int")
    rows = pii.pseudonymize(df).collect()
    assert rows[0] == rows[1] and rows[0]["found"] == {"ip": 1}
    assert pii.pseudonymize(df.limit(0)).collect() == []
