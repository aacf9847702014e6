"""Whitening, certified quality rules and spelling variants against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quirelens.llm import quality, spelling, whitening
from quirelens.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VECS = "vec_id bigint, embedding array<double>, label int"
SF = "/root/testdata/sf0.001"


# ---- whitening ----


def plain_whitening(rows):
    """[(id, vector)] to {(id, component): (n, deviation, whitened, explained)}, components by eigh."""
    taken = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in taken)
    fit = np.array(sorted({tuple(x) for _, x in taken}), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, axes = np.linalg.eigh(cov)
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for i, x in taken:
        for k in range(min(4, width)):
            e, axis = values[-1 - k], axes[:, -1 - k]
            out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), float((np.array(x) - mean) @ axis / math.sqrt(e)), e / np.trace(cov))
    return out


def same_whitening(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for k in {r["component"] for r in got}:
        mine = {r["vec_id"]: r for r in got if r["component"] == k}
        theirs = {i: v for (i, c), v in want.items() if c == k}
        sign = np.sign(sum(mine[i]["whitened"] * theirs[i][2] for i in mine))
        for i, (n, deviation, white, explained) in theirs.items():
            assert (mine[i]["n"], mine[i]["deviation"]) == (n, deviation)
            assert sign * mine[i]["whitened"] == pytest.approx(white, abs=1e-6)
            assert mine[i]["explained"] == pytest.approx(explained, rel=1e-6)
            assert mine[i]["identity_error"] < 1e-8


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    sizes = np.array([9.0, 5.0, 3.0, 2.0, 1.0, 0.01])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 6)) * sizes + 40)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector in half of the rows
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECS).repartition(5)
    same_whitening(whitening.whitened(df).collect(), plain_whitening(rows))


def test_whitening_of_ill_conditioned_rows(spark):
    """Sizes of 1 to 10^5, dimensions that depend on others and one that never changes."""
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(300, 4)) * [1e5, 1e3, 30, 1] * 256) / 256
    data = np.column_stack([base, base[:, 1] * 2, np.full(300, 7.0), base[:, 0] - base[:, 2]])
    got = whitening.whitened(spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(data)], VECS)).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    assert max(r["identity_error"] for r in got) < 1e-6
    exact = np.floor(data * 256)
    exact -= exact.mean(axis=0)
    sizes = np.linalg.svd(exact, compute_uv=False)
    for k in range(4):
        share = next(r["explained"] for r in got if r["component"] == k + 1)
        assert share == pytest.approx(sizes[k] ** 2 / (sizes**2).sum(), rel=1e-5)


def test_components_end_with_the_rank(spark):
    line = [(i, [float(i), 2.0 * i, 3.0], 0) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(line, VECS)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 50
    assert got[0]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [], 0), (2, [], 0)], [(1, None, 0)], [(1, [1.5], 0), (2, [1.5], 0)]])
def test_whitening_odd_tables(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, VECS)).collect() == []


def test_whitening_lengths_ids_and_size(spark):
    rows = [(None, [1.0], 0), (5, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (6, [], 0)]
    got = whitening.whitened(spark.createDataFrame(rows, VECS)).collect()
    short = plain_whitening([(1, [1.0, 0.0]), (5, [1.0, 2.0]), (6, [0.0, 0.0])])
    assert Counter(r["vec_id"] for r in got) == {None: 2, 5: 4, 6: 2}
    assert {r["deviation"] for r in got if r["vec_id"] == 5} == {short[5, 1][1]}
    big = whitening.whitened(spark.createDataFrame([(1, [1e300, 2.0], 0), (2, [-1e300, 3.0], 0)], VECS)).collect()
    assert [r["deviation"] for r in big] == [None] * len(big) and big


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(i, [float(7_000_000 + i * i), float(i)], 0) for i in range(100)]
    same = plain_whitening([(i, v) for i, v, _ in rows])
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, VECS)).collect()}
    assert got == {k: v[1] for k, v in same.items()}


# ---- quality rules ----


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_counts_equal_plain(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "a", "a b c d e f g h", "x " * 9, "a b c d e f g h " * 2 + "z", "l\nl\n l\nl\r\n\n", "\x0b#|# ü é ß 𝒳 <x>"]
    for _ in range(200):
        words = [rng.choice(["a", "b", "ä#", "|", "C!"]) for _ in range(rng.randrange(60))]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    passage = " ".join(f"w{i}" for i in range(5000))
    texts += [passage, passage + " and " + passage]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r[1:]) for r in quality.signals(docs, ["doc_id"]).select("doc_id", *quality.BASE).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def plain_allowed(n, share, error):
    total, k = 0.0, -1
    for i in range(n):
        total += math.comb(n, i) * share**i * (1 - share) ** (n - i)
        if total > error:
            return k
        k = i
    return k


def test_bound_is_exact(spark):
    cases = [(n, p, e) for n in (0, 1, 10, 59, 200, 1000) for p in (0.01, 0.05, 0.2) for e in (0.001, 0.05)]
    df = spark.createDataFrame(cases, "n bigint, p double, e double")
    from pyspark.sql import functions as F

    got = df.select("n", "p", "e", quality.allowed(F.col("n"), F.col("p"), F.col("e")).alias("k")).collect()
    assert [r["k"] for r in got] == [plain_allowed(*c) for c in cases]
    large = spark.createDataFrame([(5_000_000,)], "n bigint").select(quality.allowed(F.col("n"), F.lit(0.02), F.lit(0.001)).alias("k")).first()["k"]
    assert 98_900 < large < 99_100  # 100,000 less three standard deviations


def labelled(n, seed, junk):
    """Documents of two languages; bad ones hold marks where ``junk`` says so."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lang = "en" if i % 2 else None
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("," if rng.random() < 0.03 else "") for _ in range(40)]
        if not good and lang in junk:
            words = [w + "##" if rng.random() < 0.5 else w for w in words]
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_certified_cutoffs_reject_junk_and_keep_the_good(spark):
    docs, labels = labelled(4000, 4, ("en",))
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, known).collect()}
    good = {i: q for i, q, _ in labels}
    for lang in ("en", None):
        own = [d for d in docs if d[2] == lang]
        lost = [d for d in own if good[d[0]] and not got[d[0]]["kept"]]
        assert len(lost) <= quality.SHARE * sum(good[d[0]] for d in own)
    bad = [d for d in docs if d[2] == "en" and not good[d[0]]]
    assert sum(not got[d[0]]["kept"] for d in bad) > 0.95 * len(bad)
    assert all("symbols" in got[d[0]]["failed_rules"] or got[d[0]]["kept"] for d in bad)
    # Nothing tells good from bad in the stratum without a language: no rule is chosen there.
    assert all(got[d[0]]["kept"] for d in docs if d[2] is None)


def test_few_labels_certify_nothing(spark):
    docs, labels = labelled(60, 5, ("en", None))
    got = quality.quality_rules(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert all(r["kept"] for r in got.collect())


def test_false_rejection_stays_within_the_share(spark):
    """Over repeated draws the bound of the certified rules is broken no more often than it may."""
    broken = 0
    for seed in range(6):
        docs, labels = labelled(1500, 100 + seed, ("en", None))
        fresh, truth = labelled(3000, 200 + seed, ("en", None))
        shifted = [(i + 10_000, *rest) for i, *rest in fresh]
        got = quality.quality_rules(
            spark.createDataFrame(docs + shifted, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
        good = {i + 10_000 for i, q, _ in truth if q}
        for lang in (0, 1):
            own = [r for r in got if r["doc_id"] in good and r["doc_id"] % 2 == lang]
            broken += sum(not r["kept"] for r in own) > quality.SHARE * len(own)
    assert broken <= 1


def test_quality_odd_tables(spark):
    labels = "doc_id bigint, quality int, toxic int"
    assert quality.quality_rules(spark.createDataFrame([], DOCS), spark.createDataFrame([], labels)).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, None, None, None), (2, "", "en", "s", 0)]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", value string, rule int")
    got = quality.quality_rules(extra, spark.createDataFrame([(1, None, None), (1, 1, 0), (1, 0, 0), (None, 1, 1), (2, 7, 0)], labels))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got.collect()) == [(0, 30, True), (1, 0, False), (1, 30, True), (1, 30, True), (2, 0, False)]


def test_quality_plan_holds_no_python(spark):
    plan = QUERIES["op12_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# ---- spelling variants ----


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 5}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if apart(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 5 * n[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def variants(spark, docs):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in spelling.spelling_variants(df).collect())


def test_neighbour_keys_are_the_keys_of_all_neighbours():
    rng = random.Random(2)
    for length in (1, 2, 6, 9):
        codes = np.array([[rng.randrange(1, 5) for _ in range(length)] for _ in range(3)], dtype=np.uint64)
        keys = spelling.neighbour_keys(codes, 4)
        for row, found in zip(codes, keys):
            w = tuple(int(c) for c in row)
            words = {w[:i] + w[i + 1 :] for i in range(length)}
            words |= {w[:i] + (s,) + w[i + 1 :] for i in range(length) for s in range(1, 5)}
            words |= {w[:i] + (s,) + w[i:] for i in range(length + 1) for s in range(1, 5)}
            assert {int(k) for k in found} == {int(spelling.keys_of(np.array([v], dtype=np.uint64).reshape(1, -1))[0]) for v in words}


def test_variants_equal_plain(spark):
    rng = random.Random(6)
    stems = ["".join(rng.choice("aiqyéÀmu") for _ in range(rng.randrange(6, 9))) for _ in range(40)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + int(40 * rng.random() ** 3)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "a" + w[at:], w[:at] + "i" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i if i else None, rng.choice([" ", "-", "1", "\n"]).join(words)))
    want = plain_variants(docs)
    assert len(want) > 60 and sum(bool(w[1]) for w in want) > 20 and any(w[1] and w[1] != w[2] for w in want)
    assert variants(spark, docs) == want


def test_long_words_and_one_letter(spark):
    """Words of 40,000 letters cost what their length costs; letters of one symbol are told apart."""
    long = "abcdefghij" * 4000
    changed = long[:20_000] + "z" + long[20_000:]
    docs = [(i, long) for i in range(60)] + [(100 + i, changed) for i in range(6)]
    got = variants(spark, docs)
    assert [(len(w), len(f), n_near) for w, f, _, _, n_near, _ in got] == [(40_000, 0, 1), (40_001, 40_000, 1)] or len(got) == 2
    same = ["aaaaaa", "iaaaaa", "aiaaaa", "aaiaaa"]
    docs = [(i, " ".join(same)) for i in range(30)]
    assert variants(spark, docs) == plain_variants(docs)


def test_variants_odd_tables(spark):
    assert variants(spark, []) == []
    assert variants(spark, [(1, None), (2, ""), (3, "short 12345 ..."), (None, None)]) == []
    docs = [(1, "wordlike " * 7)] * 2 + [(None, "wordlyke wordlike")]
    assert variants(spark, docs) == plain_variants(docs)


@pytest.mark.parametrize("name", ["op12_quality_rules", "op13_spelling_variants"])
def test_registered_with_sql(name):
    assert name in QUERIES and name in ORACLES
