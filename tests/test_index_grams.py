"""Grams of an index: characters outside the first plane, slices of any cut, alphabets of any width, lists instead of postings."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quirelens.operators import fulltext
from quirelens.sources.generations import GenerationStore

TEXTS = ["alpha beta", "x😀yz", "😀😀😀😀", "日本語テキスト", "", "al", None, "aaa", "a\u0000b\nc  d", "alphabet" * 900, "\U0010ffff\u0001éo"]


def brute(pairs):
    return sorted({(i, t[p : p + 3]) for i, t in pairs if t for p in range(len(t) - 2)})


@pytest.mark.parametrize("slice_chars", [1, 20, 1 << 21])
def test_grams_are_runs_of_characters(frame, monkeypatch, slice_chars):
    """A pair of surrogates is one character: no gram begins with its second half."""
    monkeypatch.setattr(fulltext, "SLICE", slice_chars)
    docs = frame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = rows(fulltext.trigram_index(docs), "doc_id", "gram")
    assert got == sorted(brute(enumerate(TEXTS)), key=repr) and len(got) > 30


def test_wide_alphabets_are_halved_until_they_fit(frame):
    """Each text has its own characters, more together than one number of 63 bits can name with the rows."""
    pick = random.Random(7)
    letters = [chr(c) for c in range(0x100, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(pick.choices(letters, k=400)) for _ in range(700)]
    docs = frame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["gram"]) for r in fulltext.trigram_index(docs).collect()}
    assert got == set(brute(enumerate(texts)))


def test_keys_stay_as_they_are(frame):
    """Null and repeated keys, each row by itself, and texts that are no UTF-8."""
    docs = frame([("a", "abcabc"), ("a", "abc"), (None, "abc"), ("b", None)], "name string, body string")
    got = rows(fulltext.trigram_index(docs, "name", "body").filter("gram = 'abc'"), "name")
    assert sorted(got, key=repr) == sorted([("a",), ("a",), (None,)], key=repr)
    broken = docs.select("name", F.unhex(F.lit("616263FF646566")).cast("string").alias("body")).limit(1)
    assert {"abc", "def"} <= {r["gram"] for r in fulltext.trigram_index(broken, "name", "body").collect()}


def test_what_is_sorted_are_lists(spark, frame, tmp_path):
    """A slice has a row for each gram, however many texts hold it; a build sorts those."""
    docs = frame([(i, "the same words in every text") for i in range(2000)], "doc_id long, text string").coalesce(1)
    lists, n = fulltext.gram_lists(docs).collect(), len(brute([(0, "the same words in every text")]))
    assert len(lists) == n and all(sorted(r["keys"]) == list(range(2000)) for r in lists)
    store = GenerationStore(spark, str(tmp_path / "index"))
    store.build(docs, "1")
    assert store._postings(1).count() == 2000 * n
    assert rows(store.search(docs, "words in", "1"), "doc_id", "fallback_reason") == sorted([(i, None) for i in range(2000)], key=repr)
