"""Index builds: even parts however the files are cut, digests that add up, a search in an index with lost postings."""

from pyspark.sql import functions as F

from conftest import rows
from quirelens.operators import fulltext
from quirelens.queries import QUERIES
from quirelens.sources import generations
from quirelens.sources.generations import GenerationStore

TEXTS = ["alpha beta", "日本語テキスト", "", "al", None, "alphabet" * 9, "a.b*c", "betalpha", "x😀yz"]


def store_of(spark, tmp_path, name="index"):
    return GenerationStore(spark, str(tmp_path / name))


def test_digests_are_sums_of_hashes(spark, frame):
    docs = frame(list(enumerate(TEXTS)), "doc_id long, text string")
    postings = fulltext.trigram_index(docs)
    sums = [F.sum(h.cast("decimal(20,0)")).cast("string") for h in (F.xxhash64("gram", "doc_id"), F.xxhash64(F.lit("digest"), "doc_id", "gram"))]
    want = postings.groupBy(fulltext.bucket_of("gram").alias("bucket")).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("digest"))
    assert rows(fulltext.bucket_digests(postings), "bucket", "digest") == rows(want)


def test_digests_of_parts_add_up_without_writing(spark, frame, tmp_path):
    docs = frame(list(enumerate(TEXTS * 3)), "doc_id long, text string")
    store = store_of(spark, tmp_path)
    whole = store.write(store.begin("1"), docs)
    before = sorted(tmp_path.rglob("*"))
    parts = [store.digests(docs.filter(f"doc_id % 3 {op} 1")) for op in ("=", "<>")]
    assert fulltext.add_digests(*parts) == fulltext.add_digests(*parts[::-1]) == whole == store.digests(docs)
    assert fulltext.add_digests({}, whole) == whole
    assert sorted(tmp_path.rglob("*")) == before


def test_files_are_even_and_sorted_by_bucket(spark, frame, tmp_path, monkeypatch):
    """One input file gives files of some size each, each in one run per bucket and gram."""
    monkeypatch.setattr(generations, "PART_BYTES", 400)
    docs = frame([(i, f"text {i} of {i * 7919} words") for i in range(400)], "doc_id long, text string").coalesce(1)
    store = store_of(spark, tmp_path)
    number = store.begin("1")
    store.write(number, docs)
    postings = store._postings(number)
    assert rows(postings, "gram", "doc_id") == rows(fulltext.trigram_index(docs), "gram", "doc_id")
    assert rows(postings.filter(F.col("bucket") != fulltext.bucket_of("gram"))) == []
    files = {}
    for r in postings.select(F.col("_metadata.file_name").alias("f"), "bucket", "gram").collect():
        files.setdefault(r["f"], []).append((r["bucket"], r["gram"]))
    assert len(files) > spark.sparkContext.defaultParallelism
    for kept in files.values():
        for values in (kept, [b for b, _ in kept]):
            assert sum(a != b for a, b in zip(values, values[1:])) + 1 == len(set(values))


def test_the_damaged_index_is_built_once(spark, monkeypatch):
    written = []
    write = GenerationStore.write
    monkeypatch.setattr(GenerationStore, "write", lambda self, number, docs: written.append(number) or write(self, number, docs))
    got = QUERIES["search_corrupt"](spark, "/root/testdata/sf0.001").collect()
    assert len(written) == 1 and got and {r["fallback_reason"] for r in got} == {"index corrupt"}
