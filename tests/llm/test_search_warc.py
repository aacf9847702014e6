"""Exact top-k search and WARC archives."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

import brute
from quirelens.llm import topk, warc

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n, dims=16, seed=3, near=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(near, dims))
    rows = centres[rng.integers(0, near, n)] + 0.3 * rng.normal(size=(n, dims))
    rows = rows.astype(np.float32) / np.float32(4)
    rows[5] = rows[2]
    rows[n // 2] = rows[2]
    return {i * 10: [float(x) for x in v] for i, v in enumerate(rows)}


def run(spark, table, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in table.items()], VECTORS)
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, **how).collect()}


@pytest.mark.parametrize("shard,block", [(10_000, 512), (100, 7), (1, 1)])
def test_top_k_equals_plain(spark, shard, block):
    table = vectors(500 if shard > 1 else 40)
    want = brute.top_k(table, {i: v for i, v in table.items() if i % 50 == 0}, 5)
    assert run(spark, table, shard=shard, block=block) == want


def shard_of(table, ids=None):
    import pandas as pd

    frame = pd.DataFrame({"shard": 0, "vec_id": list(table) if ids is None else ids, "v": [[int(np.floor(256 * x)) for x in v] for v in table.values()]})
    return topk.Shard(topk.build_shard(frame).iloc[0]), np.array(frame["v"].tolist()), frame["vec_id"].to_numpy()


def test_adding_up_stops_early_and_is_proven():
    # A few large components and many small ones: the first run of segments tells most vectors apart.
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(3000, 16)) * 0.02
    for i in range(3):
        rows[np.arange(3000), rng.integers(0, 16, 3000)] += rng.normal(size=3000) * 2
    shard, matrix, ids = shard_of({i: [float(x) for x in v] for i, v in enumerate(rows)})
    asked = np.arange(0, 3000, 100)
    members, proven = shard.possible(ids[asked], matrix[asked], 5, np.full(len(asked), -np.inf))
    assert (proven < len(shard.runs)).sum() > 15
    for i, row in enumerate(asked):
        scores = matrix @ matrix[row]
        scores[row] = scores.min() - 1
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5]).tolist()) <= set(members[i].tolist())


def test_repeated_ids_are_ranked_by_their_best_row(spark):
    rows = [(50, [1.0, 0.0], 1), (1, [0.1, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.5, 0.0], 1)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VECTORS)).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 256 * 230), (50, 2, 2, 256 * 128)]
    # One id in a third of the rows, with vectors of its own that would all be among the best.
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(1, 200)]
    rows += [(7, [float(x) for x in rng.normal(size=8) * 3], 0) for _ in range(100)] + [(100, [float(x) for x in rng.normal(size=8)], 0)]
    whole = [(i, [int(np.floor(256 * np.float32(x))) for x in v]) for i, v, _ in rows]
    want = []
    for q in (50, 100, 150):
        best = {}
        for _, u in [r for r in whole if r[0] == q]:
            for i, v in whole:
                if i != q:
                    best[i] = max(best.get(i, -(1 << 60)), sum(a * b for a, b in zip(u, v)))
        want += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    for shard in (10_000, 40):
        assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, VECTORS), shard=shard).collect())) == want


def test_most_shards_are_ruled_out_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24)) * 4
    rows = [(i, [float(x) for x in centres[i % 12] + 0.1 * rng.normal(size=24)], 0) for i in range(2400)]
    vectors = topk.integers(spark.createDataFrame(rows, VECTORS))
    index = topk.build_index(vectors, 12, 300)
    shards = index.count()
    asked = vectors.filter("vec_id % 50 = 0").selectExpr("vec_id as q", "vec_id as query_id", "v")
    found, pairs = topk.search(asked, index, shards, 5)
    assert pairs.count() < 0.4 * shards * asked.count() and shards >= 8
    want = brute.top_k({i: list(np.float32(v)) for i, v, _ in rows}, {i: list(np.float32(v)) for i, v, _ in rows if i % 50 == 0}, 5)
    got = run(spark, {i: v for i, v, _ in rows}, shard=300)
    assert got == want


def test_top_k_odd_tables(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1),
        (5, [float("inf"), 0.0], 1), (None, [9.0, 9.0], 1), (6, [0.0, 0.0, 5.0], 1), (7, [], 1), (8, [-1.0, 0.5], 1),
    ]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], VECTORS + ", rank int, score string")
    got = [tuple(r) for r in topk.top_k(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 6, 0), (0, 3, 7, 0), (0, 4, 8, 0)]
    alone = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    assert topk.top_k(alone).collect() == []
    other = spark.createDataFrame([(99, [0.0, 1.0], 1)], VECTORS)
    assert [r["vec_id"] for r in topk.top_k(df, other, k=2).orderBy("rank").collect()] == [0, 1]


# ---- WARC ----

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n</p>" * 5
    rows = [
        (3, "http://a/ b\r\nWARC-Type: x", long), (1, "http://a", long), (7, None, long), (4, "u", "short"), (2, "u", "short"), (5, "u", None), (6, "u", ""),
        (8, "u", "y" * 99), (9, "u", "y" * 99), (11, "u", "y" * 100), (10, "u", "y" * 100), (10, "u", "y" * 100), (None, "u", "y" * 100), (12, "u", "é" * 50), (13, "u", "é" * 50),
    ]
    return rows, spark.createDataFrame(rows, PAGES)


def expected(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        at = first.get(data) if len(data) >= 100 else None
        again = at is not None and at != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = warc.round_trip(df.selectExpr("*", "1 as digest", "'x' as bytes"))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_records_payloads_and_pushdown(spark, tmp_path, compression):
    rows, df = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_warc(df, path, compression=compression)
    uri = f"file://{path}"
    # A loaded frame keeps the filters of its first use, so each query loads its own.
    texts = {r["record_id"]: r for r in warc.read_warc(spark, uri).filter("record_type = 'response'").collect()}
    assert texts["<urn:page:1>"]["payload"].decode() == rows[1][2]
    assert texts["<urn:page:5>"]["payload"] == b"" and texts["<urn:page:4>"]["payload"] == b"short"
    assert warc.read_warc(spark, uri).count() == len(rows)
    some = warc.read_warc(spark, uri).filter("record_type in ('revisit') and target_uri is not null and record_id like '<urn:page:3%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("BatchScan")[0].replace("record_type#", "")
    row = some.first()
    assert row["refers_to"] == "<urn:page:1>" and row["payload"] == b"" and "\n" not in row["target_uri"]
    assert row["payload_digest"] == "sha256:" + hashlib.sha256(rows[0][2].encode()).hexdigest()
    assert warc.read_warc(spark, uri, payload=False).filter("payload is not null").count() == 0
    if compression is None:
        data = b"".join(p.read_bytes() for p in sorted((tmp_path / "archive").glob("part-*")))
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) and data.endswith(b"\r\n\r\n")


def test_reader_takes_only_filters_it_decides(tmp_path):
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("date",), "2"), In(("date",), ("a", "b")), EqualTo(("payload",), b"")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"]
    assert not reader.wanted(dict.fromkeys(warc.FIELDS))
    assert reader.wanted(dict.fromkeys(warc.FIELDS) | {"record_type": "response", "date": "b"})


def test_partitions_are_whole_files(tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "partitionbytes": "80"})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5


def test_broken_archives_are_errors(tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))
    for name in ("a.warc", "b.warc.gz"):
        reader = warc.WarcReader({"path": f"file://{tmp_path}"})
        with pytest.raises(ValueError):
            list(reader.read(warc.Files([f"file://{tmp_path}/{name}"])))


def test_random_pages(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i}", rng.choice(["a", "b", "\r\n", "é"]) * rng.choice([40, 99, 100, 250])) for i in range(120)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
