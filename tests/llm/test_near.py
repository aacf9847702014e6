"""SimHash in the near-dedup stage: it comes first, is confirmed, and leaves the rest to the exact search."""

import random

import brute
import numpy as np

from quirelens.llm import shingles
from quirelens.operators.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_simhash_links_come_first_and_are_confirmed(spark, monkeypatch):
    import corpus_pipeline as pipeline

    rng = random.Random(3)
    rows = []
    for _ in range(15):
        base = brute.prose(rng, rng.randrange(200, 500), 3000).split()
        for edits in (0, 0, 1, 2, 6):
            words = list(base)
            for at in rng.sample(range(len(words)), edits):
                words[at] = "new"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), ""), (len(rows) + 1, None)]
    asked, confirmed = [], shingles._confirmed

    def spy(pairs, *rest):
        asked.append({tuple(r) for r in pairs.collect()})
        return confirmed(pairs, *rest)

    monkeypatch.setattr(shingles, "_confirmed", spy)
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    want, _ = brute.similar(rows)
    left = pipeline.dedup_near(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in left) == want

    # What the fingerprints join is what comparing all of them joins.
    sets = {s.tobytes(): s for s in (shingles.shingles(t) for _, t in rows)}.values()
    nodes = [int(np.uint64(shingles.xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) for s in sets]
    prints = [shingles.fingerprint(s) for s in sets]
    for s, p in zip(sets, prints):
        assert p == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    close = [(nodes[i], nodes[j]) for i in range(len(nodes)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= shingles.RADIUS]

    def groups(pairs):
        frame = spark.createDataFrame(list(pairs), "source bigint, target bigint")
        return {tuple(r) for r in components(frame).select("member", "representative").collect()}

    assert len(asked) == 3 and len(close) > 10
    assert groups(asked[0]) == groups(close)
    # Pairs that SimHash has joined are not asked again; pairs that it misses are.
    assert asked[1] and not asked[0] & asked[1]
