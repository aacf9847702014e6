"""Plain versions of the operators, over lists, to hold the Spark ones against."""

import math
import random
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def top_k(vectors, queries, k):
    """vectors, queries: {id: [float]}; {(query, rank): (id, score)}"""
    whole = lambda v: [math.floor(256 * x) for x in v]
    table = {i: whole(v) for i, v in vectors.items()}
    out = {}
    for q, v in queries.items():
        v = whole(v)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in table.items() if i != q)
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(texts, radius=3):
    """texts: [(doc_id, text)]; [(doc_id, fingerprint, component)]"""
    prints = [fingerprint(t) for _, t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        least[root(i)] += [doc] if doc is not None else []
    return [(d, f"{prints[i]:016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(texts)]


def similar(texts, words=5):
    """texts: [(doc_id, text)]; the least ids of the groups of near copies, and the pairs of places that are near copies"""
    sets = []
    for _, t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    group, pairs = list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= len(a | b) * 4:
                pairs.append((i, j))
                group = [group[j] if g == group[i] else g for g in group]
    return sorted({min(d for (d, _), h in zip(texts, group) if h == g) for g in group}), pairs


def targets(sizes, share=1.5, cycle=(3, 1, 2), most=2.0):
    """sizes: {source: words}; excess is shared out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def mix(docs, offset, bits=24):
    """docs: [(doc_id, source, text)]; [(doc_id, source, size, copies)]"""
    rows = [(d, s, len(WORD.findall(t or ""))) for d, s, t in docs]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    aim = targets(sizes)
    out = []
    for source in sizes:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[0] is None, r[0]))
        each = math.floor(aim[source] / sizes[source] * 2**bits + 0.5) if sizes[source] else 0
        for k, (d, s, n) in enumerate(own, 1):
            out.append((d, s, n, ((k * each + offset) >> bits) - (((k - 1) * each + offset) >> bits)))
    return out


def shared_lines(docs, least=5):
    """docs: [(doc_id, text)] with different ids; {doc_id: line numbers that an earlier document has}"""
    first = {}
    out = defaultdict(set)
    for doc, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip()
            if len(line.split()) >= least:
                first.setdefault(line, doc)
                if first[line] != doc:
                    out[doc].add(i)
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def corpus(n=60, seed=5):
    """Small documents with copies, near copies, shared lines, nulls and ties."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(n // 3)]
    line = prose(rng, 12)
    out = []
    for i in range(n):
        text = rng.choice(base)
        kind = i % 6
        if kind == 1:
            words = text.split()
            words[rng.randrange(len(words))] = "other"
            text = " ".join(words)
        if kind == 2:
            text = prose(rng, 30) + "\n" + line + "\n" + prose(rng, 9)
        if kind == 3:
            text = prose(rng, 40)
        if i == 7:
            text = None
        if i == 9:
            text = ""
        if i == 11:
            text = "  \n\t "
        out.append((i, text, "en", rng.choice(["a", "b", "b", "b", None]), len(text or "")))
    return out
