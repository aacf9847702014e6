"""Toxicity: a learned lexicon, matched with misspellings and weighed by context.

The lexicon's terms are a trie. Levenshtein automata of all terms run over a word at
once: a state is a set of (trie node, errors so far), made when it is first reached
and remembered, so a word costs one table step a letter and most end after a few.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import fresh, ship, text_of
from quirelens.plans.lineage import cut

SAMPLE = 8_000  # labelled rows that are learned from, at most
TERMS = 400  # terms of the lexicon, at most
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 5, 1.2, 3.0
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may be terms
WINDOW = 8  # words looked at on either side of a hit
THRESHOLD = 0.3
KEPT = 200_000  # runs of characters remembered per worker
STATES = 50_000  # automaton states remembered per worker

ONE_WORD = 0.6  # a beginning is no term if one word has this share of its toxic documents

# Signs and words that tell how a term is used.
OPEN, CLOSE = "\"'“‘«„‹(", "\"'”’»“‹)"
REPORTS = frozenset(
    "said says called calls term word quote quoted wrote writes saying dit appelle mot terme dijo palabra llama sagte sagt nennt wort".split()
)
DIRECT = frozenset("you your you're ya u tu toi vous ton votre du dich dein ihr sie eres usted te".split())
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
LETTERS = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[0-9@$!]")


def allowance(length: int) -> int:
    """Errors that a term of this length may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Levenshtein automata of all words of a lexicon, on its trie; stems match as they are."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.errors = [0]  # of any word below a node, the most it may have
        self.length = [0]
        for table, terms in ((self.word, words), (self.stem, stems)):
            for term, weight in sorted(terms.items()):
                node, most = 0, allowance(len(term)) if table is self.word else 0
                for letter in term:
                    if letter not in self.children[node]:
                        self.children[node][letter] = len(self.children)
                        self.children.append({})
                        for other in (self.word, self.stem):
                            other.append(None)
                        self.errors.append(0)
                        self.length.append(self.length[node] + 1)
                    self.errors[node] = max(self.errors[node], most)
                    node = self.children[node][letter]
                self.errors[node] = max(self.errors[node], most)
                table[node] = weight
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, places: dict[int, int]) -> dict[int, int]:
        """With letters of the terms left out in the word; of a node the fewest errors count."""
        todo = list(places.items())
        while todo:
            node, errors = todo.pop()
            if errors > places.get(node, 99):
                continue
            for child in self.children[node].values():
                if errors + 1 <= self.errors[child] and errors + 1 < places.get(child, 99):
                    places[child] = errors + 1
                    todo.append((child, errors + 1))
        return places

    def _state(self, places: dict[int, int]) -> int:
        key = tuple(sorted(places.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(places)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, errors: int) -> None:
            if errors <= self.errors[node] and errors < out.get(node, 99):
                out[node] = errors

        for node, errors in self.sets[state].items():
            put(node, errors + 1)  # a letter too many
            for label, child in self.children[node].items():
                if label == letter:
                    if errors == 0 or errors <= self.errors[child]:
                        out[child] = min(out.get(child, 99), errors)
                else:
                    put(child, errors + 1)  # another letter
        return self._state(self._closed(out))

    def match(self, word: str) -> tuple[float, str] | None:
        """Weight and kind (word, stem or fuzzy) of the best term, or None."""
        if len(self.sets) > STATES:
            self._reset()
        state, stem = self.start, 0.0
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self._step(state, letter)
            state = following
            places = self.sets[state]
            if not places:
                break
            for node, errors in places.items():
                if errors == 0 and self.stem[node] is not None:
                    stem = max(stem, self.stem[node])
        exact = fuzzy = 0.0
        for node, errors in self.sets[state].items():
            weight = self.word[node]
            if weight is not None and errors <= allowance(self.length[node]):
                if errors == 0:
                    exact = max(exact, weight)
                else:
                    fuzzy = max(fuzzy, weight / (1 + errors))
        if exact:
            return exact, "word"
        if stem:
            return stem, "stem"
        return (fuzzy, "fuzzy") if fuzzy else None


FEATURES = 10


class Reader(dict):
    """What a text shows: numbers for the classifier. Remembers runs of characters."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, run: str):
        lower = run.lower()
        hits = [h for h in map(self.automaton.match, LETTERS.findall(lower)) if h]
        if not hits and ODD.search(lower) and LETTERS.search(lower):
            plain = LETTERS.findall(lower.translate(LOOKALIKE))
            hits = [(w, "fuzzy") for w, _ in filter(None, map(self.automaton.match, plain))]
        hit = max(hits) if hits else None
        if len(run) <= 60:
            if len(self) >= KEPT:
                self.clear()
            self[run] = hit
        return hit

    def quoted(self, runs: list[str], at: int) -> bool:
        """Whether quotation marks open before and close after the word, both near."""
        opened = closed = False
        for i in range(at, max(-1, at - WINDOW - 1), -1):
            if i < at and runs[i].rstrip(".,;:!?")[-1:] in CLOSE and not runs[i][:1] in OPEN:
                break
            if runs[i][:1] in OPEN:
                opened = True
                break
        for i in range(at, min(len(runs), at + WINDOW + 1)):
            if i > at and runs[i][:1] in OPEN:
                break
            if runs[i].rstrip(".,;:!?")[-1:] in CLOSE:
                closed = True
                break
        return opened and closed

    def features(self, text: str) -> list[float]:
        runs = text.split()
        sums = {"word": 0.0, "stem": 0.0, "fuzzy": 0.0}
        quoted = direct = best = 0.0
        terms = set()
        for at, run in enumerate(runs):
            hit = self[run]
            if hit is None:
                continue
            weight, kind = hit
            around = [r.strip(".,;:!?\"'“”«»()").lower() for r in runs[max(0, at - WINDOW) : at + WINDOW + 1]]
            if self.quoted(runs, at) or not REPORTS.isdisjoint(around):
                quoted += weight
                continue
            sums[kind] += weight
            direct += not DIRECT.isdisjoint(around)
            best = max(best, weight)
            terms.add(run.lower())
        total = sum(sums.values())
        return [
            math.log1p(sums["word"]), math.log1p(sums["stem"]), math.log1p(sums["fuzzy"]), math.log1p(quoted),
            best, math.log1p(len(terms)), math.log1p(len(runs)), math.log1p(1000 * total / (len(runs) + 50)), math.log1p(direct),
            float(sums["word"] > 0),
        ]


@dataclass
class Model:
    """Terms with their weights, and a logistic regression over what texts show of them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = -5.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> None:
        """Newton steps on the ridge-penalised likelihood."""
        if not len(rows) or toxic.min() == toxic.max():
            share = float(toxic.mean()) if len(rows) else 0.0
            self.weights, self.bias = [0.0] * FEATURES, math.log((share + 1e-3) / (1 - share + 1e-3))
            return
        mean, scale = rows.mean(0), rows.std(0)
        scale[scale == 0] = 1.0
        x = np.c_[(rows - mean) / scale, np.ones(len(rows))]
        w = np.zeros(x.shape[1])
        penalty = np.diag([ridge] * FEATURES + [1e-6])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.mean, self.scale, self.weights, self.bias = mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1])


# ---- learning ------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is kept from learning; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def lexicon(counts: list[tuple], parts: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds, from (term, stem, toxic and clean documents per part)."""
    top: dict[str, int] = {}  # the toxic documents of the commonest word with a beginning
    for term, stem, toxic, _ in counts[1:]:
        for n in STEMS:
            if not stem and len(term) > n:
                top[term[:n]] = max(top.get(term[:n], 0), sum(toxic[p] for p in parts))
    toxic_all, clean_all = (sum(counts[0][2 + side][p] for p in parts) for side in (0, 1)) if counts else (0, 0)
    found = []
    for term, stem, toxic, clean in counts[1:]:
        a, b = sum(toxic[p] for p in parts), sum(clean[p] for p in parts)
        if stem and top.get(term, 0) >= ONE_WORD * a:
            continue  # one word, which is a term itself
        odds = math.log((a + 0.5) / (toxic_all + 1)) - math.log((b + 0.5) / (clean_all + 1))
        z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= LEAST_DOCS and odds >= LEAST_ODDS and z >= LEAST_Z:
            found.append((z, term, stem, odds))
    found = sorted(found, key=lambda x: (-x[0], x[1], x[2]))[:TERMS]
    words = {t: o for _, t, stem, o in found if not stem}
    stems = {t: o for _, t, stem, o in found if stem}
    return words, stems


def _term_counts(sample: DataFrame) -> list[tuple]:
    """First the numbers of documents, then those of each term that may matter."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]{3,}"), F.lit(0)))
    rows = sample.select("part", "toxic", words.alias("words"))
    prefixes = F.array_distinct(
        F.flatten(F.transform("words", lambda w: F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: F.char_length(w) > n), lambda n: F.substring(w, F.lit(1), n))))
    )
    tagged = F.concat(
        F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(False).alias("stem"))),
        F.transform(prefixes, lambda w: F.struct(w.alias("term"), F.lit(True).alias("stem"))),
    )
    sums = [F.count_if((F.col("part") == p) & (F.col("toxic") == y)).alias(f"n{y}{p}") for y in (1, 0) for p in (0, 1)]
    terms = rows.select("part", "toxic", F.explode(tagged).alias("t")).groupBy("t.term", "t.stem").agg(*sums)
    # The sample bounds how many terms come in five documents or more.
    useful = terms.filter(F.expr(f"n10 + n11 >= {LEAST_DOCS} and n00 + n01 <= 4 * (n10 + n11)"))
    pack = lambda r: ((r["n10"], r["n11"]), (r["n00"], r["n01"]))
    return [(None, None, *pack(sample.agg(*sums).first())), *((r["term"], r["stem"], *pack(r)) for r in useful.collect())]


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents, held-out ones left aside.

    The sample is chosen by a hash of the doc_id and small by its definition, so its
    ids are broadcast. It has two parts; what the classifier learns on is seen with a
    lexicon made from the other part, and the model's lexicon is made from both.
    Labels other than 0 and 1 are passed over; an id labelled twice counts as toxic if
    one label says so.
    """
    ship(documents.sparkSession)
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    rows = cut(texts.select("doc_id", "toxic", part.alias("part"), "text").limit(sample * 2))
    counts = _term_counts(rows)
    model = Model(*lexicon(counts, (0, 1)))
    crossed = [lexicon(counts, (1,)), lexicon(counts, (0,))]  # for rows of part 0, of part 1

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(Automaton(*c)) for c in crossed]
        for batch in batches:
            out = [readers[p.as_py()].features(t.as_py()) for p, t in zip(batch.column("part"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    seen = rows.mapInArrow(show, "doc_id bigint, toxic int, x array<double>").collect()
    seen.sort(key=lambda r: (r["doc_id"], r["x"]))
    model.fit(np.array([r["x"] for r in seen]).reshape(len(seen), FEATURES), np.array([r["toxic"] for r in seen], float))
    return model


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every document, with the columns named in ``keep``.

    Nothing but the text counts. Null and empty texts get the score of a text without
    hits. Whole texts are read, of any length; repeated rows are scored alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Automaton(model.words, model.stems))
        for batch in batches:
            rows = np.array([reader.features(t.as_py()) for t in batch.column(held)]).reshape(batch.num_rows, FEATURES)
            scores = model.score(rows)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"]
            )

    ship(documents.sparkSession)
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    held = fresh(documents, "_text")
    rows = documents.select(*names, text_of().alias(held))
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Empty tables give no rows; without usable labels every score is the same and low.
    Columns of other names, and clashing ones of the labels, play no part.
    """
    return score(documents, learn(documents, labels, sample), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
