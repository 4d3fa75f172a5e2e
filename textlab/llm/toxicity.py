"""Toxicity by a lexicon trie searched with Levenshtein automata, and the context of each hit.

The lexicon, the harmless look-alikes and the weights are learnt from labelled texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import fit_logistic, in_batches, slices, worker_state
from textlab.sources.sinks import materialise

# Words with masking signs inside ("st*pid") stay whole.
TOKEN = re.compile(r"\w+(?:[*@$]+\w+)*")

# Cues that a term is reported, not used.
REPORTING = frozenset(
    """
    said says say wrote writes quoted quote quotes called calls word words term slur reported
    claims claimed dit écrit cité mot terme sagte schrieb zitierte wort begriff dijo escribió
    citó palabra término
    """.split()
)
# Cues that a term is aimed at someone.
ADDRESS = frozenset("you your yours u du dich dein deine tu toi vous votre te ti usted vosotros".split())
QUOTES = "\"“”„«»‹›"
N_FEATURES = 8


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Nearest lexicon term of a word within the term's allowed edits.

    The Levenshtein automaton of the word and the trie of the terms run together: a state is
    the set of (trie node, least edits) that the letters read so far can reach. States and
    steps are built when first needed and kept, so a known prefix costs one lookup a letter.
    """

    MAX_STEPS = 2_000_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at, self.budget = [-1], [0]
        for k, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.term_at[node] = k
        self._reset()

    def _reset(self):
        self.ids, self.sets, self.steps, self.accepts, self.n_steps = {}, [], [], [], 0
        self.start = self._state({0: 0} if self.terms else {})

    def _state(self, reach: dict[int, int]) -> int:
        """Number of the state, after adding what skipped lexicon letters reach."""
        todo = list(reach.items())
        while todo:
            node, e = todo.pop()
            if reach.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < reach.get(child, 99):
                    reach[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(reach.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(reach)
            self.steps.append({})
            ends = [
                (e, self.term_at[n]) for n, e in reach.items() if self.term_at[n] >= 0 and e <= allowed_edits(self.terms[self.term_at[n]])
            ]
            self.accepts.append(min(ends) if ends else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}

        def add(node, e):
            if e <= self.budget[node] and e < reach.get(node, 99):
                reach[node] = e

        for node, e in self.sets[state].items():
            add(node, e + 1)
            for letter, child in self.children[node].items():
                add(child, e if letter == c else e + 1)
        self.n_steps += 1
        return self._state(reach)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, place of the term), the least edits first, then the first term; or None."""
        if self.n_steps > self.MAX_STEPS:
            self._reset()
        state, steps, sets = self.start, self.steps, self.sets
        for c in word:
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            state = to
            if not sets[state]:
                return None
        return self.accepts[state]


class Lexicon(NamedTuple):
    terms: list[str]
    weights: list[float]
    harmless: frozenset[str]


class Model(NamedTuple):
    lexicon: Lexicon
    coefficients: np.ndarray | None  # None: nothing to learn from


class Scanner:
    """Hits of one lexicon in texts."""

    CACHE = 400_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.fuzzy, self.seen = lexicon, FuzzyLexicon(lexicon.terms), {}

    def hit(self, word: str) -> tuple[int, int] | None:
        if word in self.seen:
            return self.seen[word]
        found = None if word in self.lexicon.harmless else self.fuzzy.match(word)
        if len(self.seen) >= self.CACHE:
            self.seen.clear()
        self.seen[word] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Of a whole text: abuse and quotation weight, distinct exact and misspelled terms,
        strongest hit, share of hits, hits aimed at someone, length."""
        low = (text or "").lower()
        found = {w: h for w in set(TOKEN.findall(low)) if (h := self.hit(w))}
        out = np.zeros(N_FEATURES)
        out[7] = math.log1p(len(low)) / 10
        if not found:
            return out
        spans = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(low)]
        exact, misspelled, best = set(), set(), {}
        aimed = hits = 0
        for i, (word, start, end) in enumerate(spans):
            h = found.get(word)
            if h is None:
                continue
            hits += 1
            edits, term = h
            (misspelled if edits else exact).add(term)
            quoted = quotation_score(low, [w for w, _, _ in spans[max(0, i - 6) : i + 7]], start, end)
            aimed += any(w in ADDRESS for w, _, _ in spans[max(0, i - 3) : i + 4])
            weight = self.lexicon.weights[term] * 0.6**edits
            abuse, quote = best.get(term, (0.0, 0.0))
            best[term] = max(abuse, weight * (1 - quoted)), max(quote, weight * quoted)
        out[0] = math.log1p(sum(a for a, _ in best.values()))
        out[1] = math.log1p(sum(q for _, q in best.values()))
        out[2], out[3] = math.log1p(len(exact)), math.log1p(len(misspelled))
        out[4] = max(a for a, _ in best.values())
        out[5] = min(1.0, 10 * hits / len(spans))
        out[6] = math.log1p(aimed)
        return out


def quotation_score(text: str, window: list[str], start: int, end: int, reach: int = 80) -> float:
    """0 (used) to 1 (quoted), from quotation marks on both sides and words of reporting."""
    left, right = text[max(0, start - reach) : start], text[end : end + reach]
    marks = sum(left.count(q) for q in QUOTES) % 2 == 1 and any(q in right for q in QUOTES)
    reported = any(w in REPORTING for w in window)
    return 0.9 if marks and reported else 0.7 if marks else 0.3 if reported else 0.0


def _signature(text: str) -> int:
    """Least hash of the five-word shingles: near copies share it."""
    words = text.encode().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else [b" ".join(words)]
    return min(xxhash.xxh64_intdigest(g) for g in grams) >> 1


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled texts of the training part, one of each group of near copies."""
    train = (
        labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 4 != 2")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = [_signature(t) for t in batch.column(2).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(sig, pa.int64())], ["doc_id", "toxic", "text", "sig"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(train), "doc_id").select("doc_id", "toxic", "text")
    signed = in_batches(texts, kernel, "doc_id long, toxic int, text string, sig long")
    one = signed.groupBy("sig").agg(F.min_by(F.struct("toxic", "text"), "doc_id").alias("r"))
    return materialise(one.select("sig", "r.toxic", "r.text"), "toxicity-sample")


def _term_counts(sample: DataFrame) -> DataFrame:
    """Texts and toxic texts of each term, in each of two halves."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for sig, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            half = sig % 2
            for w in set(TOKEN.findall(text.lower())):
                c = counts.setdefault(w, [0, 0, 0, 0])
                c[2 * half] += 1
                c[2 * half + 1] += toxic
        numbers = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 4)
        return pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array(numbers[:, k]) for k in range(4))], ["term", "n0", "t0", "n1", "t1"])

    rows = in_batches(sample.select("sig", "toxic", "text"), kernel, "term string, n0 long, t0 long, n1 long, t1 long", 2_000)
    return rows.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")))


def lower_bound(k, n, z: float = 3.0):
    """Wilson's lower bound of a share; numbers or Columns."""
    p = k / n
    root = (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    return (p + z * z / (2 * n) - z * root) / (1 + z * z / n)


def _lexicons(counts: DataFrame, min_share: float, max_terms: int) -> list[Lexicon]:
    """Lexicons of the first half, the second half and both, with their harmless look-alikes."""
    parts = [("n0", "t0"), ("n1", "t1"), ("(n0 + n1)", "(t0 + t1)")]
    out = []
    for n, t in parts:
        share = lower_bound(F.expr(f"cast({t} as double)"), F.expr(f"cast(nullif({n}, 0) as double)"))
        top = counts.withColumn("share", share).where(F.col("share") >= min_share).orderBy(F.desc("share"), "term").limit(max_terms)
        rows = top.select("term", "share").collect()
        terms = [r["term"] for r in rows]
        fuzzy_terms = list(terms)

        def kernel(batch: pa.RecordBatch, terms=fuzzy_terms) -> pa.RecordBatch:
            fuzzy = FuzzyLexicon(terms)
            words = batch.column(0).to_pylist()
            near = [(h := fuzzy.match(w)) is not None and h[0] > 0 for w in words]
            return batch.filter(pa.array(near, pa.bool_()))

        known = counts.where(F.expr(f"{n} > 0 and {t} * 10 < {n} * 3")).select("term")
        harmless = in_batches(known, kernel, "term string", 10_000).collect() if terms else []
        out.append(Lexicon(terms, [float(r["share"]) for r in rows], frozenset(r["term"] for r in harmless)))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_share: float = 0.4, max_terms: int = 2_000) -> Model:
    """Model from at most ``max_rows`` labelled rows whose crc32(doc_id) mod 4 is not 2.

    A term enters the lexicon when the lower bound of its share of toxic texts reaches
    ``min_share``. The weights are fitted on hits of the lexicon of the other half, as a new
    text would see it. What reaches the driver: up to ``max_terms`` terms, look-alikes
    from the sample, and ``max_rows`` feature rows.
    """
    sample = _sample(docs, labels, max_rows)
    counts = materialise(_term_counts(sample), "toxicity-terms")
    halves = _lexicons(counts, min_share, max_terms)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanners = [Scanner(halves[1]), Scanner(halves[0])]
        rows = zip(*(c.to_pylist() for c in batch.columns))
        x = [[float(toxic), *scanners[sig % 2].features(text)] for sig, toxic, text in rows]
        return pa.record_batch([pa.array(x, pa.list_(pa.float64()))], ["x"])

    found = in_batches(sample.select("sig", "toxic", "text"), kernel, "x array<double>").collect()
    if not found:
        return Model(halves[2], None)
    x = np.array(sorted(r["x"] for r in found))
    return Model(halves[2], fit_logistic(x[:, 1:], x[:, 0]))


def scorer(model: Model):
    """Function from whole texts to scores, for use inside tasks."""
    scanner = Scanner(model.lexicon)

    def scores(texts: list[str | None]) -> np.ndarray:
        if model.coefficients is None:
            return np.zeros(len(texts))
        x = np.array([scanner.features(t) for t in texts]).reshape(-1, N_FEATURES)
        z = x @ model.coefficients[:-1] + model.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def _scoring(model: Model):
    """Function that gives a task its scorer: built once per worker and model, told by all of the
    model's parts."""
    lexicon = model.lexicon
    parts = (lexicon.terms, lexicon.weights, sorted(lexicon.harmless), None if model.coefficients is None else model.coefficients.tolist())
    key = hashlib.sha256(repr(parts).encode()).hexdigest()
    return lambda: worker_state("toxicity", key, lambda: scorer(model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; other columns than doc_id and text are not read.

    Null texts count as empty; an empty text has no hits and gets the score of such a text.
    Without labelled rows to learn from every score is 0. Repeated rows give repeated
    results; an empty table gives none.
    """
    own = _scoring(model)

    def run(batches):
        scores = own()
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    own = _scoring(model)

    def run(batches):
        scores = own()
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
