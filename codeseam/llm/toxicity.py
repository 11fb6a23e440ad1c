"""Toxicity scores: Levenshtein automata intersected with a trie of learnt terms.

The lexicon is learnt from labelled rows: words, and beginnings of 4 to 6
characters, whose log-odds between toxic and clean documents are high even one
standard error below their estimate.  The words become a trie; the automaton of all
words within a term's edit radius is run over trie nodes, states being sets of
(node, edits), made deterministic lazily.  So a word costs a table look-up a
character and most die after two or three.  Word beginnings are terms of the same
trie that accept where they end, without edits.  Misspelled words that clean
training rows use themselves are no hits.  Terms of less than five letters are
found only as they are: an edit turns too many of them into other words.

A hit's weight depends on its context window: within quotation marks it counts
little, among other hits more.  The score is the logistic of the prior and the
best weight of each term that occurs.

Scoring is row local: the lexicon, learnt from at most about ``fit_rows`` labelled
documents and so bounded by them, travels with the task; caches are bounded.
Words of ``LONG`` characters or more count by their digest: exactly, not misspelled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.llm.shared import fold, fresh_names, materialise
from codeseam.llm.simhash import labelled

TOKEN = re.compile(r"\w+")
QUOTES = re.compile(r"[\"“”„«»‹›]")
WINDOW = 8
BEGIN = (4, 5, 6)
SEEN, STATES = 200_000, 20_000


def radius(term: str) -> int:
    """Edits by which a term may be misspelled."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


LONG = 64


def name(word: str) -> str:
    """A word, or what a very long one is told by (no word begins with NUL)."""
    return word if len(word) < LONG else "\0" + hashlib.sha256(word.encode()).hexdigest()[:32]


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings, marked by a star."""
    return {name(w) for w in words} | {w[:n] + "*" for n in BEGIN for w in words if len(w) > n + 1}


class Automaton:
    """Finds the nearest term of a lexicon within its radius of a word, and the
    starred beginnings it has.  ``edits``: whether misspelled words are found."""

    def __init__(self, weights: dict[str, float], edits: bool = True) -> None:
        self.weights = {t: w for t, w in weights.items() if t[0] != "\0"}
        self.radius = radius if edits else lambda t: 0
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.begin: list[str | None] = [None]
        self.reach = [0]  # the largest radius below a node
        for t in self.weights:
            starred, at = t[-1] == "*", 0
            r = 0 if starred else self.radius(t)
            self.reach[0] = max(self.reach[0], r)
            for c in t[:-1] if starred else t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.begin.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], r)
            (self.begin if starred else self.term)[at] = t
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.begins: list[str | None] = []  # the beginning that a state has just read
        self.start = self.state(self.closed({0: 0}) if self.weights else {})

    def closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that skipped term characters lead to; fewest edits kept."""
        todo = list(nodes.items())
        while todo:
            n, e = todo.pop()
            if nodes.get(n, 99) < e:
                continue
            for child in self.children[n].values():
                if e + 1 <= self.reach[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.begins.append(next((self.begin[n] for n, e in key if not e and self.begin[n] is not None), None))
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.reach[n] and e < out.get(n, 99):
                out[n] = e

        for n, e in self.sets[state]:
            put(n, e + 1)  # a character too many
            for d, child in self.children[n].items():
                put(child, e + (d != c))
        found = self.next[state][c] = self.state(self.closed(out))
        return found

    def read(self, word: str) -> tuple[tuple[str, int] | None, list[str]]:
        """((term, edits) of the nearest term, the heavier at a tie, or None; the
        starred beginnings)."""
        if len(self.sets) > STATES:
            self.reset()
        at, tables, begins, found = self.start, self.next, self.begins, []
        dead = self.ids.get(frozenset(), -1)
        for i, c in enumerate(word):
            n = tables[at].get(c)
            at = self.step(at, c) if n is None else n
            if at == dead or not self.sets[at]:
                return None, found
            if begins[at] is not None and i + 2 < len(word):
                found.append(begins[at])
        best = [(e, -self.weights[self.term[n]], self.term[n]) for n, e in self.sets[at] if self.term[n] is not None and e <= self.radius(self.term[n])]
        return (min(best)[2], min(best)[0]) if best else None, found

    def match(self, word: str) -> tuple[str, int] | None:
        return self.read(word)[0]


@dataclass
class Model:
    """weights by term; allowed: near words that clean rows use; prior log-odds."""

    weights: dict[str, float]
    allowed: set[str]
    prior: float
    discount: tuple[float, ...] = (1.0, 0.5, 0.4)
    edits: bool = True  # whether misspelled words are found
    _automaton: Automaton | None = field(default=None, repr=False)
    _hit: dict[str, tuple[str, float]] = field(default_factory=dict, repr=False)
    _seen: set[str] = field(default_factory=set, repr=False)

    def learn(self, words: set[str]) -> None:
        """Looks up words not seen yet."""
        if self._automaton is None:
            self._automaton = Automaton(self.weights, self.edits)
        if len(self._seen) > SEEN:
            self._seen.clear()
            self._hit.clear()
        for w in words - self._seen:
            if len(w) >= LONG:
                continue
            term, begins = self._automaton.read(w)
            found = [(self.weights[b], b) for b in begins]
            if term and (term[1] == 0 or w not in self.allowed):
                found.append((self.weights[term[0]] * self.discount[term[1]], term[0]))
            if found:
                self._hit[w] = max(found)[1], max(found)[0]
        self._seen |= {w for w in words if len(w) < LONG}

    def found(self, word: str) -> tuple[str, float] | None:
        """(term, weight) of a word looked up before."""
        if len(word) < LONG:
            return self._hit.get(word)
        if (t := name(word)) in self.weights:
            return t, self.weights[t]
        term, begins = self._automaton.read(word)
        best = [(self.weights[b], b) for b in begins]
        if term:
            best.append((self.weights[term[0]] * self.discount[term[1]], term[0]))
        return (max(best)[1], max(best)[0]) if best else None

    def score(self, text: str) -> float:
        words = set(tokens(text))
        self.learn(words)
        total = self.prior
        if not self._hit.keys().isdisjoint(words) or any(len(w) >= LONG for w in words):
            total += sum(self.hits(text).values())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def hits(self, text: str) -> dict[str, float]:
        """The best weight of each term that occurs, by its context windows."""
        low = text.lower()
        spans = [m.span() for m in TOKEN.finditer(low)]
        places = [(i, *hit) for i, (s, e) in enumerate(spans) if (hit := self.found(low[s:e]))]
        at = [i for i, _, _ in places]
        best: dict[str, float] = {}
        for k, (i, term, weight) in enumerate(places):
            near = 0
            for j in range(k - 1, -1, -1):
                if i - at[j] > WINDOW:
                    break
                near += 1
            for j in range(k + 1, len(at)):
                if at[j] - i > WINDOW or near > 4:
                    break
                near += 1
            if quoted(low, spans, i):
                weight *= 0.25
            else:
                weight *= 1 + 0.1 * min(near, 4)
            best[term] = max(best.get(term, -99.0), weight)
        return best


def quoted(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """Whether the i-th token lies between quotation marks of its window."""
    s, e = spans[i]
    before = QUOTES.findall(text[spans[max(0, i - WINDOW)][0] : s])
    after = QUOTES.search(text[e : spans[min(len(spans) - 1, i + WINDOW)][1]])
    return len(before) % 2 == 1 and after is not None


def count_terms(labelled: DataFrame) -> DataFrame:
    """(text, toxic) -> token, pos, neg: documents of either label with the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(), Counter()
            for x, t in zip(batch.column("text"), batch.column("toxic")):
                seen[t.as_py()].update(features(set(tokens(x.as_py() or ""))))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())],
                ["token", "pos", "neg"],
            )

    return labelled.mapInArrow(run, "token string, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def count_contexts(texts: DataFrame, candidates: set[str]) -> DataFrame:
    """token, contexts: the different words that precede it.  Copies of a document
    repeat its words with their neighbours, so they add documents, not contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for x in batch.column("text"):
                before = ""
                for w in tokens(x.as_py() or ""):
                    found.update((f, before) for f in features({w}) if f in candidates)
                    before = name(w)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["token", "before"])

    return texts.mapInArrow(run, "token string, before string").distinct().groupBy("token").agg(F.count("*").alias("contexts"))


def count_groups(toxic: DataFrame, candidates: set[str]) -> tuple[DataFrame, int]:
    """(doc_id, text) -> token, groups: the near-duplicate groups of documents with
    it; and the number of groups.  Copies of a document, exact or nearly so, are one
    group, however many they are; other documents count one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(set(tokens(x.as_py() or ""))) & candidates) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "text", "found"])

    docs = toxic.select("doc_id", "text").mapInArrow(run, f"doc_id {toxic.schema['doc_id'].dataType.simpleString()}, text string, found array<string>")
    groups = materialise(labelled(docs).select("found", F.col("__label").alias("label")), "toxic-groups")
    each = groups.select(F.explode("found").alias("token"), "label").distinct().groupBy("token").agg(F.count("*").alias("groups"))
    return each, groups.select("label").distinct().count()


def _weight(pos: Column, neg: Column, toxic: Column | int, clean: int) -> Column:
    """Log-odds of a term's documents, less their standard error."""
    rest = lambda n, x: F.greatest(F.lit(n) - x, F.lit(0)) + 0.5
    odds = F.log((pos + 0.5) / rest(toxic, pos)) - F.log((neg + 0.5) / rest(clean, neg))
    return odds - F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 40_000, min_docs: int = 3, sure: int = 10, share: float = 0.05, least: float = 2.5, precision: float = 0.9) -> Model:
    """A model from the labelled rows that are not held out.

    At most about ``fit_rows`` of them, by a hash of their ids.  A term needs
    ``min_docs`` toxic documents, ``precision`` of its documents toxic and a
    weight (log-odds less their standard error) of ``least``, toxic documents counting by
    near-duplicate groups where these are ``share`` of all and at least ``sure``, else
    no more than the term has contexts.  Rows with null ids, texts or labels teach nothing;
    of different labels of one id the toxic one counts.  Terms and exceptions are
    those of the sample, all of them; a document's text counts once a row.
    """
    y = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.filter(fold("doc_id", 3) != 1)
    n = y.count()
    part = min(1.0, fit_rows / max(1, n))
    y = materialise(y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)), "toxic-labels")
    # fit_rows bounds the labels (12 bytes a row), so texts need no shuffle to meet them
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").filter("text IS NOT NULL").select("doc_id", "text", "toxic")
    terms = materialise(count_terms(rows), "toxic-terms")
    pos, neg = (y.filter(f"toxic = {k}").count() for k in (1, 0))
    good = terms.filter((F.col("pos") >= min_docs) & (F.col("pos") >= precision * (F.col("pos") + F.col("neg"))))
    good = good.withColumn("w", _weight(F.col("pos"), F.col("neg"), pos, neg)).filter(F.col("w") >= least)
    candidates = {r.token for r in good.select("token").collect()}
    contexts = count_contexts(rows.filter("toxic = 1").select("text"), candidates)
    seen, groups = count_groups(rows.filter("toxic = 1"), candidates)
    # passages copied into other documents make no near-duplicates: rarer terms need contexts
    common = F.col("groups") >= max(sure, share * groups)
    good = good.join(seen, "token").join(contexts, "token")
    good = good.withColumn("pos", F.when(common, F.col("groups")).otherwise(F.least("pos", "contexts"))).filter(F.col("pos") >= min_docs)
    good = good.withColumn("w", _weight(F.col("pos"), F.col("neg"), F.when(common, groups).otherwise(pos), neg))
    found = good.filter(F.col("w") >= least).select("token", "w").collect()
    weights = {r.token: float(r.w) for r in found}

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = Automaton(weights)
        for p in parts:
            yield p[[w[-1] != "*" and w not in weights and a.match(w) is not None for w in p["token"]]]

    allowed = {r.token for r in terms.filter("neg > 0").select("token").mapInPandas(near, "token string").collect()}
    return Model(weights, allowed, math.log((pos + 0.5) / (neg + 0.5)))


SENT = 4 << 20  # characters of text that leave a worker at once


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, name: str = "score") -> DataFrame:
    """The columns of ``docs``, without the text unless kept, with ``name`` double.
    Null texts score as empty ones, by the prior; repeated rows repeat; an empty
    table gives an empty one; a column of that name is replaced."""
    names = [c for c in docs.columns if (c != text or keep_text) and c != name]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, made, chars = 0, [], 0

            def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([rows.column(n) for n in names] + [pa.array(made, pa.float64())], [*names, name])

            for i, x in enumerate(batch.column(text)):
                t = x.as_py() or ""
                made.append(model.score(t))
                chars += len(t)
                if chars >= SENT:
                    yield packed(batch.slice(first, i + 1 - first))
                    first, made, chars = i + 1, [], 0
            if made:
                yield packed(batch.slice(first))

    return docs.mapInArrow(run, schema)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document.  Null texts score as empty
    ones, null ids are of the fold of the empty text; repeated rows repeat; other
    columns are ignored."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.7 or more; columns of any name stay as
    they are, null and empty texts stay, an empty table gives an empty one."""
    own = fresh_names(docs, "toxicity")[0]
    return score(docs, fit(docs, labels), keep_text=True, name=own).filter(F.col(own) < 0.7).select(*[F.col(f"`{c}`") for c in docs.columns])
