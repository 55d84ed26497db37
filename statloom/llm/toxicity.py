"""Toxicity scores from a learned lexicon, met through Levenshtein automata.

Terms are whole words, and stems where a language hides a root behind changing endings. They are learned from labelled texts: a
term must occur in at least `support` of the toxic texts (so there are at most 1/support times a text's terms of them) and
be far more frequent there than elsewhere. The distance-1 Levenshtein automata of the words are intersected with their trie: the
product is determinised lazily, so a word of a text is a walk through a table that mostly ends after a few letters. Misspellings
that are words of clean texts are struck out.

Every hit is weighed in its context window: inside quotation marks it counts little, near other hits more. A logistic
regression turns total strength, density and the strongest window into a score.

Labelled rows: `sample` at most (a documented bound, those of the smallest hashes), so the ids can be broadcast; texts are not moved.

Defined cases: null and empty texts score like a text without hits. Null labels and ids are not learned from. Without
toxic or without clean labelled texts nothing can be learned: every score is 0. Repeated rows are scored each. Ties between near terms: the first in order. Very long
texts are read whole. An empty table gives none. Columns beyond doc_id, text and those to keep are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import WORD, count_in_tasks, lower_ascii, map_rows, words
from statloom.llm.quality import bounded_sample

SAMPLE = 50_000
SUPPORT = 0.02
ODDS = 20.0
STEM_LENGTHS = (4, 5, 6, 7, 8)
FUZZY_LENGTH = 5
FUZZY, QUOTED = 0.7, 0.2
WINDOW = 20
# Quotation marks: opening ones with what closes them.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}


class Matcher:
    """Words within one edit of a term of the trie, and words that begin with a stem. Whole words are in the trie also where a stem covers them, so that
    their misspellings are met; a stem itself is met as it is written, for with an edit it would take in clean words."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: frozenset[str] = frozenset()):
        self.terms, self.stems, self.clean = terms, stems, clean
        self.stem_lengths = sorted({len(s) for s in stems})
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        for term in sorted(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.term_at[node] = term
        self.alphabet = {c for t in terms for c in t}
        self.start = self._closed({0: 0})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.seen: dict[str, tuple | None] = {}

    def _closed(self, state: dict[int, int]) -> frozenset:
        """With the terms' letters that may be left out: one edit each."""
        for node, edits in list(state.items()):
            if edits == 0:
                for child in self.children[node].values():
                    state[child] = min(state.get(child, 1), 1)
        return frozenset(state.items())

    def _move(self, state: frozenset, c: str) -> frozenset:
        c = c if c in self.alphabet else ""
        known = self.moves.get((state, c))
        if known is None:
            new: dict[int, int] = {}
            for node, edits in state:
                for letter, child in self.children[node].items():
                    cost = edits + (letter != c)
                    if cost <= 1:
                        new[child] = min(new.get(child, 1), cost)
                if edits == 0:
                    new[node] = min(new.get(node, 1), 1)
            known = self._closed(new)
            if len(self.moves) > 200_000:
                self.moves.clear()
            self.moves[state, c] = known
        return known

    def look(self, word: str) -> tuple[str, float, bool] | None:
        """(term, weight, misspelled) or None."""
        if word in self.seen:
            return self.seen[word]
        hit = None
        if word in self.terms:
            hit = (word, self.terms[word], False)
        else:
            for n in self.stem_lengths:
                if word[:n] in self.stems and len(word) >= n:
                    hit = (word[:n], self.stems[word[:n]], False)
                    break
            if hit is None and len(word) >= FUZZY_LENGTH - 1 and word not in self.clean:
                state = self.start
                for c in word:
                    state = self._move(state, c)
                    if not state:
                        break
                near = sorted(self.term_at[node] for node, _ in state if node in self.term_at and len(self.term_at[node]) >= FUZZY_LENGTH)
                if near:
                    hit = (near[0], FUZZY * max(self.terms[t] for t in near), True)
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[word] = hit
        return hit


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of one line, without nesting."""
    spans, opened, closer = [], 0, ""
    for i, c in enumerate(text):
        if c == "\n":
            closer = ""
        elif closer:
            if c == closer:
                spans.append((opened, i))
                closer = ""
        elif c in QUOTES:
            opened, closer = i, QUOTES[c]
    return spans


def hits(text: str | None, matcher: Matcher) -> tuple[int, list[tuple[int, str, float, bool, bool]]]:
    """Number of words, and the hits: (word number, word, weight, misspelled, quoted)."""
    if not text:
        return 0, []
    lowered = lower_ascii(text)
    found = WORD.findall(lowered)
    if not any(matcher.look(w) for w in set(found)):
        return len(found), []
    spans = quoted_spans(text)
    starts = [s for s, _ in spans]
    out = []
    for i, m in enumerate(WORD.finditer(lowered)):
        hit = matcher.look(m.group())
        if hit:
            k = bisect_right(starts, m.start()) - 1
            out.append((i, m.group(), hit[1], hit[2], k >= 0 and m.start() < spans[k][1]))
    return len(found), out


def features(n_words: int, found: list[tuple[int, str, float, bool, bool]], clean: frozenset[str] = frozenset()) -> list[float]:
    """Strength of all hits, per hundred words, and in the strongest window of WINDOW words."""
    weighed = [(i, w * (QUOTED if q else 1.0)) for i, word, w, fuzzy, q in found if not (fuzzy and word in clean)]
    total = sum(w for _, w in weighed)
    best = inside = 0.0
    first = 0
    for i, w in weighed:
        inside += w
        while weighed[first][0] <= i - WINDOW:
            inside -= weighed[first][1]
            first += 1
        best = max(best, inside)
    return [math.log1p(total), math.log1p(100 * total / max(n_words, 1)), math.log1p(best)]


def terms_of(text: str | None) -> tuple[set[str], set[str]]:
    whole = set(words(text))
    return whole, {w[:n] for w in whole for n in STEM_LENGTHS if len(w) > n}


def learn_terms(train: DataFrame, support: float = SUPPORT, odds: float = ODDS) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their log-odds. train: text and _y (1 toxic)."""
    sizes = {int(r["_y"]): r["n"] for r in train.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}, {}

    def counted(rows: DataFrame, only) -> DataFrame:
        sent = only

        def make():
            seen: Counter = Counter()
            known = sent.value if sent else None

            def feed(text):
                whole, stems = terms_of(text)
                if known is not None:
                    whole, stems = whole & known[0], stems & known[1]
                seen.update((w, False) for w in whole)
                seen.update((s, True) for s in stems)

            def drain():
                rows = [(w, stem, n) for (w, stem), n in seen.items()]
                seen.clear()
                return rows

            return feed, drain, lambda: len(seen)

        part = count_in_tasks(rows.select("text"), make, "term string, stem boolean, n long")
        return part.groupBy("term", "stem").agg(F.sum("n").alias("n"))

    least = max(3.0, support * toxic)
    frequent = counted(train.filter("_y = 1"), None).filter(F.col("n") >= least).collect()  # bounded by support
    in_toxic = {(r["term"], r["stem"]): r["n"] for r in frequent}
    known = ({t for t, s in in_toxic if not s}, {t for t, s in in_toxic if s})
    sent = train.sparkSession.sparkContext.broadcast(known)
    in_other = {(r["term"], r["stem"]): r["n"] for r in counted(train.filter("_y = 0"), sent).collect()}
    weight = {k: math.log((n / toxic) / ((in_other.get(k, 0) + 0.5) / (other + 1))) for k, n in in_toxic.items()}
    strong = {k: w for k, w in weight.items() if w >= math.log(odds)}
    whole = {t: w for (t, s), w in strong.items() if not s}
    stems: dict[str, float] = {}
    for (t, s), w in sorted(strong.items(), key=lambda x: (len(x[0][0]), x[0][0])):
        if s and not any(t.startswith(p) for p in stems):
            largest = max((n for (x, xs), n in in_toxic.items() if not xs and x.startswith(t)), default=0)
            if in_toxic[t, True] >= 1.3 * largest:  # many endings, not one word
                stems[t] = w
    return whole, stems


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps for the ridge-penalised logistic loss; the last weight is the constant."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_texts(docs: DataFrame, matcher: Matcher | None, weights: np.ndarray | None, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((matcher, weights))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int, n_hits long"

    def make():
        m, w = sent.value

        def f(*row):
            if m is None:
                return (*row[:-1], 0.0, 0, 0)
            n, found = hits(row[-1], m)
            z = float(np.dot(features(n, found), w[:-1]) + w[-1])
            score = 1.0 / (1.0 + math.exp(-min(max(z, -30.0), 30.0)))
            return (*row[:-1], score, int(score >= 0.5), len(found))

        return f

    return map_rows(docs.select(*keep, "text"), make, schema)


def classify(docs: DataFrame, labelled: DataFrame, keep: list[str], sample: int = SAMPLE) -> DataFrame:
    """Scores every text: score, predicted, n_hits. labelled: doc_id and toxic (0 or 1) of the rows to learn from."""
    from statloom.session import cut

    wanted = labelled.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    wanted = bounded_sample(wanted.filter("_y IN (0, 1) AND _id IS NOT NULL").distinct(), sample)
    # `sample` ids at most, so they can be sent to every task; an id that many rows have still gives `sample` rows at most
    train = cut(docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y"), "toxic-train")
    train = bounded_sample(train, sample)
    whole, stems = learn_terms(train)
    if not whole and not stems:
        return score_texts(docs, None, None, keep)
    sent = docs.sparkSession.sparkContext.broadcast(Matcher(whole, stems))

    def make():
        return lambda doc_id, y, text: (doc_id, y, *found(text))

    def found(text):
        n, h = hits(text, sent.value)
        return n, [x[0] for x in h], [x[1] for x in h], [x[2] for x in h], [x[3] for x in h], [x[4] for x in h]

    rows = map_rows(train.select("doc_id", "_y", "text"), make,
                    "doc_id long, y int, n long, places array<long>, words array<string>, weights array<double>, fuzzy array<boolean>, quoted array<boolean>")
    # one row per distinct text and label would do; the sample bounds the rows
    got = [(r["y"], r["n"], list(zip(r["places"], r["words"], r["weights"], r["fuzzy"], r["quoted"], strict=True)))
           for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["y"], r["n"]))]
    seen = {y: Counter(w for label, _, h in got if label == y for w in {x[1] for x in h if x[3]}) for y in (0, 1)}
    sizes = {y: sum(label == y for label, _, _ in got) for y in (0, 1)}
    clean = frozenset(w for w, n in seen[0].items() if n and (seen[1][w] + 0.5) / (sizes[1] + 1) < 5 * n / (sizes[0] + 1))
    x = np.array([features(n, h, clean) for _, n, h in got])
    y = np.array([label for label, _, _ in got], dtype=float)
    return score_texts(docs, Matcher(whole, stems, clean), logistic(x, y), keep)
