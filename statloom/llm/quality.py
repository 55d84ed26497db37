"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in tasks, and written as a narrow table. The trees are fitted on at most
`sample` labelled rows (a documented bound, drawn by a hash of the id), flattened into arrays and broadcast: a tree of depth d has
2**d - 1 inner nodes and 2**d leaves, so the size of the model does not depend on the data. Scoring walks all rows of a
batch through a tree at once.

Defined cases: null and empty texts have the statistics of an empty text and are scored like any other. Null labels and
null ids are not learned from; repeated and contradictory labels count each. No labelled rows: every score is 0.5. One class
only: scores near that class. Ties between splits: the first. Very long texts are read whole, an empty table gives none. Columns beyond
those named are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import map_rows

STATISTICS = [
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "space_share", "mark_share", "symbol_share", "other_share",
    "caps_words", "marked_words", "unlettered_words", "distinct_words", "top_word", "top_pair", "repeated_next", "longest_run",
    "log_lines", "line_words", "repeated_lines", "ended_lines", "byte_entropy", "long_words",
]
SAMPLE = 50_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.2

_KIND = np.full(256, 5)
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 6
_KIND[ord("A"):ord("Z") + 1] = 0
_KIND[ord("0"):ord("9") + 1] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS for one text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256).astype(float)
    size = max(len(raw), 1)
    kinds = np.bincount(_KIND, seen, 7) / size
    share = seen[seen > 0] / size
    found = text.split()
    n = max(len(found), 1)
    counted = Counter(found)
    pairs = Counter(pairwise(found))
    longest = run = 0
    before = None
    same = 0
    for w in found:
        if w == before:
            same += 1
            run += 1
        else:
            run = 1
        if run > longest:
            longest = run
        before = w
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    caps = marked = bare = long = 0
    for w, c in counted.items():  # distinct words only
        if len(w) > 1 and w.isupper():
            caps += c
        if w[-1] in "#$%&*!|~^":
            marked += c
        if not any(map(str.isalpha, w)):
            bare += c
        if len(w) > 20:
            long += c
    return (
        float(np.log1p(len(text))), float(np.log1p(len(found))), sum(map(len, found)) / n, kinds[0], kinds[1], kinds[2], kinds[3], kinds[4],
        kinds[5], caps / n, marked / n, bare / n, len(counted) / n, max(counted.values(), default=0) / n, max(pairs.values(), default=0) / n,
        same / n, float(np.log1p(longest)), float(np.log1p(len(lines))), len(found) / m, 1.0 - len(set(lines)) / m,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / m, float(-(share * np.log(share)).sum()) if len(raw) else 0.0, long / n,
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the statistics of text as an array."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", stats array<double>"

    def make():
        return lambda *row: (*row[:-1], [float(x) for x in statistics(row[-1])])

    return map_rows(docs.select(*keep, "text"), make, schema)


class Trees:
    """Flattened boosted trees of equal depth: node i has the children 2i+1 and 2i+2."""

    def __init__(self, base: float, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.cuts, self.leaves = base, features, cuts, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if self.leaves.size else 0
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2 ** depth - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned values; x: rows by statistics, y: 0 or 1."""
    inner, width = 2 ** depth - 1, x.shape[1] if x.ndim == 2 else 0
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)])  # value > edge[b - 1]
    total = np.full(len(y), base)
    made = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, cut, place = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            nodes, first = 2 ** level, 2 ** level - 1
            best = np.zeros(nodes)
            at = place - first
            for j in range(width):
                g = np.bincount(at * bins + binned[j], grad, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                h = np.bincount(at * bins + binned[j], hess, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                gain = g ** 2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(h < 1.0) | (h[:, -1:] - h < 1.0)] = 0.0
                gain = gain[:, :len(edges[j])]
                if not gain.shape[1]:
                    continue
                where = gain.argmax(axis=1)
                value = gain[np.arange(nodes), where]
                for k in np.flatnonzero(value > best + 1e-9):
                    best[k], feature[first + k], cut[first + k] = value[k], j, edges[j][where[k]]
            place = 2 * place + 1 + (x[np.arange(len(y)), feature[place]] > cut[place])
        at = place - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf = -rate * g / (h + ridge)
        total = total + leaf[at]
        made.append((feature, cut, leaf))
    return Trees(base, *(np.stack(z) for z in zip(*made, strict=True)))


def bounded_sample(rows: DataFrame, sample: int) -> DataFrame:
    """`sample` rows at most, those of the smallest hashes of all their values: the same rows each time, and as many whatever their ids are. Rows with
    equal values are alike, so it does not matter which of them are taken. Only hashes are put in order; rows stay where they are."""
    names = rows.columns
    hashed = rows.withColumn("_hash", F.xxhash64(*names))
    least = hashed.select("_hash").orderBy("_hash").limit(sample)
    last = least.agg(F.max("_hash").alias("last"), F.count(F.lit(1)).alias("n")).first()
    if last["n"] < sample:
        return rows
    at_last = sample - least.filter(F.col("_hash") < last["last"]).count()
    return hashed.filter(F.col("_hash") < last["last"]).unionByName(hashed.filter(F.col("_hash") == last["last"]).limit(at_last)).select(*names)


def score_statistics(table: DataFrame, trees: Trees, keep: list[str], threshold: float) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast(trees)
    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int"

    def run(batches):
        for b in batches:
            x = np.array([list(v) for v in b["stats"]], dtype=float).reshape(len(b), len(STATISTICS))
            score = sent.value.score(x)
            yield b[keep].assign(score=score, predicted=(score >= threshold).astype("int32"))

    return table.select(*keep, "stats").mapInPandas(run, schema)


def classify(docs: DataFrame, labelled: DataFrame, keep: list[str], threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Scores every text. labelled: doc_id and quality (0 or 1) of the rows to learn from; keep must name doc_id."""
    from statloom.session import cut

    stats = cut(with_statistics(docs, keep), "quality")
    wanted = labelled.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).filter("_y IN (0, 1)")
    rows = cut(stats.select("doc_id", "stats").join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "stats", "_y"), "quality-train")
    train: pd.DataFrame = bounded_sample(rows, sample).toPandas().sort_values("doc_id", kind="stable")
    x = np.array([list(v) for v in train["stats"]], dtype=float).reshape(len(train), len(STATISTICS))
    return score_statistics(stats, fit(x, train["_y"].to_numpy(float)), keep, threshold)
