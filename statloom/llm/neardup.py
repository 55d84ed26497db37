"""Near-duplicate documents by Order MinHash.

K-mers are runs of five words (a shorter text is one k-mer); a k-mer carries its occurrence number, so repeats differ. A sketch
takes the PICKED k-mers of smallest hash and keeps them in text order: texts share a sketch when they share those k-mers and their
order, which follows edit similarity. SKETCHES sketches per text are the keys under which texts meet.

Texts of equal words are one first; the rest works on distinct texts. Candidates are verified by a banded alignment of the labelled k-mers: the
longest common order-preserving run of them gives matched / (all k-mers of both - matched), which must reach 0.8. Outside the
band (more unmatched k-mers than that similarity allows) nothing is aligned.

Buckets are compared as the groups of llm.jaccard are, in blocks: texts that buckets connect are one block if they fit into it; beyond that a bucket is dealt
to blocks, first each text to one, then the texts of every bucket that is not of one class yet. In a block the labelled k-mers are in a prefix tree, which leaves
pairs that cannot reach 0.8 by their k-mers alone, and pairs of one class; the alignment decides on the others. So a bucket's links are all found, no pairs
leave a task, and a bucket of one class costs no more than its texts. Links become classes, named after their smallest id.

A pair with u different k-mers, i of them common, shares no sketch with chance (1 - C(i, PICKED) / C(u, PICKED))**SKETCHES: at 0.8 from 1.1e-4 where
the shorter text has SHORT k-mers to 7e-5 for the longest. Below SHORT k-mers sketches miss far more (always, where a text has fewer than
PICKED), so these also have the keys of equal parts of llm.jaccard, by which two texts whose k-mers reach 0.8 always meet.

Defined cases: texts without words (null, empty, marks only) are in no group: each is its own class. Rows without id are left
out of groups and get a null class. A repeated id: each row goes by its own text. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import jaccard
from statloom.llm.common import map_rows, mix, words
from statloom.session import cut

K = 5
PICKED = 5
SKETCHES = 24
SIMILARITY = 0.8
SHORT = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value


def labelled_kmers(found: list[str], known: Hashes, k: int = K) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in text order."""
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = mix(out * _SPREAD + h[j:len(h) - k + 1 + j])
        order = np.argsort(out, kind="stable")
        ranked = out[order]
        new = np.ones(len(out), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if not new.all():
            first = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
            number = np.empty(len(out), np.uint64)
            number[order] = (np.arange(len(out)) - first).astype(np.uint64)
            out = mix(out + number * _SPREAD)
    return out


def sketches(kmers: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One value per sketch: the hash of the picked k-mers in text order."""
    take = min(picked, len(kmers))
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * _SPREAD)
        out = np.empty(count, np.uint64)
        step = max(1, 2_000_000 // max(len(kmers), 1))  # bounded memory for long texts
        for s in range(0, count, step):
            h = mix(kmers[None, :] ^ seeds[s:s + step, None])
            at = np.argpartition(h, take - 1, axis=1)[:, :take] if take < len(kmers) else np.broadcast_to(np.arange(take), (len(h), take))
            ordered = kmers[np.sort(at, axis=1)]
            value = np.full(len(h), take, np.uint64)
            for j in range(take):
                value = mix(value * _SPREAD + ordered[:, j])
            out[s:s + step] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two labelled k-mer sequences by banded alignment; 0 if it stays below least."""
    both = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    needed = least / (1 + least) * both
    if min(len(a), len(b)) < needed - 1e-9:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < needed - 1e-9:
        return 0.0
    band = both - 2 * needed + 1  # more unmatched k-mers than this cannot reach least
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    inside = np.abs(at_a - at_b) <= band
    ends: list[int] = []
    for j in at_b[inside].tolist():  # longest increasing run of places: labelled k-mers are unique
        k = bisect_left(ends, j)
        if k == len(ends):
            ends.append(j)
        else:
            ends[k] = j
    similarity = len(ends) / (both - len(ends))
    return similarity if similarity >= least - 1e-12 else 0.0


def digest(found: list[str]) -> str:
    return hashlib.blake2b("\n".join(found).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def signatures(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, n, sketch, parts): n k-mers; digest is null for texts without words; parts: keys of the equal parts of short texts."""

    def make():
        known, cuts = Hashes(), jaccard.Cuts(percent(least))

        def f(doc_id, text):
            found = words(text)
            if not found:
                return doc_id, None, None, None, []
            kmers = labelled_kmers(found, known)
            # who has fewer than SHORT k-mers is only near texts of up to SHORT / least
            keys = cuts.keys(np.sort(kmers)) if len(kmers) <= SHORT / least else []
            parts = np.concatenate([k for _, k in keys]).view(np.int64).tolist() if keys else []
            return doc_id, digest(found), len(kmers), sketches(kmers).view(np.int64).tolist(), parts

        return f

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, digest string, n long, sketch array<long>, parts array<long>")


def percent(least: float) -> int:
    """The share of common k-mers that a similarity needs at least, in whole percent."""
    return int(least * 100 + 1e-9)


def by_alignment(least: float):
    """How the texts of a block are measured: by their k-mers in the tree, then by the alignment."""

    def make():
        known = Hashes()

        def read(text):
            kmers = labelled_kmers(words(text), known)
            return np.sort(kmers), kmers

        return read, lambda a, b: aligned(a, b, least) > 0

    return make


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest id of its class), copy_id (smallest id among equal texts)."""
    sig = cut(signatures(docs, least), "signatures")
    known = sig.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = cut(known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("size"), F.first("sketch").alias("sketch"), F.first("parts").alias("parts"))
               # a repeated id with several texts is told apart by the digest: nodes are hashes of both
               .withColumn("id", F.xxhash64("first_id", "digest")), "reps")
    bands = reps.select("id", F.posexplode("sketch").alias("place", "value")).select(F.xxhash64("place", "value").alias("key"), "id")
    bands = bands.unionByName(reps.select(F.explode("parts").alias("value"), "id").select(F.xxhash64(F.lit("part"), "value").alias("key"), "id"))
    # nearly all keys are of one text and leave here: what is counted is short, and the others are few
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    bands = cut(bands.join(shared.hint("merge"), "key", "left_semi"), "shared")
    met = cut(bands.join(jaccard.crowds(bands), "key").join(reps.select("id", "size"), "id"), "met")
    asked = cut(reps.join(met.select("id").distinct(), "id", "left_semi").select("id", F.col("first_id").alias("doc_id"), "digest"), "asked")
    # who is asked for grows with the input: these joins never broadcast, so the plan is the same at every size
    raw = docs.select("doc_id", "text").join(asked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")

    def make():
        return lambda doc_id, text: (doc_id, digest(words(text)), text)

    told = map_rows(raw, make, "doc_id long, digest string, text string", chunk=200)
    texts = cut(told.join(asked.hint("merge"), ["doc_id", "digest"]).select("id", "text").dropDuplicates(["id"]), "texts")
    labels = jaccard.linked(met, texts, percent(least), by_alignment(least)).withColumnRenamed("node", "id")
    named = labels.join(reps.select("id", "first_id"), "id").groupBy("label").agg(F.min("first_id").alias("class_id"))
    of = labels.join(named, "label").select("id", "class_id")
    of = cut(reps.select("id", "digest", "first_id").join(of, "id", "left").select("digest", "first_id", F.coalesce("class_id", "first_id").alias("class_id")), "classes")
    rows = sig.select("doc_id", "digest").join(of, "digest", "left")
    grouped = F.col("doc_id").isNotNull()
    return rows.select("doc_id", F.when(grouped, F.coalesce("class_id", "doc_id")).alias("class_id"),
                       F.when(grouped, F.coalesce("first_id", "doc_id")).alias("copy_id"))
