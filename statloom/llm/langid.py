"""Language identification with interpolated Kneser-Ney character models.

One model per language, over the letters of words: a word is read with start marks before it and an end mark behind it, so a word's log-probability
depends on the word alone. Texts are read as arrays of code points, many at a time: every character's window is hashed and met with the n-grams there, and no
word becomes a Python value (`letter_words` is the plain form of that reading). Each language's model is kept in sorted hash arrays: blocks of the hash range, each a row with the
sorted 64-bit hashes of n-grams, their discounted probabilities, and their back-off weights as contexts. The language with the lowest
cross-entropy per character wins. Its limit for rejection is a quantile of what its own training texts have under its model.

Counts cover every training text and every n-gram is kept: counts, continuation counts, discounts and back-off weights are aggregations of tables, and the
model grows with the corpus. Every n-gram of the texts gets its interpolated log-probabilities once. Those with a share of at least `common` of all
occurrences (so at most 1/common) are sent to the tasks, as a sorted hash array; texts meet the others by a join, in which no n-gram is frequent.

Defined cases: null or empty text, or a text without a letter: `und`, score 0. Null lang: not learned from. No training
rows: every text is `und`. Ties between languages: the first in sorted order. Repeated rows are scored each, and counted each.
Very long texts and words are read whole. Empty table: no rows. Columns beyond text, lang and those to keep are not read, and those to keep may have any name.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import count_in_tasks, mix
from statloom.session import cut

ORDER = 5
START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))  # all ASCII but letters as space
SHARPNESS = 12.0
REJECT = 0.001
COMMON = 1e-6
BLOCK = 1 << 16
PIECE = 1 << 18
_B = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str | None) -> list[str]:
    """Lower-cased letter runs; none if no character is a letter. The words whose windows `read` gives, as strings."""
    if not text:
        return []
    lowered = text.lower()
    found = lowered.encode("utf-8", "surrogatepass").translate(_SPACED).decode("utf-8", "surrogatepass").split()  # white space beyond ASCII is no letter either
    if not lowered.isascii():
        found = [w for part in found for w in ((part,) if part.isalpha() else LETTERS.findall(part))]
    return found if any(any(c.isalpha() for c in w) for w in found) else []


def window_hashes(text: str, order: int) -> np.ndarray:
    """For each character of the text from the `order`-th on, a hash of the `order` characters that end there."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(codes) - order + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        codes = mix(codes + np.uint64(1))
        for k in range(order):
            h = h * _B + codes[k:k + n]
        return mix(h).view(np.int64)


@functools.cache
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 2 for a letter, 1 for another character of a run, 0 for all else; and its mixed value, for all else that of the end mark."""
    n = sys.maxunicode + 1
    kinds, mixed = np.zeros(n, np.uint8), mix(np.arange(1, n + 1, dtype=np.uint64))
    for start in range(0, n, 1 << 12):
        for run in LETTERS.finditer("".join(map(chr, range(start, min(start + (1 << 12), n))))):
            kinds[start + run.start():start + run.end()] = [1 + c.isalpha() for c in run[0]]
    mixed[kinds == 0] = mixed[ord(END)]
    return kinds, mixed


def letter_windows(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where the windows of words end (each letter, and the character behind a word) and their hashes, as `window_hashes` of the padded word has them."""
    mixed = code_points()[1]
    last = mixed.take(codes, mode="clip")
    inside = last != mixed[ord(END)]
    heads = np.append(0, np.flatnonzero(~inside[:-1]) + 1)  # where no word goes on
    mark, pad, h = int(mix(np.array([ord(START) + 1], np.uint64))[0]), 0, last
    for _ in range(order - 1):  # a window is its last character and the shorter window before it, which is all start marks at the head of a word
        pad = (pad * int(_B) + mark) % 2**64
        before = np.empty_like(last)
        np.multiply(h[:-1], _B, out=before[1:])
        before[heads] = pad * int(_B) % 2**64
        before += last
        h = before
    ends = inside.copy()
    ends[1:] |= inside[:-1]
    at = np.flatnonzero(ends)
    return at, mix(h.take(at, mode="clip")).view(np.int64)


def read(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice, np.ndarray]]:
    """The windows of all words of lower-cased texts, PIECE characters at a time: codes of the texts, places of the windows in them, their hashes, the
    texts that the piece meets, and how many of the windows each of these has. A text without a letter has none."""
    if not texts:
        return
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lengths)
    kinds = np.concatenate([code_points()[0].take(codes[start:start + PIECE], mode="clip") for start in range(0, len(codes), PIECE)])
    lettered = np.maximum.reduceat(kinds, ends - lengths) == 2
    if not lettered.all():
        codes = np.where(np.repeat(lettered, lengths), codes, np.uint32(ord("\n")))
    for start in range(0, len(codes), PIECE):
        stop, lead = min(start + PIECE, len(codes)), min(start, order)
        at, hashes = letter_windows(codes[start - lead:stop], order)
        first = np.searchsorted(at, lead)
        at, hashes = at[first:] + (start - lead), hashes[first:]
        owners = slice(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop - 1, "right")) + 1)
        yield codes, at, hashes, owners, np.diff(np.searchsorted(at, ends[owners.start:owners.stop - 1]), prepend=0, append=len(at))


def grams_at(codes: np.ndarray, at: np.ndarray, order: int) -> list[str]:
    """The windows that end at the given places, with their marks."""
    kinds = code_points()[0]
    found = codes[np.maximum(at[:, None] + np.arange(1 - order, 1), 0)]
    within = at >= 0
    for k in range(2, order + 1):
        within = within & (at >= k - 1) & (kinds[found[:, -k]] > 0)
        found[~within, -k] = ord(START)
    found[kinds[found[:, -1]] == 0, -1] = ord(END)
    return found.view(f"<U{order}")[:, 0].tolist()


class Places:
    """Numbers 64-bit hashes from 0 on, whole arrays at a time; at most half of the slots are taken."""

    def __init__(self):
        self.size, self.bits = 0, 0
        self.keys, self.slots = np.empty(0, np.int64), np.empty(0, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).view(np.int64)

    def _put(self, numbers: np.ndarray) -> None:
        at = self._home(self.keys[numbers])
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) % len(self.slots)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of new keys."""
        numbers = np.arange(self.size, self.size + len(keys))
        if 2 * (self.size + len(keys)) >= len(self.slots):
            self.bits = max(12, (4 * (self.size + len(keys))).bit_length())
            self.keys, old = np.zeros(1 << self.bits - 1, np.int64), self.keys
            self.keys[:self.size] = old[:self.size]
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._put(np.arange(self.size))
        self.keys[numbers] = keys
        self.size += len(keys)
        self._put(numbers)
        return numbers

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for those not added."""
        if not self.size:
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        found = self.slots.take(at, mode="clip")
        off = np.flatnonzero(self.keys.take(found, mode="clip") != keys)
        off = off[found[off] >= 0]
        at = at[off]
        while len(off):
            at = (at + 1) % len(self.slots)
            found[off] = other = self.slots[at]
            on = (other >= 0) & (self.keys[other] != keys[off])
            off, at = off[on], at[on]
        return found


class Counts:
    """Occurrences of the n-grams of texts, by lang: for `count_in_tasks`."""

    def __init__(self, order: int):
        self.order = order
        self.clear()

    def clear(self) -> None:
        self.places, self.counts, self.named = Places(), np.zeros(0, np.int64), []
        self.langs: dict[str | None, int] = {}
        self.waiting: list[tuple[int, str]] = []
        self.held = 0

    def feed(self, lang: str | None, text: str) -> None:
        self.waiting.append((self.langs.setdefault(lang, len(self.langs)), text.lower()))
        self.held += len(text) + 1
        if self.held >= PIECE:
            self.count()

    def count(self) -> None:
        owner = np.array([i for i, _ in self.waiting], np.uint64)
        seeds, names = mix(owner + np.uint64(1)).view(np.int64), list(self.langs)
        for codes, at, hashes, owners, sizes in read([t for _, t in self.waiting], self.order):
            keys = hashes ^ np.repeat(seeds[owners], sizes)
            found = self.places.find(keys)
            new = np.flatnonzero(found < 0)
            if len(new):
                fresh, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
                found[new] = self.places.add(fresh)[which]
                some = new[first]
                spoken = np.repeat(owner[owners], sizes)[some].tolist()
                self.named.extend(zip([names[i] for i in spoken], grams_at(codes, at[some], self.order), strict=True))
            grown = np.bincount(found, minlength=self.places.size)
            grown[:len(self.counts)] += self.counts
            self.counts = grown
        self.waiting, self.held = [], 0

    def drain(self) -> Iterator[tuple[str | None, str, int]]:
        self.count()
        for (lang, gram), n in zip(self.named, self.counts.tolist(), strict=True):
            yield lang, gram, n
        self.clear()

    def size(self) -> int:
        return self.places.size


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all texts with columns lang and text; a null lang is counted too."""

    def make():
        counts = Counts(order)
        return counts.feed, counts.drain, counts.size

    partial = count_in_tasks(texts.select("lang", "text").filter("text IS NOT NULL"), make, "lang string, gram string, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, c): occurrences of the longest n-grams, and for shorter ones the number of different characters before them."""
    level = counted.filter("lang IS NOT NULL").select("lang", "gram", F.col("n").alias("c"))
    out = level.select("lang", F.lit(order).alias("k"), "gram", "c")
    for k in range(order - 1, 0, -1):
        level = cut(level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "grams")
        out = out.unionByName(level.select("lang", F.lit(k).alias("k"), "gram", "c"))
    return out


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, k, d): n1 / (n1 + 2 n2), kept between 0.1 and 0.9; 0.5 where no n-gram was seen once."""
    seen = counts.groupBy("lang", "k").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    d = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))
    return seen.select("lang", "k", F.when(F.col("n1") > 0, d).otherwise(0.5).alias("d"))


def estimates(counts: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, gram, alpha, gamma): the discounted probability of an n-gram and, as a context, the weight of its back-off; null where it is no such thing."""
    told = counts.withColumn("ctx", F.expr("substring(gram, 1, k - 1)"))
    contexts = told.groupBy("lang", "k", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(found, ["lang", "k"])
    contexts = cut(contexts, "contexts")
    alpha = told.join(contexts, ["lang", "k", "ctx"]).select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma"))
    gamma = contexts.select("lang", F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("alpha"), (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma"))
    return alpha.unionByName(gamma).groupBy("lang", "gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))


def block_of(gram: Column, bits: int) -> tuple[Column, Column]:
    key = F.xxhash64(gram)
    return key.alias("key"), F.shiftrightunsigned(key, 64 - bits).cast("int").alias("block")


class Model:
    """langs; blocks: (block, lang, keys, alpha, gamma), a row per language and part of the hash range, its arrays sorted by hash."""

    def __init__(self, langs: list[str], blocks: DataFrame, bits: int, base: float, order: int):
        self.langs, self.blocks, self.bits, self.base, self.order = langs, blocks, bits, base, order

    def look_up(self, grams: DataFrame) -> DataFrame:
        """gram, and by language alpha (0 if not seen) and gamma (1 if not seen as a context); by binary search in the arrays of each block."""
        langs = self.langs

        def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            wanted = asked["key"].to_numpy()
            alpha, gamma = np.zeros((len(wanted), len(langs))), np.ones((len(wanted), len(langs)))
            for lang, keys, a, g in zip(stored["lang"], stored["keys"], stored["alpha"], stored["gamma"], strict=True):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                here, column = keys[at] == wanted, langs.index(lang)
                alpha[here, column], gamma[here, column] = a[at[here]], g[at[here]]
            return pd.DataFrame({"gram": asked["gram"], "alpha": list(alpha), "gamma": list(gamma)})

        asked = grams.select("gram", *block_of(F.col("gram"), self.bits))
        return asked.groupBy("block").cogroup(self.blocks.groupBy("block")).applyInPandas(search, "gram string, alpha array<double>, gamma array<double>")

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, p): the interpolated probability of the last character of each of the given n-grams of full length, by language."""
        order = self.order
        ends = [F.substring("gram", order - k + 1, k) for k in range(1, order + 1)]
        contexts = [F.substring("gram", order - k + 1, k - 1) for k in range(1, order + 1)]
        table = cut(self.look_up(grams.select(F.explode(F.array(*ends, *contexts)).alias("gram")).distinct()), "looked_up")
        p = None
        for k in range(1, order + 1):
            here = table.filter(F.length("gram") == k).select("gram", "alpha", F.substring("gram", 1, k - 1).alias("ctx"), F.substring("gram", 2, k - 1).alias("end"))
            weights = table.filter(F.length("gram") == k - 1).select(F.col("gram").alias("ctx"), "gamma")
            shorter = F.array(*[F.lit(self.base)] * len(self.langs))
            both = here.join(weights, "ctx")
            if p is not None:
                both, shorter = both.join(p.select(F.col("gram").alias("end"), "p"), "end"), F.col("p")
            rest = F.zip_with("gamma", shorter, lambda g, q: g * q)
            p = both.select("gram", F.zip_with("alpha", rest, lambda a, r: a + r).alias("p"))
        return p


def fit(counted: DataFrame, order: int = ORDER) -> Model | None:
    """The model of the counted n-grams (lang, gram, n); None if none has a lang."""
    counts = levels(counted, order)
    found = cut(discounts(counts), "discounts")
    langs = sorted(r[0] for r in found.select("lang").distinct().collect())  # a row per language
    if not langs:
        return None
    told = cut(estimates(counts, found), "estimates")
    bits = max(5, int(np.ceil(np.log2(max(told.count(), 1) / BLOCK))))
    letters = counts.filter("k = 1").select(F.count_distinct("gram")).first()[0] + 1
    entry = F.struct("key", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    blocks = told.select("lang", "alpha", "gamma", *block_of(F.col("gram"), bits)).groupBy("block", "lang").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    blocks = blocks.select("block", "lang", F.col("e.key").alias("keys"), F.col("e.alpha").alias("alpha"), F.col("e.gamma").alias("gamma"))
    return Model(langs, cut(blocks, "sorted_arrays"), bits, 1.0 / letters, order)


def spans(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of PIECE characters together, or a longer one."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PIECE:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if texts:
        yield slice(start, len(texts))


def add_up(rows: DataFrame, scored: DataFrame, model: Model, keep: list[str], common: float) -> DataFrame:
    """Per row of (keep, _row, lang, text): its log-probability by language, `sums`, and its number of characters, word ends included; null and 0 without letters.

    scored: (gram, n, logs) of all n-grams of the texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    order, langs = model.order, range(len(model.langs))
    names = [*keep, "_row", "lang"]

    @F.pandas_udf("long")
    def key_of(grams: pd.Series) -> pd.Series:
        return pd.Series(window_hashes("".join(grams), order)[::order])

    keyed = cut(scored.select(key_of("gram").alias("key"), "n", *[F.col("logs")[i].alias(f"p{i}") for i in langs]), "scored")
    total = keyed.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= total * common
    table = keyed.filter(frequent).drop("n").toPandas().sort_values("key")  # at most 1/common rows
    keys, logs = table["key"].to_numpy(np.int64), table.drop(columns="key").to_numpy(float)
    logs = np.append(np.zeros((1, len(langs))), logs, axis=0).T.copy()  # the first place is that of all others
    sent = rows.sparkSession.sparkContext.broadcast((keys, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = sent.value
        places = Places()
        places.add(keys)

        def summed(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            sums, chars, rare, seldom = np.zeros((len(logs), len(texts))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
            for _, _, hashes, owners, sizes in read(texts, order):
                found = places.find(hashes)
                chars[owners] += sizes
                some = np.flatnonzero(sizes)
                firsts, some = (np.cumsum(sizes) - sizes)[some], some + owners.start
                if len(some):
                    place = np.add(found, 1, dtype=np.int64)
                    for total, column in zip(sums, logs, strict=True):
                        total[some] += np.add.reduceat(column.take(place, mode="clip"), firsts)
                lost = found < 0
                if lost.any():
                    seldom.append(hashes[lost])
                    rare[some] += np.add.reduceat(lost, firsts, dtype=np.int64)
            starts = pa.array(np.arange(len(texts) + 1) * len(logs), pa.int32())
            rare = pa.array(np.append(0, np.cumsum(rare)), pa.int32())
            lists = [(starts, pa.array(sums.T.ravel()), "sums"), (rare, pa.array(np.concatenate(seldom) if seldom else np.zeros(0, np.int64)), "seldom")]
            sums, seldom = (pa.ListArray.from_arrays(offsets, values, type=out.field(c).type) for offsets, values, c in lists)
            return pa.record_batch([*part.columns[:-1], sums, pa.array(chars), seldom], names=out.names)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [(t or "").lower() for t in part.columns[-1].to_pylist()]
                for span in spans(texts):
                    yield summed(part.slice(span.start, span.stop - span.start), texts[span])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sums array<double>, chars long, seldom array<long>"
    out = to_arrow_schema(_parse_datatype_string(schema))
    met = cut(rows.select(*names, "text").mapInArrow(run, schema), "langid")
    others = met.select("_row", F.explode("seldom").alias("key")).join(keyed.filter(~frequent).drop("n"), "key")
    others = others.groupBy("_row").agg(F.array(*[F.sum(f"p{i}") for i in langs]).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    return met.drop("seldom").join(others, "_row", "left").select(*names, F.when(F.col("chars") > 0, sums).alias("sums"), "chars")


def identify(docs: DataFrame, learned: Column, keep: list[str], order: int = ORDER, reject: float = REJECT, common: float = COMMON) -> DataFrame:
    """keep, and per text: lang_pred, score, entropy (nats per character of the winner; null for `und`), rejected.

    docs has lang and text; `learned` says from which rows the lang may be learned. `rejected`: the cross-entropy is above that of all but a share
    `reject` of the winner's own training texts (a quantile sketch), or the text is `und`.
    """
    renamed = [f"_k{i}" for i in range(len(keep))]
    back = [F.col(new).alias(old) for new, old in zip(renamed, keep, strict=True)]
    rows = docs.select(*[F.col(old).alias(new) for new, old in zip(renamed, keep, strict=True)], F.when(learned, F.col("lang")).alias("lang"), "text")
    counted = cut(gram_counts(rows, order), "grams")
    model = fit(counted, order)
    if model is None:
        return rows.select(*back, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    grams = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    logs = model.probabilities(grams.select("gram")).select("gram", F.transform("p", lambda q: F.log(q)).alias("logs"))
    summed = add_up(rows.withColumn("_row", F.monotonically_increasing_id()), grams.join(logs, "gram"), model, renamed, common)
    langs = F.array(*map(F.lit, model.langs))
    nats = F.transform("sums", lambda s: -s / F.col("chars"))
    judged = cut(summed.select(*renamed, "lang", nats.alias("nats")).withColumn("entropy", F.array_min("nats")), "judged")
    own = judged.filter("lang IS NOT NULL AND entropy IS NOT NULL").withColumn("own", F.element_at("nats", F.array_position(langs, F.col("lang")).cast("int")))
    limits = own.groupBy("lang").agg(F.percentile_approx("own", 1 - reject, 10_000).alias("limit")).collect()  # a row per language
    limit = F.lit(float("inf"))
    for r in limits:
        limit = F.when(F.col("lang_pred") == r["lang"], F.lit(r["limit"])).otherwise(limit)
    best = F.when(F.col("entropy").isNotNull(), F.element_at(langs, F.array_position("nats", F.col("entropy")).cast("int")))  # a null place would give an element
    weight = F.aggregate("nats", F.lit(0.0), lambda total, e: total + F.exp(-SHARPNESS * (e - F.col("entropy"))))
    out = judged.withColumn("lang_pred", F.coalesce(best, F.lit("und"))).withColumn("score", F.coalesce(1 / weight, F.lit(0.0)))
    return out.select(*back, "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") > limit, F.lit(True)).alias("rejected"))
