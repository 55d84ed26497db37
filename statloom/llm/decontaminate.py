"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are words. Of every `WINDOW` - K + 1 consecutive K-grams the smallest hash is a fingerprint, so two texts that share WINDOW
consecutive words share a fingerprint from inside them. Documents whose fingerprints meet those of an item are candidates;
in candidates all K-grams that are item fingerprints become anchors, an anchor's diagonal (place in the document minus place in the
item) is compared word by word over the whole overlap, and runs that are long enough are hits. Nothing rests on hashes alone.

Items of fewer than WINDOW words count as one window of all their words; for each such length (there are at most WINDOW - 1) all
n-grams of documents are looked up.

Fingerprints are upper-cased words, which folds more than the A-Z rule does; the words that are compared follow the rule. Work after
the candidates is per distinct text: copies share it. Explodes are outer ones: a plain explode adds a filter that computes its array
again for every use.

Defined cases: null and empty texts have no words and no hits. Items without words, or with a null id, take no part. Items that
repeat an id count as one item of several texts. Repeated documents, and documents without id, get a row each. Empty benchmark: no hits.
Very long texts are read whole, an empty table gives none. Columns beyond text and those to keep are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import cut

WINDOW = 10
K = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded_words(text: Column) -> Column:
    """Words, upper-cased: equal words of the contract stay equal."""
    return F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), _BREAKS), "")


def exact_words(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), "")


def grams(words: Column, n: int) -> Column:
    """Hashes of the n-grams that begin at each word; those cut off by the end are hashes of fewer words."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, n))))


def minima(hashes: Column, window: int, k: int) -> Column:
    """The smallest hash of each run of window - k + 1 K-grams."""
    places = window - k + 1
    lows = F.transform(hashes, lambda h, i: F.least(h, *(F.get(hashes, i + j) for j in range(1, places))))
    return F.array_distinct(lows)


def prints(frame: DataFrame, words: str, short: list[int], window: int, k: int) -> DataFrame:
    """Adds `prints`: the winnowed hashes, and all n-grams of the lengths in short."""
    out = frame.withColumn("hashes", grams(F.col(words), k)).withColumn("prints", minima(F.col("hashes"), window, k)).drop("hashes")
    for n in short:
        out = out.withColumn("prints", F.array_union("prints", grams(F.col(words), n)))
    return out


def item_prints(items: DataFrame, short: list[int], window: int, k: int) -> DataFrame:
    """(print, item, place): item fingerprints with their places. items: item, folded, n."""
    long = items.filter(F.col("n") >= window).withColumn("hashes", F.slice(grams(F.col("folded"), k), F.lit(1), F.col("n") - k + 1))
    long = long.withColumn("prints", minima(F.col("hashes"), window, k)).select("item", "prints", F.posexplode_outer("hashes").alias("place", "print"))
    out = long.filter(F.array_contains("prints", F.col("print"))).select("print", "item", "place")
    for n in short:
        whole = items.filter(F.col("n") == n)
        out = out.unionByName(whole.select(F.get(grams(F.col("folded"), n), F.lit(0)).alias("print"), "item", F.lit(0).alias("place")))
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Hits per distinct text: key (md5 of the text), n_hit, items (sorted distinct ids as text). Texts without hits are left out.

    docs: text. benchmark: item_id, text.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items = items.withColumn("words", exact_words(F.col("text"))).withColumn("folded", folded_words(F.col("text")))
    items = cut(items.withColumn("n", F.size("words")).filter("n > 0").withColumn("item", F.xxhash64("item_id", "text"))
                .select("item", "item_id", "words", "folded", "n"), "items")
    short = sorted(r["n"] for r in items.filter(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 lengths
    known = cut(item_prints(items, short, window, k), "item-prints")

    keyed = docs.select("text").filter("text IS NOT NULL").withColumn("key", F.md5(F.col("text").cast("binary")))
    met = prints(keyed.withColumn("folded", folded_words(F.col("text"))), "folded", short, window, k)
    met = met.select("key", F.explode_outer("prints").alias("print")).join(known.select("print").distinct(), "print")
    candidates = cut(met.select("key").distinct(), "candidates")

    texts = keyed.join(candidates, "key", "left_semi").dropDuplicates(["key"])
    texts = cut(texts.withColumn("words", exact_words(F.col("text"))).withColumn("folded", folded_words(F.col("text"))).drop("text"), "candidate-words")
    anchors = None
    for n in [k, *short]:
        at = texts.select("key", F.posexplode_outer(grams(F.col("folded"), n)).alias("at", "print"))
        anchors = at if anchors is None else anchors.unionByName(at)
    lines = anchors.join(known, "print").select("key", "item", (F.col("at") - F.col("place")).alias("line")).distinct()

    lined = lines.join(items.select("item", "item_id", F.col("words").alias("own"), "n"), "item").join(texts.select("key", "words"), "key")
    first = F.greatest(F.col("line"), F.lit(0))
    last = F.least(F.size("words"), F.col("line") + F.col("n")) - 1
    lined = lined.withColumn("first", first).withColumn("last", last).withColumn("need", F.least("n", F.lit(window))).filter("last - first + 1 >= need")
    same = F.transform(F.sequence("first", "last"), lambda i: F.when(F.get("words", i) == F.get("own", i - F.col("line")), "1").otherwise("0"))
    lined = lined.withColumn("same", F.array_join(same, "")).filter(F.expr("contains(same, repeat('1', need))"))
    starts = F.filter(F.sequence("first", F.col("last") - F.col("need") + 1),
                      lambda i: F.substring(F.col("same"), i - F.col("first") + 1, F.col("need")) == F.repeat(F.lit("1"), F.col("need")))
    hits = lined.withColumn("places", F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + F.col("need") - 1)))))
    hits = cut(hits.select("key", "item_id", "places"), "hits")
    covered = hits.select("key", F.explode("places").alias("place")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("key", "item_id").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return covered.join(named, "key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, k: int = K) -> DataFrame:
    """keep, and per document n_words, n_hit, items, contaminated."""
    found = cut(find(docs, benchmark, window, k).withColumnRenamed("key", "_key"), "found")
    rows = docs.select(*keep, F.md5(F.col("text").cast("binary")).alias("_of"), F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, F.col("_of") == F.col("_key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
