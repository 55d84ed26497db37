"""Merkle manifest of a table: a content-addressed store of digests, and proofs by descent from the root.

Every row is a leaf. Leaves of one group (a language) stand in order of their ids; every FAN consecutive digests become the digest of their
parent until one is left, the group's subroot. Subroots in order of their groups become the root in the same way. The store holds one record per
inner node: digest -> digests of its children. Equal nodes are one record, since a record is found by its content alone.

Proofs come from the store, not from positions of the build: all leaf requests start at the root, whose record is fetched by its digest; the digits of
a leaf's rank to the base FAN say which child each request takes, the children it does not take are a segment of its path, and the next
record is fetched by the digest of the taken child. Requests with equal leading digits travel as one row, so a level has as many rows as it
has nodes, and paths are as many as the lowest inner nodes. At the leaves the segments are reversed: from the leaf upwards.

Ranks come without any group in one task: rows are dealt by ranges of (group, id, digest) and sorted there; a row's rank is its place in its
part plus the rows of its group in earlier parts, a table of one row per part and group.

Defined cases: null values hash as `-` and empty texts as `0:`; a null group is a group and comes first; a null id comes first in its group and is never
tampered with, for it has no decimal form. Ties: equal ids in the order of their leaves; rows equal in everything are leaves each, and share records. A
lone leaf is its subroot, a lone subroot the root, a last run of one is hashed alone; without siblings the proof is the digest of nothing. An empty
table has no rows. Long texts are hashed whole. Columns beyond doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import cut

FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Forest:
    """Trees over ordered leaves. roots: tree, digest, height. levels[h - 1]: tree, idx, digest, children of the nodes of height h."""

    roots: DataFrame
    levels: list[DataFrame]

    def store(self, height: int) -> DataFrame:
        """(digest, children): a record per different node of a height."""
        return self.levels[height - 1].groupBy("digest").agg(F.first("children").alias("children"))


def joined_digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def field(value: Column) -> Column:
    """A value that cannot run into the next one: byte count, colon, value; `-` for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    return F.sha2(F.concat(*[field(replaced.get(c, F.col(c))) for c in FIELDS]), 256)


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with rank (from 0, in their tree) and n (rows of the tree), written."""
    keys = [tree, *order]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys)
    # the number of a row: its part in the upper bits, its place in the part in the lower 33
    placed = cut(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_tree")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select("_tree", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n")), f"{name}-runs")
    both = placed.join(runs, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    return both.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_tree", "_part", "_first", "_before", "_at")


def build(leaves: DataFrame, name: str) -> Forest:
    """leaves: tree, rank, n, digest. Each level is written once; the next one and the store read it."""
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    now = leaves.select("tree", F.col("rank").alias("idx"), "n", "digest")
    roots, levels = [now.filter("n = 1").select("tree", "digest", F.lit(0).alias("height"))], []
    while most > 1:
        most = -(-most // FAN)
        runs = now.filter("n > 1").groupBy("tree", F.expr(f"idx DIV {FAN}").alias("idx"), F.expr(f"(n + {FAN - 1}) DIV {FAN}").alias("n")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("idx").alias("at"), "digest"))).alias("run"))  # FAN at most
        children = runs.select("tree", "idx", "n", F.transform("run", lambda c: c["digest"]).alias("children"))
        now = cut(children.withColumn("digest", joined_digest(F.col("children"))), f"{name}-{len(levels) + 1}")
        levels.append(now)
        roots.append(now.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return Forest(cut(found, f"{name}-roots"), levels)


def segment(children: Column, digit: Column) -> Column:
    """The children a request does not take, left and right of the one it takes."""
    size = F.size(children)
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"),
                    F.array_join(F.slice(children, digit + 2, size), "").alias("after"))


def descend(forest: Forest, starts: DataFrame, requests: DataFrame | None = None, least: int = 0) -> DataFrame:
    """(tree, idx, digest, path, height) of the nodes of height `least` below the starts, and of trees that are lower than that.

    starts: tree, digest, height, path (segments from the top). requests: tree, rank of the leaves wanted; None: all.
    """
    here = starts.withColumn("idx", F.lit(0).cast("long"))
    columns = ["tree", "idx", "digest", "path", "height"]
    for height in range(len(forest.levels), least, -1):
        at = here.filter(F.col("height") == height).join(forest.store(height), "digest")
        below = at.select("tree", "idx", "path", "children", F.posexplode("children").alias("digit", "digest"))
        below = below.select("tree", (F.col("idx") * FAN + F.col("digit")).alias("idx"), "digest",
                             F.array_append("path", segment(F.col("children"), F.col("digit"))).alias("path"), F.lit(height - 1).alias("height"))
        if requests is not None:
            wanted = requests.select(F.col("tree").alias("_tree"), F.floor(F.col("rank") / FAN ** (height - 1)).alias("_idx")).distinct()
            below = below.join(wanted, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("idx") == F.col("_idx")), "left_semi")
        here = here.filter(F.col("height") < height).select(*columns).unionByName(below)
    return here.select(*columns)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path (from the leaf upwards) give."""
    return F.aggregate(path, leaf, lambda held, s: F.sha2(F.concat(s["before"], held, s["after"]), 256))


def manifest(docs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row per leaf: doc_id, lang, rank, leaf, altered, subroot, root, path (segments from the leaf upwards).

    altered is the leaf after tampering, null where it is as it was. requests: lang, rank of the leaves wanted; None: all.
    """
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    altered = F.when(tampered, leaf_digest(text=F.translate("text", UPPER, LOWER)))
    rows = docs.select(F.col("doc_id"), F.col("lang").alias("tree"), leaf_digest().alias("digest"), altered.alias("altered"))
    leaves = ranked(rows, "tree", ["doc_id", "digest"], "leaves")
    trees = build(leaves, "tree")
    subroots = ranked(trees.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), "digest", F.col("height").alias("own_height")), "tree", ["lang"], "subroots")
    top = build(subroots, "top")
    empty = F.array().cast("array<struct<before:string,after:string>>")
    tops = descend(top, top.roots.withColumn("path", empty))
    root = top.roots.select(F.col("digest").alias("root"))
    starts = tops.select(F.col("idx").alias("rank"), "path").join(subroots, "rank").select(
        F.col("lang").alias("tree"), "digest", F.col("own_height").alias("height"), "path", F.col("digest").alias("subroot"))
    starts = cut(starts.crossJoin(root), "starts")  # one root
    named = starts.select(F.col("tree").alias("_tree"), "subroot", "root")
    wanted = None if requests is None else requests.select(F.col("lang").alias("tree"), "rank")
    # the last level is taken by the leaves themselves: each one joins the run that it is in
    groups = descend(trees, starts.select("tree", "digest", "height", "path"), wanted, least=1)
    if trees.levels:
        runs = groups.filter("height = 1").join(trees.store(1), "digest").select("tree", "idx", "path", "children")
        runs = runs.unionByName(groups.filter("height = 0").select("tree", "idx", "path", F.lit(None).cast("array<string>").alias("children")))
    else:
        runs = groups.select("tree", "idx", "path", F.lit(None).cast("array<string>").alias("children"))
    runs = runs.select(F.col("tree").alias("_group"), F.col("idx").alias("_idx"), "path", "children")
    if wanted is not None:
        wanted = wanted.select(F.col("tree").alias("_want"), F.col("rank").alias("_rank"))
        leaves = leaves.join(wanted, F.col("tree").eqNullSafe(F.col("_want")) & (F.col("rank") == F.col("_rank")), "left_semi")
    met = leaves.join(runs, F.col("tree").eqNullSafe(F.col("_group")) & (F.expr(f"rank DIV {FAN}") == F.col("_idx")))
    digit = (F.col("rank") % FAN).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.array_append("path", segment(F.col("children"), digit)))
    out = met.select("doc_id", "tree", "rank", F.col("digest").alias("leaf"), "altered", F.reverse(path).alias("path"))
    out = out.join(named, F.col("tree").eqNullSafe(F.col("_tree")))
    return out.select("doc_id", F.col("tree").alias("lang"), "rank", "leaf", "altered", "subroot", "root", "path")


def proofs(docs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the altered leaf where there is one), verified."""
    shown = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = manifest(docs, requests).select("doc_id", "leaf", "subroot", "root", F.sha2(shown, 256).alias("proof_sha256"),
                                          fold(F.col("path"), F.coalesce("altered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
