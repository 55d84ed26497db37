"""Jaccard join of n-gram sets by prefix trees, and the components of its links.

A document's set holds its different runs of SHINGLE words, as 64-bit hashes in ascending order: one global order for all sets. Documents of equal
sets are one set first. Two sets link when 100 * common >= percent * union; with s = the sum of their sizes that allows at most
(100 - percent) * s / (100 + percent) differences.

Meeting. Sizes are in classes, wide enough that sets that link are in one class or in neighbouring ones. For a class that allows H differences the
range of hashes is cut into H + 1 equal parts: two sets that link agree in one part at least, whatever is in it. So the hash of each part is a
key, and sets of equal keys are a group; sets near the upper end of their class also have the keys of the next one. Empty parts (and, of few
parts, those of one hash) would bring strangers together; their keys are combined with those of a second cut by another hash, where the same holds.
Sets that meet nobody leave here, which are nearly all of a corpus: their texts never move. Those that are left are cut into 2 (H + 1) parts, and a set
with more than H parts that nobody else has cannot link either. Groups of the same sets are one group.

Joining. Sets that groups connect, directly or over others, are one block if they fit into it, bounded by sets and by hashes. In a block the sets go
into a prefix tree, whose common beginnings are compared once for all sets below. A set walks down the tree with its overlap so far; a subtree is left
when the overlap and the fewer of both remaining lengths cannot reach what its sizes need, when its sets are in the walker's component already,
or have walked before. Before that, sets with too many hashes that no other set of the block has are put aside.

Beyond a block the groups themselves are dealt to blocks, in two rounds. Only components matter, so links within one are not asked for twice. First every
set joins one block, of its largest group, where the set that meets most others is in every block of the group. Components of those links come
next; then only groups with several components are left, and there every set that is not of the group's largest component meets all sets of the group, in
all its blocks. So no two linked sets stay apart, and the work of large groups of one component does not grow with their square.

Defined cases: texts without words (null, empty, white space) have no set and are linked with nothing, their component is their id. Texts of fewer
than SHINGLE words are one run. Rows without id are in no link and have no component, but their sets are counted. A repeated id goes by each
row's text. Ties need no rule: a component is named after its smallest id. Long texts are taken whole. An empty table has no rows.
Columns beyond doc_id and text are not read. Sets are told apart by 64-bit hashes: of n sets any two are confused with chance n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import arrow_rows, map_rows, mix
from statloom.operators.components import connected_components
from statloom.session import cut

SHINGLE = 3
PERCENT = 90
FEW_PARTS = 32
BLOCK_SETS = 1024
BLOCK_HASHES = 1 << 20
CACHE = 1 << 20
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingles:
    """Sets of word runs; remembers the hashes of words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only, ASCII white space only
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known, out = self.known, []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        h = np.array(out, np.uint64)
        width = min(self.size, len(h))
        runs = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            runs = mix(runs * _ONE + h[j:len(h) - width + 1 + j])
        return np.unique(runs)


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


class Cuts:
    """Size classes and the keys of a set's parts."""

    def __init__(self, percent: int = PERCENT, times: int = 1):
        self.percent, self.times = percent, times
        self.bounds = [max(1, -(-percent // (100 - percent)) if percent < 100 else 2 ** 31)]  # a smaller set links with its equals only
        while self.bounds[-1] < 2 ** 31:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, -(-b * 100 // percent), b * 5 // 4))

    def allowed(self, label: int) -> int:
        """Differences of two linked sets whose larger one is in a class at most."""
        return 2 * (self.bounds[label + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def labels(self, size: int) -> list[int]:
        if size < self.bounds[0] or self.percent >= 100:
            return []
        own = bisect_right(self.bounds, size) - 1
        return [own, own + 1] if 100 * size >= self.percent * self.bounds[own + 1] else [own]

    def keys(self, hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(class, keys) for the classes of a set."""
        return [(label, self._parts(hashes, label)) for label in self.labels(len(hashes))]

    def _parts(self, hashes: np.ndarray, label: int) -> np.ndarray:
        parts = self.times * (self.allowed(label) + 1)
        first, counts = self._cut(hashes, parts, label)
        small = np.flatnonzero(counts < (2 if parts <= FEW_PARTS else 1))
        if self.times > 1 or not len(small):
            return first
        second, _ = self._cut(np.sort(mix(hashes ^ _THREE)), parts, label)
        pairs = mix(first[small][:, None] * _TWO + second[None, :]).ravel()
        return np.concatenate([np.delete(first, small), pairs])

    @staticmethod
    def _cut(hashes: np.ndarray, parts: int, label: int) -> tuple[np.ndarray, np.ndarray]:
        at = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + _THREE), out=sums[1:])
        place = np.arange(parts, dtype=np.uint64) + np.uint64(label << 32)
        return mix(mix(place * _ONE) + (sums[edges[1:]] - sums[edges[:-1]])), np.diff(edges)


class Node:
    __slots__ = ("edge", "end", "lo", "hi", "children", "least", "most", "last", "label")


class Tree:
    """Prefix tree of sets in the global order. A node covers a run of the sorted sets; its edge holds the hashes that they share beyond the
    parent's. walks: the place in the order of walking of each set, beyond all for those that do not walk."""

    def __init__(self, sets: list[np.ndarray], walks: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order = order
        self.sets = [sets[i] for i in order]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        last = np.array([walks[i] for i in order], np.int64)
        shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            at = int(differ.argmax()) if n else 0
            shared[i] = at if n and differ[at] else n
        self.nodes: list[Node] = []
        todo = [(0, len(order), 0, None)] if order else []
        while todo:
            lo, hi, start, parent = todo.pop()
            node = Node()
            node.lo, node.hi, node.children, node.label = lo, hi, [], None
            node.least, node.most, node.last = int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), int(last[lo:hi].max())
            inner = shared[lo + 1:hi]
            node.end = int(sizes[lo]) if hi - lo == 1 else int(inner.min())
            node.edge = self.sets[lo][start:node.end]
            if hi - lo > 1:
                cuts = [lo, *(np.flatnonzero(inner == node.end) + lo + 1).tolist(), hi]
                todo.extend((a, b, node.end, node) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            if parent is not None:
                parent.children.append(node)
            self.nodes.append(node)

    def refresh(self, roots: Callable[[int], int]) -> None:
        """Marks the nodes all of whose sets are in one component."""
        for node in reversed(self.nodes):
            if not node.children:
                node.label = roots(self.order[node.lo])
            else:
                marks = {c.label for c in node.children}
                node.label = marks.pop() if len(marks) == 1 else None

    def walk(self, hashes: np.ndarray, place: int, percent: int, settled: Callable[[int], bool]) -> Iterator[int]:
        """Sets that link with this one, without subtrees that are settled or have walked; settled takes the label of a node."""
        size = len(hashes)
        todo = [(self.nodes[0], 0, 0)] if self.nodes else []
        while todo:
            node, common, used = todo.pop()
            if node.last <= place or (node.label is not None and settled(node.label)):
                continue
            edge = node.edge
            if len(edge):
                at = np.searchsorted(hashes, edge)
                hit = hashes[np.minimum(at, size - 1)] == edge
                common += int(np.count_nonzero(hit))
                used = int(at[-1]) + int(hit[-1])
            left = size - used
            other = min(node.most, max(node.least, node.end + left))  # the size below here that can do best
            most = common + min(left, other - node.end)
            if (100 + percent) * most < percent * (size + other):
                continue
            if node.children:
                todo.extend((c, common, used) for c in node.children)
            else:
                yield self.order[node.lo]


def linkable(sets: list[np.ndarray], percent: int) -> list[int]:
    """Places of the sets that do not have too many hashes of their own; a set that goes takes its hashes along."""
    here = list(range(len(sets)))
    while len(here) > 1:
        _, where, count = np.unique(np.concatenate([sets[i] for i in here]), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(sets[i]) for i in here])
        own = np.add.reduceat(count[where] == 1, np.concatenate([[0], ends[:-1]]).astype(np.int64))
        # common <= size - own, union >= size
        kept = [i for i, o in zip(here, own.tolist(), strict=True) if 100 * (len(sets[i]) - o) >= percent * len(sets[i])]
        if len(kept) == len(here):
            break
        here = kept
    return here if len(here) > 1 else []


def link_block(rows: list[tuple], percent: int, confirm: Callable[[Any, Any], bool] | None = None) -> list[tuple[int, int]]:
    """Links between components of a block. rows: id, label, whether it walks, whether it is a guest (in the tree of another
    block), hashes, what confirm needs to know, in the order of walking. confirm: a further test of pairs that link by their sets."""
    left = linkable([r[4] for r in rows], percent)
    rows = [rows[i] for i in left]
    walkers = [i for i, r in enumerate(rows) if r[2]]
    members = [i for i, r in enumerate(rows) if not r[3]]
    if not walkers or not members:
        return []
    place = {i: n for n, i in enumerate(walkers)}
    tree = Tree([rows[i][4] for i in members], [place.get(i, len(rows)) for i in members])
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def label_of(member):
        return root(rows[members[member]][1])

    tree.refresh(label_of)
    out, fresh = [], 0
    for i in walkers:
        own = rows[i][1]
        for at in tree.walk(rows[i][4], place[i], percent, lambda label, own=own: root(label) == root(own)):
            other = rows[members[at]]
            a, b = root(own), root(other[1])
            if a != b and (confirm is None or confirm(rows[i][5], other[5])):
                parent[max(a, b)] = min(a, b)
                out.append((rows[i][0], other[0]))
                fresh += 1
        if fresh > len(members) // 32:
            tree.refresh(label_of)
            fresh = 0
    return out


def by_sets():
    """How texts are measured: (text to hashes and what confirm needs, confirm)."""
    shingles = Shingles()
    return lambda text: (shingles(text), None), None


def blocks(rows: DataFrame, percent: int, measure: Callable = by_sets) -> DataFrame:
    """(u, v): links found in blocks. rows: key, block, id, label, walks, guest, score, text. measure() is called once per task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        read, confirm = measure()
        held: list = []
        now = None

        def close():
            found = link_block(held, percent, confirm)
            return [arrow_rows(found, schema)] if found else []

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for key, block, who, label, walks, guest, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if now != (key, block):
                        yield from close()
                        held, now = [], (key, block)
                    held.append((who, label, walks, guest, *read(text)))
        yield from close()

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("score"), "id")
    return dealt.select("key", "block", "id", "label", "walks", "guest", "text").mapInArrow(run, "u long, v long")


def block_count(sets, hashes):
    return F.greatest(F.ceil(sets / F.lit(BLOCK_SETS)), F.ceil(hashes / F.lit(BLOCK_HASHES))).cast("int")


def small_round(met: DataFrame, texts: DataFrame, percent: int, measure: Callable) -> tuple[DataFrame, DataFrame]:
    """(links of the sets that are connected by groups and fit into a block together, met of the others)."""
    leads = met.groupBy("key").agg(F.min("id").alias("lead"))
    whole = connected_components(met.join(leads, "key").select("id", "lead"), "id", "lead").withColumnsRenamed({"node": "id", "label": "whole"})
    sets = met.groupBy("id").agg(F.sum("n").alias("score"), F.first("size").alias("size")).join(whole, "id")
    fit = sets.groupBy("whole").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("hashes")).filter(
        (F.col("sets") <= BLOCK_SETS) & (F.col("hashes") <= BLOCK_HASHES)).select("whole")
    rows = cut(sets.join(fit, "whole", "left_semi").select(F.col("whole").alias("key"), F.lit(0).alias("block"), "id", "score"), "whole-blocks")
    found = blocks(rows.withColumns({"label": F.col("id"), "walks": F.lit(True), "guest": F.lit(False)}).join(texts, "id"), percent, measure)
    return found, met.join(rows.select("id"), "id", "left_anti")


def first_round(met: DataFrame, texts: DataFrame, percent: int, measure: Callable) -> DataFrame:
    """Links of every set in one block of its largest group. met: key, id, size, n; texts: id, text."""
    homes = cut(met.groupBy("id").agg(F.sum("n").alias("score"), F.max(F.struct("n", "key")).alias("home"), F.first("size").alias("size"))
                .select("id", "score", F.col("home.key").alias("key"), "size"), "homes")
    groups = homes.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("hashes"), F.max(F.struct("score", (-F.col("id")).alias("back"))).alias("lead"))
    groups = groups.filter("sets > 1").select("key", block_count(F.col("sets"), F.col("hashes")).alias("parts"), (-F.col("lead.back")).alias("lead"), F.col("lead.score").alias("lead_score"))
    groups = cut(groups, "groups")
    dealt = homes.join(groups, "key").filter("id <> lead").select("key", "id", "score", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("block"))
    leads = groups.select("key", F.col("lead").alias("id"), F.col("lead_score").alias("score"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    rows = dealt.unionByName(leads).withColumns({"label": F.col("id"), "walks": F.lit(True), "guest": F.lit(False)})
    return blocks(rows.join(texts, "id"), percent, measure)


def second_round(met: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, measure: Callable) -> DataFrame:
    """Links between components that the first links left apart, in all groups that have sets of several."""
    named = met.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    still = cut(named.join(several, "key", "left_semi"), "several")
    parts = still.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("hashes"))
    groups = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("sets"), F.sum("hashes").alias("hashes"))
    groups = groups.select("key", F.col("top.label").alias("top"), block_count(F.col("sets"), F.col("hashes")).alias("parts"))
    rows = still.join(groups, "key").withColumns({"walks": F.col("label") != F.col("top"), "block": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "score": F.col("n")})
    columns = ["key", "block", "id", "label", "walks", "guest", "score"]
    members = rows.withColumn("guest", F.lit(False)).select(*columns)
    guests = rows.filter("walks AND parts > 1").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("at <> block")
    guests = guests.withColumn("block", F.col("at")).withColumn("guest", F.lit(True)).select(*columns)
    return blocks(members.unionByName(guests).join(texts, "id"), percent, measure)


def crowds(met: DataFrame) -> DataFrame:
    """(key, n) of the groups of two and more sets, one of those that have the same sets. met: key, id."""
    sets = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    crowd = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(s).alias(f"of_{i}") for i, s in enumerate(sets)]).filter("n > 1")
    return crowd.groupBy("n", "of_0", "of_1").agg(F.min("key").alias("key")).select("key", "n")


def linked(met: DataFrame, texts: DataFrame, percent: int, measure: Callable = by_sets) -> DataFrame:
    """(node, label): components of the links between sets that share a group. met: key, id, size, n (sets of the group); texts: id, text."""
    links, rest = small_round(met, texts, percent, measure)
    links, rest = cut(links, "links"), cut(rest, "rest")
    if not rest.isEmpty():
        one = cut(first_round(rest, texts, percent, measure), "links")
        two = cut(second_round(rest, connected_components(one), texts, percent, measure), "links")
        links = links.unionByName(one).unionByName(two)
    return connected_components(links)


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""

    def make_first():
        shingles, cuts = Shingles(), Cuts(percent)

        def f(doc_id, text):
            hashes = shingles(text)
            if not len(hashes):
                return doc_id, 0, None, []
            keys = cuts.keys(hashes) if doc_id is not None else []
            return doc_id, len(hashes), set_id(hashes), np.concatenate([k for _, k in keys]).view(np.int64).tolist() if keys else []

        return f

    rows = cut(map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make_first, "doc_id long, n long, id long, keys array<long>", chunk=500), "sets")
    keyed = rows.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key")
    # what is shared and asked for grows with the input: these joins never broadcast, so the plan is the same at every size
    met = cut(keyed.join(shared.hint("merge"), "key", "left_semi").distinct(), "met")
    named = rows.filter("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("size"))
    asked = cut(named.join(met.select("id").distinct(), "id", "left_semi").select("id", F.col("first_id").alias("doc_id"), "size"), "asked")

    def make_check():
        shingles = Shingles()
        return lambda who, text: [(who, text)] if set_id(shingles(text)) == who else []

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked.hint("merge"), "doc_id").select("id", "text")
    texts = cut(map_rows(raw, make_check, "id long, text string", many=True, chunk=200).dropDuplicates(["id"]), "texts")

    def make_fine():
        shingles, cuts = Shingles(), Cuts(percent, times=2)

        def f(who, text):
            return [(who, label, cuts.allowed(label), keys.view(np.int64).tolist()) for label, keys in cuts.keys(shingles(text))]

        return f

    fine = map_rows(texts, make_fine, "id long, class int, allowed int, keys array<long>", many=True, chunk=500)
    alone = fine.select("id", "class", "allowed", F.explode("keys").alias("part")).groupBy("part").agg(
        F.min("id").alias("id"), F.max("id").alias("other"), F.first("class").alias("class"), F.first("allowed").alias("allowed")).filter("id = other")
    # a set that is out in a class cannot link there; it is out when it is out in all its classes
    out = alone.groupBy("id", "class").agg(F.count(F.lit(1)).alias("c"), F.first("allowed").alias("allowed")).filter("c > allowed").groupBy("id").agg(F.count(F.lit(1)).alias("outs"))
    classes = texts.select("id").join(out, "id").join(fine.groupBy("id").agg(F.count(F.lit(1)).alias("classes")), "id").filter("outs >= classes").select("id")
    met = cut(met.join(classes, "id", "left_anti"), "left")
    met = cut(met.join(crowds(met), "key").join(asked.select("id", "size"), "id"), "close")
    labels = linked(met, texts, percent)
    whole = labels.join(named.withColumnRenamed("id", "node"), "node").groupBy("label").agg(F.min("first_id").alias("component"))
    of = labels.join(whole, "label").select(F.col("node").alias("id"), "component")
    of = cut(named.join(of, "id", "left").select("id", F.coalesce("component", "first_id").alias("component")), "components")
    found = rows.select("doc_id", "n", "id").join(of, "id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
