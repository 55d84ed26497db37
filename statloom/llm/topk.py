"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are dealt into ranges of their ids. A range is packed into super-blocks of at most SUPER vectors, and those into blocks
of BLOCK, each with its forward index (the vectors themselves) and the largest and smallest value of every component. For a
query the bound of a block is the sum over components of the larger of q*max and q*min. Blocks are scored in order of their
bounds until a bound falls below the kth score found so far; blocks that reach it exactly are scored too, because of ties. So
results are exact.

Queries meet rows in blocks: every packed chunk of queries meets every super-block, and every pair of packs gives at most k rows
per query; the best k of those are the result. All of it is in tasks: a task reads a share of both sides and pairs them, so no copies of the
queries are sent, shuffled or brought to the driver.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part. Vectors of
unequal length are compared as if the shorter went on with zeros. A query's own id is no candidate, in whatever row. Repeated rows
are candidates each; a repeated query row gets its own ranks. Ties: smaller id first. Scores beyond 64 bits are held at
the ends of the range. Empty tables give no rows. Columns beyond id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64
SUPER = 4096
QUERIES = 1024
# Ranges of one pack each, up to so many; beyond that a range has TOGETHER packs, for the driver draws a sample per range. Packs of queries a task holds.
RANGES, TOGETHER, HELD = 256, 16, 16
_LOW, _HIGH = -(2 ** 63) + 1, 2 ** 63 - 1


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))


def pack(rows: DataFrame, size: int, ranges: int) -> DataFrame:
    """(part, ids, dims, data): rows of (id long, vector array<double>) in packs of at most `size`, by id ranges."""
    schema = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("dims", pa.int64()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[int] = []
        vectors: list[list[float]] = []

        def packed():
            dims = max(map(len, vectors))
            data = np.zeros((len(ids), dims))
            for i, v in enumerate(vectors):
                data[i, :len(v)] = v
            return pa.record_batch([[part], [np.array(ids, np.int64).tobytes()], [dims], [data.tobytes()]], schema=schema)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield packed()
                    ids, vectors = [], []
        if ids:
            yield packed()

    dealt = rows.repartitionByRange(ranges, "id", F.xxhash64("vector"))
    return dealt.mapInArrow(run, "part long, ids binary, dims long, data binary")


def ranges_of(rows: int, size: int) -> int:
    packs = max(1, -(-rows // size))
    return packs if packs <= RANGES else max(RANGES, -(-packs // TOGETHER))


def products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; float arithmetic is exact below 2**53, beyond it Python's integers do."""
    if np.abs(matrix).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(matrix.shape[1], 1) < 2 ** 53:
        return (matrix @ query).astype(np.int64)
    ints = [int(x) for x in query]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, ints, strict=True)), _LOW), _HIGH) for row in matrix], np.int64)


def search(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK):
    """Yields (query number, ids, scores) of the best k rows of a super-block."""
    dims = max(matrix.shape[1], queries.shape[1])
    matrix = np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    starts = np.arange(0, len(ids), block)
    if dims:
        high, low = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
        with np.errstate(over="ignore"):
            bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    else:
        bounds = np.zeros((len(queries), len(starts)))
    slack = 1e-9 * np.abs(bounds) + (1 if np.abs(bounds).max(initial=0) > 2 ** 52 else 0)  # the bounds' own rounding
    bounds = bounds + slack
    for n, q in enumerate(queries):
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in np.argsort(-bounds[n], kind="stable"):
            if len(best) == k and bounds[n, b] < best[-1]:
                break
            rows = slice(starts[b], starts[b] + block)
            score, who = products(matrix[rows], q), ids[rows]
            keep = who != query_ids[n]
            if len(best) == k:
                keep &= score >= best[-1]
            if keep.any():
                score, who = np.concatenate([best, score[keep]]), np.concatenate([best_ids, who[keep]])
                order = np.lexsort((who, -score))[:k]
                best, best_ids = score[order], who[order]
        yield n, best_ids, best


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """rows, queries: (id long, vector array<double> of integers). Gives query_id, rank, vec_id, score."""
    from statloom.session import cut

    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    queries = queries.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    index = cut(pack(rows, SUPER, ranges_of(rows.count(), SUPER)), "topk-index").drop("part")
    count = queries.count()
    asked = cut(pack(queries, QUERIES, ranges_of(count, QUERIES)), "topk-queries")
    names = {"ids": "q_ids", "dims": "q_dims", "data": "q_data", "part": "q_part"}
    asked = asked.withColumnsRenamed(names).withColumn("q_pack", F.xxhash64("q_part", "q_ids", "q_data"))
    # a join on ranges would copy every query to every range, and the planner knows the size of one copy only
    pairs = index.crossJoin(asked.repartition(max(1, -(-count // (QUERIES * HELD)))).hint("shuffle_replicate_nl"))
    out = pa.schema([("pack", pa.int64()), ("place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("ids", "dims", "data", "q_ids", "q_dims", "q_data", "q_pack")}
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                matrix = np.frombuffer(r["data"]).reshape(len(ids), r["dims"])
                asked = np.frombuffer(r["q_data"]).reshape(len(q_ids), r["q_dims"])
                got = [(n, who, score) for n, who, score in search(ids, matrix, q_ids, asked, k) if len(who)]
                if got:
                    place = np.concatenate([np.full(len(w), n) for n, w, _ in got])
                    yield pa.record_batch([
                        pa.array(np.full(len(place), r["q_pack"])), pa.array(place), pa.array(q_ids[place]),
                        pa.array(np.concatenate([w for _, w, _ in got])), pa.array(np.concatenate([s for _, _, s in got]))], schema=out)

    found = pairs.select("ids", "dims", "data", "q_ids", "q_dims", "q_data", "q_pack").mapInArrow(
        run, "pack long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "pack", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def integer_vector(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as a whole double; non-finite components stay as they are."""
    big = F.lit(float("inf"))
    whole = F.transform(vector.cast(T.ArrayType(T.DoubleType())), lambda x: F.when(F.abs(x) < big, F.floor(x * scale).cast("double")).otherwise(x))
    return whole
