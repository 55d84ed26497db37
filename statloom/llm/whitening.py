"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(SCALE * c) + SHIFT. Sums and deviations are integers and exact; a centred entry x - S / n is (x - S div n) -
(S mod n) / n, one rounding of the exact value, so the large mean never meets a product.

With X the centred rows, step j makes p = X v - beta u(j-1), takes out what p has of earlier u (full reorthogonalisation), and with alpha its length
u(j) = p / alpha; then z = X' u(j) - alpha v, without what z has of earlier v (twice), and beta v(j+1) = z. Nothing as long as the table is kept: every u is
X t for a short vector t, so a task makes the u of its rows anew from their t. A step is one pass: tasks emit p'p, U'p and X'p of their rows, one row a
task, and the sums of those give alpha, u, z and v. The bidiagonal matrix of all alpha and beta has the singular values of X; its small SVD gives the
components. All dimensions are gone through, so that equal deviations are not missed: a beta of nothing starts over with a vector
orthogonal to all earlier ones, an alpha of nothing has no u. Matrices that are broadcast have dimensions * dimensions numbers at most.

The rows are packed into blocks once, written, and read by every pass: a lost executor costs its part of one pass.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out. A vector shorter than the longest goes on with entries
of zero. Entries beyond LIMIT in size count as LIMIT. Rows without id, repeated ids and repeated rows are rows like others. A component
without deviation cannot be whitened and is left out, so rows that are all equal, a single row, no rows and vectors without entries give an empty
result. Equal deviations: any orthonormal choice, one for all rows. A deviation beyond 64 bits is held at the largest one. Columns beyond
the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import cut

SCALE, SHIFT = 1024, 100_000
LIMIT = 2 ** 52
CELLS = 1 << 20
COMPONENTS = 8
_LOW = 26
TOLERANCE = 1e-13


@dataclass
class Moments:
    """Rows, dimensions, and per dimension S div n and S mod n."""

    n: int
    dims: int
    base: np.ndarray
    rest: np.ndarray


def integer_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable rows, their integer entries; shorter vectors end with entries of zero)."""
    there = np.asarray(column.is_valid())
    lengths = np.where(there, np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), 0)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    use = np.flatnonzero(there & (bad[ends] == bad[ends - lengths]))
    dims = int(lengths[use].max(initial=0))
    out = np.full((len(use), dims), SHIFT, np.int64)
    if dims:
        inside = np.arange(dims) < lengths[use][:, None]
        at = (ends - lengths)[use][:, None] + np.arange(dims)
        out[inside] = np.clip(np.floor(values[at[inside]] * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT
    return use, out


def pack(rows: DataFrame) -> DataFrame:
    """(ids, dims, width, data): blocks of integer rows. rows: id, vector."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("dims", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            use, x = integer_rows(b.column(1))
            ids = b.column(0).take(pa.array(use))
            size = max(1, CELLS // max(x.shape[1], 1))
            for i in range(0, len(use), size):
                part = x[i:i + size]
                width = 4 if np.abs(part).max(initial=0) < 2 ** 31 else 8
                yield pa.record_batch([pa.array([ids[i:i + size].to_pylist()], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([width], pa.int32()),
                                       pa.array([part.astype(f"<i{width}").tobytes()], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "ids array<long>, dims int, width int, data binary")


def blocks_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, integer rows of `dims` entries) of each block."""
    for b in batches:
        for i in range(b.num_rows):
            ids, own, width, data = (b.column(c)[i].as_py() for c in ("ids", "dims", "width", "data"))
            x = np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(len(ids), own)
            yield ids, np.pad(x, ((0, 0), (0, dims - own)), constant_values=SHIFT)


def centred(x: np.ndarray, m: Moments) -> np.ndarray:
    return (x - m.base).astype(np.float64) - m.rest / m.n


def total(blocks: DataFrame, each, size: int, m_dims: int, integers: bool = False) -> np.ndarray:
    """Sum over blocks of the vectors that each(integer rows) gives: tasks add up their blocks, one task adds a vector per task."""
    kind, name = (pa.int64(), "long") if integers else (pa.float64(), "double")
    dtype = np.int64 if integers else np.float64
    schema = pa.schema([("sums", pa.list_(kind))])

    def run(batches):
        held = np.zeros(size, dtype)
        for _, x in blocks_of(batches, m_dims):
            held += each(x)
        yield pa.record_batch([pa.array([held], pa.list_(kind))], schema=schema)

    def add(batches):
        held = np.zeros(size, dtype)
        for b in batches:
            held += b.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0) if size else 0
        yield pa.record_batch([pa.array([held], pa.list_(kind))], schema=schema)

    one = blocks.mapInArrow(run, f"sums array<{name}>").repartition(1).mapInArrow(add, f"sums array<{name}>").first()
    return np.array(one["sums"] if one else np.zeros(size), dtype)


def moments(blocks: DataFrame) -> Moments:
    size = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.max("dims"), F.lit(0)).alias("dims")).first()
    n, dims = size["n"], size["dims"]
    # in two halves, so that no sum of a task or of all rows exceeds 64 bits
    halves = total(blocks, lambda x: np.concatenate([(x >> _LOW).sum(axis=0), (x & (2 ** _LOW - 1)).sum(axis=0)]), 2 * dims, dims, integers=True)
    sums = [(int(h) << _LOW) + int(low) for h, low in zip(halves[:dims], halves[dims:], strict=True)]
    base = np.array([s // n for s in sums], np.int64) if n else np.zeros(dims, np.int64)
    rest = np.array([s % n for s in sums], np.int64) if n else np.zeros(dims, np.int64)
    return Moments(n, dims, base, rest)


def orthogonal(v: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for k in known:
            v = v - (k @ v) * k
    return v


def bidiagonalise(blocks: DataFrame, m: Moments, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B: V orthogonal, B upper bidiagonal. size: Frobenius norm of X."""
    spark = blocks.sparkSession
    dims, rng = m.dims, np.random.default_rng(11)
    right: list[np.ndarray] = []  # v
    short: list[np.ndarray] = []  # t with u = X t
    back: list[np.ndarray] = []  # X'u
    b = np.zeros((dims, dims))
    v, beta = None, 0.0
    last = None  # t of u(j-1); None where there is none
    for j in range(dims):
        if v is None:
            fresh = orthogonal(rng.standard_normal(dims), right)
            v, beta = fresh / np.linalg.norm(fresh), 0.0
        w = v - beta * last if last is not None and beta else v
        sent = spark.sparkContext.broadcast((w, np.array(short).reshape(len(short), dims).T, m))

        def each(x, sent=sent):
            w, t, m = sent.value
            rows = centred(x, m)
            p = rows @ w
            return np.concatenate([[p @ p], (rows @ t).T @ p, rows.T @ p])

        sums = total(blocks, each, 1 + len(short) + dims, dims)
        sent.unpersist()
        pp, on, xp = sums[0], sums[1:1 + len(short)], sums[1 + len(short):]
        alpha = np.sqrt(max(pp - on @ on, 0.0))
        right.append(v)
        if j:
            b[j - 1, j] = beta
        if alpha <= TOLERANCE * size:
            last, z = None, np.zeros(dims)
        else:
            b[j, j] = alpha
            last = (w - sum((c * t for c, t in zip(on, short, strict=True)), np.zeros(dims))) / alpha
            full = (xp - sum((c * z for c, z in zip(on, back, strict=True)), np.zeros(dims))) / alpha
            short.append(last)
            back.append(full)
            z = full - alpha * v
        z = orthogonal(z, right)
        beta = float(np.linalg.norm(z))
        v = z / beta if beta > TOLERANCE * size else None
    return np.array(right).reshape(dims, dims).T, b


def components(blocks: DataFrame, m: Moments, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit components as columns, their variances, trace of the covariance), by falling variance."""
    if not m.n or not m.dims:
        return np.zeros((m.dims, 0)), np.zeros(0), 0.0
    spread = total(blocks, lambda x: np.array([np.square(centred(x, m)).sum()]), 1, m.dims)[0]
    if spread == 0:
        return np.zeros((m.dims, 0)), np.zeros(0), 0.0
    right, b = bidiagonalise(blocks, m, np.sqrt(spread))
    _, sigma, turned = np.linalg.svd(b)
    take = min(most, int((sigma > 1e-9 * sigma[0]).sum()))
    found = right @ turned[:take].T
    return found / np.linalg.norm(found, axis=0), sigma[:take] ** 2 / m.n, spread / m.n


def deviations(x: np.ndarray, m: Moments) -> np.ndarray:
    """Sum over dimensions of (n x - S) ** 2, exact up to the largest long."""
    rough = np.square(m.n * centred(x, m)).sum(axis=1)
    out = np.full(len(x), 2 ** 63 - 1, np.int64)
    fits = rough < 2 ** 62
    out[fits] = np.square(m.n * (x[fits] - m.base) - m.rest).sum(axis=1)
    for i in np.flatnonzero(~fits & (rough < 2.0 ** 64)):
        out[i] = min(2 ** 63 - 1, sum((m.n * int(a) - int(r)) ** 2 for a, r in zip(x[i] - m.base, m.rest, strict=True)))
    return out


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """rows: (id long, vector array of numbers). Gives vec_id, component, n, deviation, whitened, explained, identity_error."""
    blocks = cut(pack(rows.select("id", "vector")), "vectors")
    m = moments(blocks)
    found, variances, trace = components(blocks, m, most)
    k = len(variances)
    turn = found / np.sqrt(variances)
    error = 0.0
    if k:
        def products(x):
            y = centred(x, m) @ turn
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

        sums = total(blocks, products, k + k * k, m.dims)
        mean = sums[:k] / m.n
        error = float(np.abs(sums[k:].reshape(k, k) / m.n - np.outer(mean, mean) - np.eye(k)).max())
    shares = variances / trace if k else variances
    out = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                     ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        for ids, x in blocks_of(batches, m.dims):
            if not k:
                continue
            y, away = centred(x, m) @ turn, deviations(x, m)
            for i in range(0, len(ids), 4096):
                part = y[i:i + 4096]
                c = len(part)
                yield pa.record_batch([
                    pa.array(ids[i:i + 4096], pa.int64()).take(pa.array(np.repeat(np.arange(c), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), c)),
                    pa.array(np.full(c * k, m.n, np.int64)), pa.array(np.repeat(away[i:i + 4096], k)), pa.array(part.ravel()),
                    pa.array(np.tile(shares, c)), pa.array(np.full(c * k, error))], schema=out)

    return blocks.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
