"""Operator 11: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, rows are centred by exact sums and written once as
blocks of rows. Each step multiplies all centred rows X with a vector v and the result
with X transposed, in one pass: tasks return sums of the length of a row. Left vectors u
are as long as the table and are never stored: u = Xp, with p kept on the driver, so a
pass can take the products with all earlier ones. Left and right vectors are
orthogonalised against all before them, twice where much cancels. The singular values of
the small bidiagonal matrix are the deviations times the root of the number of rows, its right vectors give the
components. Where the steps end early (an invariant subspace), they go on from a random
vector orthogonal to all before; after the components have settled, a second run in what
is orthogonal to them looks for further copies of an equal deviation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.llm.scratch import Scratch
from venuegrid.llm.ship import ship

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
BLOCK_ROWS = 4_096
SETTLED = 1e-13  # residual of a component, relative to the largest singular value
_NOTHING = 1e-12  # relative length below which a vector counts as zero
_MOST = 2.0**62  # whole numbers beyond are worked out without a fixed width


@dataclass
class Fit:
    """What whitening needs: number of rows, sums, components as columns, deviations, explained shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def _whole(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64) + SHIFT


def _good(batch: pa.RecordBatch, dimension: int | None = None) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vectors can be used, and these as a matrix; without a dimension, only the lengths of the vectors."""
    column = batch.column("v").cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    values = column.values.to_numpy(zero_copy_only=False)  # missing entries become nan
    fits = np.abs(SCALE * values) < _MOST
    bad = np.concatenate([[0], np.cumsum(~fits)])
    size = np.diff(offsets)
    good = np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (size > 0)
    if dimension is None:
        return batch, size[good]
    good &= size == dimension
    places = offsets[:-1][good][:, None] + np.arange(dimension)
    return batch.filter(pa.array(good)), _whole(values[places])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, n = np.unique(_good(batch)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["size", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole numbers, with their ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            rows, x = _good(batch.slice(at, BLOCK_ROWS), dimension)
            if rows.num_rows:
                ids = rows.column("id")
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])


def _sums(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of each dimension in two halves of 32 bits, so that none overflows."""
    for batch in batches:
        for raw in batch.column("x").to_pylist():
            x = np.frombuffer(raw, np.int64).reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dimension)), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))], names=["k", "high", "low"]
            )


def times_n_less_sums(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they suffice, else Python's."""
    if len(x) and n * max(int(x.max()), -int(x.min()), 1) + max(map(abs, sums)) >= _MOST:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def _centred(raw: bytes, n: int, sums: list[int]) -> np.ndarray:
    x = np.frombuffer(raw, np.int64).reshape(-1, len(sums))
    return (times_n_less_sums(x, n, sums) / n).astype(np.float64)


def _product(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums over rows of (Xp)(Xv) for each earlier p and v itself, then of X times Xv."""
    n, sums, earlier, v = shared.value
    total = np.zeros(earlier.shape[1] + 1 + len(v))
    for batch in batches:
        for raw in batch.column("x").to_pylist():
            x = _centred(raw, n, sums)
            r = x @ v
            total += np.concatenate([(x @ earlier).T @ r, [r @ r], r @ x])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "s"])


def _products(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums of products of all pairs of projections, and of the squares of all entries."""
    n, sums, w = shared.value
    total = np.zeros(w.shape[1] ** 2 + 1)
    for batch in batches:
        for raw in batch.column("x").to_pylist():
            x = _centred(raw, n, sums)
            z = x @ w
            total += np.append((z.T @ z).ravel(), (x * x).sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "s"])


class _Rows:
    """The written blocks, and sums over them."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.sums = blocks.select("x"), n, sums

    def _total(self, work, values) -> np.ndarray:
        shared = self.blocks.sparkSession.sparkContext.broadcast((self.n, self.sums, *values))  # a few vectors of the length of a row
        table = self.blocks.mapInArrow(partial(work, shared=shared), "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(table.num_rows)
        out[table["k"].to_numpy()] = table["s"].to_numpy()
        shared.unpersist()
        return out

    def product(self, earlier: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """((Xp)(Xv) for the columns p of ``earlier``, |Xv|^2, X'Xv)."""
        found, k = self._total(_product, (earlier, v)), earlier.shape[1]
        return found[:k], float(found[k]), found[k + 1:]

    def products(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        found, k = self._total(_products, (w,)), w.shape[1]
        return found[:-1].reshape(k, k), float(found[-1])


def _away(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along the basis, taken out twice."""
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonal(rows: _Rows, dimension: int, wanted: int, known: list[np.ndarray], floor: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, components as columns) of the largest in what is orthogonal to ``known``, at most ``wanted``.

    Ends once they have settled, or once it is clear that none exceeds ``floor``.
    """
    draw = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    earlier, ahead = np.zeros((dimension, 0)), np.zeros((dimension, 0))  # p and X'Xp of the left vectors
    alphas: list[float] = []
    betas: list[float] = []
    v, scale = None, 0.0
    while len(right) + len(known) < dimension:
        if v is None:  # at the start, and after the steps have ended early
            v = _away(draw.normal(size=dimension), known + right)
            v /= np.linalg.norm(v)
        right.append(v)
        p, w = v, None
        while True:
            dots, square, w = rows.product(earlier, p)
            left = square - float(dots @ dots)
            p, w, before = p - earlier @ dots, w - ahead @ dots, square
            if left > 0.25 * before or left <= (_NOTHING * scale) ** 2:
                break
            # much has cancelled: once more, from what is left
        scale = max(scale, np.sqrt(max(before, 0.0)))
        alpha = np.sqrt(max(left, 0.0))
        if alpha <= _NOTHING * scale or not scale:
            alphas.append(0.0)
            betas.append(0.0)
            earlier, ahead = np.column_stack([earlier, np.zeros(dimension)]), np.column_stack([ahead, np.zeros(dimension)])
            v = None
        else:
            alphas.append(alpha)
            earlier, ahead = np.column_stack([earlier, p / alpha]), np.column_stack([ahead, w / alpha])
            rest = _away(w / alpha - alpha * v, known + right)
            beta = float(np.linalg.norm(rest))
            ended = beta <= _NOTHING * scale
            betas.append(0.0 if ended else beta)
            v = None if ended else rest / beta
        k = len(right)
        small = np.diag(alphas) + np.diag(betas[:-1], 1)
        left_small, values, right_small = np.linalg.svd(small)
        residual = betas[-1] * np.abs(left_small[k - 1])
        top = min(wanted, k)
        if betas[-1] and (residual[:top] <= SETTLED * scale).all() and (k >= wanted or (values[:top] < floor).any()):
            break
        if betas[-1] and values[0] + residual[0] < floor and residual[0] <= 1e-3 * scale and k > 3:
            break
    if not right:
        return np.zeros(0), np.zeros((dimension, 0))
    top = min(wanted, len(values))
    return values[:top], np.column_stack(right) @ right_small[:top].T


def fit(blocks: DataFrame, n: int, sums: list[int], components: int) -> Fit:
    dimension, rows = len(sums), _Rows(blocks, n, sums)
    values, vectors = np.zeros(0), np.zeros((dimension, 0))
    for seed in range(dimension):
        floor = values[components - 1] if len(values) >= components else 0.0
        more, found = bidiagonal(rows, dimension, components, list(vectors.T), floor, seed)
        take = more > floor * (1 + 1e-12) if floor else more > 0
        if not take.any():
            break
        values, vectors = np.concatenate([values, more[take]]), np.column_stack([vectors, found[:, take]])
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        if len(values) < components:
            break
    kept = values > 1e-9 * values.max(initial=0.0)
    values, vectors = values[kept], vectors[:, kept]
    # the columns are orthonormal already but for rounding; the sign makes the largest entry positive
    vectors = np.linalg.qr(vectors)[0] if len(values) else vectors
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]) if len(values) else np.ones(0)
    vectors = vectors * signs
    deviations = values / np.sqrt(n)
    gram, squares = rows.products(vectors / deviations)
    error = float(np.abs(gram / n - np.eye(len(values))).max(initial=0.0))
    return Fit(n, sums, vectors, deviations, values**2 / squares if squares else values, error)


def _whitened(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    found: Fit = shared.value
    k = len(found.deviations)
    for batch in batches:
        for at in range(batch.num_rows):
            ids, raw = batch.column("ids").slice(at, 1).flatten(), batch.column("x")[at].as_py()
            x = np.frombuffer(raw, np.int64).reshape(-1, len(found.sums))
            exact = times_n_less_sums(x, found.n, found.sums)
            z = (exact / found.n).astype(np.float64) @ (found.components / found.deviations)
            if exact.dtype == object or (len(exact) and float(np.abs(exact).max()) ** 2 * exact.shape[1] >= _MOST):
                totals = [sum(int(e) ** 2 for e in row) for row in exact]
                deviation = pa.array([t if t < 2**63 else None for t in totals], pa.int64())
            else:
                deviation = pa.array((exact * exact).sum(axis=1))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                deviation.take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(z.ravel()), pa.array(np.tile(found.explained, len(x))),
            ], names=["id", "component", "deviation", "whitened", "explained"])


def whitened(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Entries c become x = floor(1024 c) + 100000. ``deviation`` is the exact sum of
    (n x - S)^2 over the dimensions, null beyond 64 bits; ``whitened`` the centred row on the component over
    its standard deviation; ``explained`` the component's share of the variance;
    ``identity_error`` the largest deviation of the covariance of ``whitened`` from
    the identity. Components follow by falling variance; those without any are left
    out, so fewer rows or dimensions give fewer, and equal rows alone give none.

    Rows are left out whose vector is missing, empty, holds missing or non-finite
    entries or ones of 2^52 and more, or has another length than most (of equally
    frequent lengths the largest counts). Equal or missing ids are rows of their own. Other columns are not read. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(vectors[f"`{vec_id}`"].alias("id"), vectors[f"`{vector}`"].alias("v"))
    kind = vectors.schema[vec_id].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    ])
    size = rows.select("v").mapInArrow(_sizes, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).head()
    if size is None:
        out, found = spark.createDataFrame([], schema), Fit(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    else:
        ddl = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType())])
        with Scratch(spark) as scratch:
            blocks = scratch.keep(rows.mapInArrow(partial(_blocks, dimension=size["size"]), ddl), "blocks")
        halves = blocks.select("x").mapInArrow(partial(_sums, dimension=size["size"]), "k long, high long, low long")
        halves = halves.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("k").collect()  # a line for each dimension
        found = fit(blocks, size["n"], [(h["high"] << 32) + h["low"] for h in halves], components)
        out = blocks.mapInArrow(partial(_whitened, shared=spark.sparkContext.broadcast(found)), schema)
    return out.select(
        F.col("id").alias(vec_id), "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(found.identity_error).alias("identity_error"),
    )
