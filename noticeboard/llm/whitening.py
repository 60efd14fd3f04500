"""Embedding whitening: principal components by matrix-free block subspace iteration, and vectors scaled by them.

The covariance V of the vectors is never formed. A pass over the rows multiplies it by a block Q of columns: each task
adds up X'(XQ) over its centred rows, Spark adds up the tasks' (dimensions x columns) cells. The driver does the QR step
and Rayleigh-Ritz on the block's image. The blocks of earlier passes stay in the trial space, up to `MEMORY` columns (then
the best are kept), which needs few passes where eigenvalues lie close together: plain iteration gains only their ratio in
each. Iteration ends when all components' residuals |V y - e y|, from a pass of their own over the components, are under
`TOLERANCE` of the greatest eigenvalue, or when the trial space holds all that V can reach and only rounding is left.

Rows are centred exactly: entries are integers, n * x - sum is one too, and only then becomes a double.

Scale. Vectors aren't shuffled, collected or stored; a fit reads them some five to ten times (two passes for their length
and sums). What goes to the driver is bounded by dimensions x (BLOCK + 1) cells, what is sent along by dimensions x BLOCK.
Any task can be run again: a pass depends on its block only.

Defined cases: null vectors and those with null or non-finite entries get no row (see `vectors.kept`); components
without variance (an eigenvalue under 1e-12 of all variance) aren't returned, so equal vectors or a single one get no rows, nor
does an empty table; there are at most as many components as dimensions; repeated rows and rows of one id each count and
get their own values, a null id too; `deviation` is null where it exceeds a long, `deviation_exact` has it then; other
columns play no part and are kept by `whiten`.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import free_name, map_arrow, table
from noticeboard.llm.vectors import kept, matrix, scaled, sums

COMPONENTS, BLOCK, MEMORY, TOLERANCE, SHIFT, PASSES = 8, 16, 256, 1e-12, 100_000, 200


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # (dimensions, components)
    values: np.ndarray
    trace: float
    residual: float  # greatest of all components, as a share of the first eigenvalue
    identity_error: float
    passes: int


def offsets(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - sum, exactly: longs where they fit, else Python's integers."""
    most = n * int(np.abs(x).max(initial=0))
    if most < 2**62:  # then no sum is greater either
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return offsets(x, n, total).astype(np.float64) / n


def _totals(df: DataFrame, vec_col: str, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sums of their entries."""

    def add(state: np.ndarray, b: pa.RecordBatch) -> None:
        x = scaled(matrix(b.column(0), d), SHIFT)
        small = int(np.abs(x).max(initial=0)) * len(x) < 2**62
        state[:d] += (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        state[d] += len(x)

    got = sums(df, [vec_col], lambda: np.zeros(d + 1, object), add, exact=True)
    return got.get(d, 0), [got.get(i, 0) for i in range(d)]


def _product(df: DataFrame, vec_col: str, n: int, total: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V times the columns of q, and V's trace: one pass over the rows."""
    d, b = q.shape

    def add(state: np.ndarray, batch: pa.RecordBatch) -> None:
        for i in range(0, batch.num_rows, 4096):
            x = centred(scaled(matrix(batch.column(0).slice(i, 4096), d), SHIFT), n, total)
            state[:-1] += (x.T @ (x @ q)).ravel()
            state[-1] += np.einsum("ij,ij->", x, x)

    got = sums(df, [vec_col], lambda: np.zeros(d * b + 1), add, exact=False)
    out = np.array([got.get(i, 0.0) for i in range(d * b + 1)]) / n
    return out[:-1].reshape(d, b), float(out[-1])


def _outside(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what x has beside the basis."""
    size = np.linalg.norm(x, axis=0)
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    x = x[:, np.linalg.norm(x, axis=0) > 1e-10 * np.maximum(size, 1e-300)]
    if not x.shape[1]:
        return x
    u, s, _ = np.linalg.svd(x / np.linalg.norm(x, axis=0), full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def _ritz(q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the trial space q with z = V q: values by falling size, their vectors, and V times these."""
    h = q.T @ z
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return values[::-1], q @ u, z @ u


def iterate(multiply, d: int, k: int, *, block: int = BLOCK, memory: int = MEMORY, tolerance: float = TOLERANCE, most: int = PASSES):
    """The k greatest eigenvalues, their vectors, V times these, the residual, and the number of passes. multiply(q): V q."""
    rng = np.random.default_rng(20240501)
    random = lambda n: rng.standard_normal((d, n))
    block, memory = min(max(block, k), d), max(memory, 3 * max(block, k))
    q, z, new = np.zeros((d, 0)), np.zeros((d, 0)), np.linalg.qr(random(block))[0]
    best = None
    for passes in range(1, most + 1):
        q, z = np.c_[q, new], np.c_[z, multiply(new)]
        values, y, vy = _ritz(q, z)
        residual = np.linalg.norm(vy[:, :k] - y[:, :k] * values[:k], axis=0).max()
        new = _outside(np.c_[vy[:, :block], random(2)], q) if q.shape[1] < d else np.zeros((d, 0))
        full = not new.shape[1]
        if full or residual <= tolerance * values[0]:
            y = np.linalg.qr(y[:, :k])[0]
            image = multiply(y)  # the residuals that count are of a pass over the components themselves
            values, y, vy = _ritz(y, image)
            residual = np.linalg.norm(vy - y * values, axis=0).max()
            share = residual / max(values[0], 1e-300)
            if best is None or share < best[3]:
                best = values, y, vy, share, passes + 1
            if full or residual <= tolerance * values[0]:
                break
        if q.shape[1] + new.shape[1] > memory:  # the best vectors, and room for new ones
            q, z = y[:, : max(block, 2 * k)], vy[:, : max(block, 2 * k)]
            new = _outside(new, q)
    if best is None:
        raise RuntimeError(f"residuals aren't under {tolerance} after {most} passes")
    return best


def learn(df: DataFrame, *, vec_col: str = "embedding", k: int = COMPONENTS, block: int = BLOCK, memory: int = MEMORY, tolerance: float = TOLERANCE) -> Model:
    """The components of all kept vectors of df."""
    df, d = kept(df, vec_col)
    n, total = _totals(df, vec_col, d) if d else (0, [])
    k = min(k, d)
    if not n or not k:
        return Model(n, total, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    trace = [0.0]

    def multiply(q: np.ndarray) -> np.ndarray:
        z, trace[0] = _product(df, vec_col, n, total, q)
        return z

    values, y, vy, residual, passes = iterate(multiply, d, k, block=block, memory=memory, tolerance=tolerance)
    some = values > 1e-12 * trace[0]
    values, y, vy = values[some], y[:, some], vy[:, some]
    y, vy = (m * np.where(y[np.abs(y).argmax(axis=0), np.arange(y.shape[1])] < 0, -1.0, 1.0) if y.shape[1] else m for m in (y, vy))
    root = np.sqrt(values)
    gram = (y / root).T @ (vy / root)  # the covariance of the whitened values
    return Model(n, total, y, values, trace[0], float(residual), float(np.abs(gram - np.eye(len(values))).max(initial=0.0)), passes)


KIND = "struct<values:array<double>,deviation:decimal(38,0)>"


def whiten(df: DataFrame, model: Model, *, vec_col: str = "embedding", name: str = "whitened") -> DataFrame:
    """The kept rows of df with a column of whitened values by component, and the deviation: the exact sum over dimensions of (n * x - sum)^2."""
    df, d = kept(df, vec_col)
    n, total, to = model.n, model.sums, model.vectors / np.sqrt(model.values)
    name = free_name(df, name)
    if d != len(total):
        df = df.limit(0)

    def run(b: pa.RecordBatch) -> list:
        x = scaled(matrix(b.column(b.schema.get_field_index(vec_col)), d), SHIFT)
        off = offsets(x, n, total)
        if off.dtype != object and (float(np.abs(off).max(initial=0)) ** 2) * max(d, 1) < 2**62:
            deviation = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
        else:
            exact = (off.astype(object) ** 2).sum(axis=1)
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
        y = off.astype(np.float64) / n @ to
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * to.shape[1], pa.int32()), pa.array(y.ravel()))
        return [pa.StructArray.from_arrays([values, deviation], names=["values", "deviation"])]

    return map_arrow(df, run, f"`{name}` {KIND}", keep=True)


def op11(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = learn(vectors)
    rows = whiten(vectors, model).select("vec_id", "whitened.deviation", F.posexplode("whitened.values").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if len(model.values) else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"), F.col("deviation").alias("deviation_exact"))
