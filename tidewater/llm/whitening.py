"""Embedding whitening by a matrix-free block Lanczos iteration.

Vectors become exact integers first. The covariance of the distinct ones is never formed: each step of the iteration is
one distributed pass that centres the vectors, multiplies them by the last block and adds up the tasks' shares, a block
of (dimensions x BLOCK) numbers. The driver keeps the basis, orthogonalises every new block against all of it (twice),
replaces directions that vanish by random ones, restarts from the best Ritz vectors once the basis is full, and stops by
the residuals of the wanted pairs. Its memory depends on the dimensions alone.

Edge cases: rows with a null vector, or with a null or non-finite entry, are dropped; missing trailing entries count as
0; a null vec_id stays; repeated rows are returned repeatedly but fitted once; a direction without variance has no
component (a single distinct vector has none, and so returns no rows); an empty table gives an empty result; other
columns are ignored. Entries too large for exact 63-bit deviations raise ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import written

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Vectors of a block, blocks of a basis before a restart, and the residual (relative to the largest eigenvalue) to reach.
BLOCK, BASIS_BLOCKS, RESIDUAL, PASSES = 16, 12, 1e-12, 400
#: Eigenvalues below this share of the largest count as no variance.
RANK = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    """What ``fit`` learned: n distinct vectors, their sums (of entries less SHIFT), eigenvalues and vectors, trace, and
    the largest entry of |covariance of the whitened vectors - identity|."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows that stay; x is the contract's integer less SHIFT."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of x of one width; values beyond 2^53 are refused, as the double that they came from no longer is exact."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    if x.size and max(int(x.max()), -int(x.min())) > 1 << 53:
        raise ArithmeticError("entries too large for exact integers")
    return x


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: of 64 bits, or of Python integers where those might not do."""
    most = max(int(np.abs(x).max(initial=0)) * n, *(abs(int(s)) for s in sums), 0)
    return n * x - sums if 2 * most < 1 << 62 else n * x.astype(object) - sums.astype(object)


def _deviations(offsets: np.ndarray) -> np.ndarray:
    most = int(np.abs(offsets).max(initial=0)) if offsets.size else 0
    if offsets.dtype == object or most * most * offsets.shape[1] >= 1 << 63:
        offsets = offsets.astype(object)
    return (offsets * offsets).sum(axis=1)


def _summed(fit: DataFrame, width: int, share: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all vectors of ``share`` (an array of fixed size for a batch), as one flat array."""
    schema = pa.schema([("cell", pa.int32()), ("value", pa.int64() if kind == "long" else pa.float64())])

    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = np.ravel(share(_matrix(batch.column("x"), width)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, schema.types[1])], schema=schema)

    cells = fit.mapInArrow(part, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(cells), np.int64 if kind == "long" else np.float64)
    for r in cells:
        out[r["cell"]] = r["value"]
    return out


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block against the basis; a column that vanishes is begun again from a random one."""
    done = basis
    for j in range(min(block.shape[1], block.shape[0] - basis.shape[1])):
        v = block[:, j]
        least = 1e-12 * scale
        while True:
            for _ in range(2):
                v = v - done @ (done.T @ v)
            length = float(np.linalg.norm(v))
            if length > least:
                v = v / length
                v = v - done @ (done.T @ v)
                break
            v, least = rng.standard_normal(len(v)), 1e-8
        done = np.column_stack([done, v / np.linalg.norm(v)])
    return done[:, basis.shape[1] :]


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], width: int, want: int, block: int = BLOCK, basis_blocks: int = BASIS_BLOCKS, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, falling, and their vectors, of the symmetric operator ``apply``."""
    rng = np.random.default_rng(7)
    want = min(want, width)
    block = min(max(block, want), width)
    basis = _orthogonal(rng.standard_normal((width, block)), np.zeros((width, 0)), 0.0, rng)
    images, last = np.zeros((width, 0)), basis
    for _ in range(PASSES):
        image = apply(last)
        images = np.column_stack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :want]
        off = np.linalg.norm(images @ turn[:, :want] - ritz * values[:want], axis=0)
        if basis.shape[1] >= width or (off <= residual * max(abs(values[0]), 0.0)).all():
            return values[:want], ritz
        last = _orthogonal(image, basis, abs(values[0]), rng)
        if basis.shape[1] + block > basis_blocks * block:  # the new block is against all of the old basis, so against what is kept too
            keep = turn[:, : want + block]
            basis, images = basis @ keep, images @ keep
        basis = np.column_stack([basis, last])
    raise RuntimeError(f"no convergence in {PASSES} passes")


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Model:
    """Model of the distinct vectors of ``rows`` (x array<long> of the given width, at least one row)."""
    vectors = written(rows.select("x").distinct(), "fit")
    n = vectors.count()

    def own_sum(x):
        if int(np.abs(x).max(initial=0)) * max(n, 1) >= 1 << 62:
            raise ArithmeticError("entries too large for exact sums")
        return x.sum(axis=0)

    sums = _summed(vectors, width, own_sum, "long")

    def centred(x):
        return np.asarray(_offsets(x, n, sums) / n, np.float64)

    def covariance(block):
        def share(x):
            c = centred(x)
            return c.T @ (c @ block)

        return _summed(vectors, width, share, "double").reshape(width, -1) / n

    values, found = block_lanczos(covariance, width, components)
    some = values > max(RANK * values[0], 0.0)
    values, found = values[some], found[:, some]
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    weights = found / np.sqrt(values)

    def of_whitened(x):
        w = centred(x) @ weights
        deviation = float(_deviations(_offsets(x, n, sums)).astype(np.float64).sum())
        return np.concatenate([[deviation], w.sum(axis=0), (w.T @ w).ravel()])

    total = _summed(vectors, width, of_whitened, "double")
    k = len(values)
    mean = total[1 : 1 + k] / n
    own = total[1 + k :].reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(own - np.eye(k)).max(initial=0.0))
    return Model(n, sums, values, found, float(total[0]) / n**3, error)


def whitened(rows: DataFrame, model: Model) -> DataFrame:
    """A row for each vector and component: its exact deviation, its whitened coordinate and the component's share."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    n, k, width = model.n, len(model.values), len(model.sums)
    weights, explained = model.vectors / np.sqrt(model.values), model.values / model.trace if k else model.values

    def project(batches):
        for batch in batches:
            offsets = _offsets(_matrix(batch.column("x"), width), n, model.sums)
            w = np.asarray(offsets / n, np.float64) @ weights
            m = len(w)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviations = pa.array(_deviations(offsets).tolist(), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviations, w.ravel(), np.tile(explained, m), np.full(m * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    return rows.select("vec_id", "x").mapInArrow(project, RESULT)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row of ``embeddings`` (vec_id, embedding) on each of the first ``components`` whitened directions."""
    rows = usable(embeddings)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    rows = rows.withColumn("x", padded(F.col("x"), width))
    return whitened(rows, fit(rows, width, components))
