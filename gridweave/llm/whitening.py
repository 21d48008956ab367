"""Operator 12: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Every entry ``c`` of a vector becomes the integer ``x = floor(64 c) + 1000000``.
The fit list holds each distinct ``x`` vector once; with ``n`` of them and sums
``S``, its centred rows are ``(n x - S) / n``, exact integers until divided.

The centred rows ``X`` are never gathered and never squared into a covariance.
Each step multiplies them with the newest right vector, and the product with
``X`` transposed, in one pass over the fit list:

* a left vector has an entry for each row, so it is not stored: all left
  vectors are products of ``X`` with a small matrix, and a task makes the
  entries of its own rows anew in each pass;
* a pass gives, summed by Spark over the tasks' partial sums, the length of
  the new product, its products with *all* earlier left vectors, and ``X``
  transposed times it: as many numbers as there are dimensions and steps;
* both sides are orthogonalised fully, each time twice: the left side once
  from what earlier passes know and once from the measured products, the right
  side twice on the driver, which holds one number for each dimension and step.

The small bidiagonal matrix's SVD gives the components (its right vectors
combined) and deviations (its singular values over ``sqrt(n)``). Steps go on
until the wanted components' residuals are below double precision, or until
there are as many as dimensions, when the factorisation is complete. When a
step finds an invariant space (repeated eigenvalues, rows in a subspace), a new
start orthogonal to it goes on, so no component is missed.

Vectors that are null, empty, or hold null or non-finite entries take no part;
nor do those of another length than the most frequent one (ties: the longer).
Repeated rows give rows of their own and stand once in the fit list. Components
whose eigenvalue is 0 to double precision are not returned; without one (no
rows, or all alike) the result is empty. ``deviation`` is null where it does not
fit a long. A component's sign is such that its largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
ROWS = 4096  # rows of a task's matrix at once
PRECISE = 1e-15  # residual of a component, in largest singular values, at which steps end
NONE = 1e-12  # a singular value below this share of the largest is 0


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part, ``x`` as integers without the shift."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter((F.size("v") > 0) & sound)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (length["d"] if length else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as integer matrices, of bounded size."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            col = batch.column(batch.schema.get_field_index(column))
            yield batch, col.flatten().to_numpy().reshape(len(col), -1)


def added(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum, over all matrices of ``rows``, of the vectors that ``of`` makes of them.

    A task sums its own, and Spark the tasks', number by number; what comes
    to the driver is one vector.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches):
            got = of(x)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    sums = rows.select("x").mapInArrow(part, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(sums.num_rows, np.int64 if kind == "bigint" else np.float64)
    out[sums["at"].to_numpy()] = sums["value"].to_numpy()
    return out


class Fit:
    """Components of the fit list ``rows`` (distinct integer vectors, staged)."""

    def __init__(self, rows: DataFrame, seed: int, components: int = COMPONENTS):
        first = added(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "bigint")
        self.n, self.sums = (int(first[0]), first[1:]) if len(first) else (0, np.zeros(0, np.int64))
        self.d = len(self.sums)
        self.components = np.zeros((self.d, 0))
        self.deviations, self.explained = np.zeros(0), np.zeros(0)
        self.steps = 0
        if self.n:
            self._bidiagonalise(rows, seed, components)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def _bidiagonalise(self, rows: DataFrame, seed: int, wanted: int) -> None:
        centred, d = self.centred(), self.d
        rng = np.random.default_rng(seed)
        right = np.zeros((d, 0))  # right vectors, orthonormal
        makes = np.zeros((d, 0))  # X @ makes are the left vectors, orthonormal
        back = np.zeros((d, 0))  # X.T @ left vectors
        upper = np.zeros((0, 0))  # left.T @ X @ right, upper bidiagonal

        def product(z: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
            """Of ``p = X z``: products with the left vectors, squared length, and ``X.T p``; one pass."""
            both = np.column_stack([makes, z])

            def of(x: np.ndarray) -> np.ndarray:
                a = centred(x)
                p = a @ both
                return np.concatenate([p.T @ p[:, -1], a.T @ p[:, -1]])

            got, k = added(rows, of), makes.shape[1]
            return got[:k], got[k], got[k + 1 :]

        def clean(v: np.ndarray, q: np.ndarray) -> np.ndarray:
            for _ in range(2):
                v = v - q @ (q.T @ v)
            return v

        total = added(rows, lambda x: np.array([np.square(centred(x)).sum()]))[0]  # the squared Frobenius norm
        v, beta = rng.normal(size=d), 0.0
        v /= np.linalg.norm(v)
        while total > 0 and self.steps < d:
            k = self.steps
            z = v - makes[:, -1] * beta if k else v
            z = z - makes @ (back.T @ z)  # left side, from what is known
            g, square, h = product(z)
            z, h = z - makes @ g, h - back @ g  # left side, as measured
            alpha = float(np.sqrt(max(square - g @ g, 0.0)))
            upper = np.pad(upper, ((0, 1), (0, 1)))
            upper[k, k] = alpha
            if k:
                upper[k - 1, k] = beta
            right = np.column_stack([right, v])
            self.steps += 1
            floor = NONE * np.sqrt(total)
            if alpha > floor:
                makes, back = np.column_stack([makes, z / alpha]), np.column_stack([back, h / alpha])
                w = clean(h / alpha - alpha * v, right)
            else:  # the rows have nothing along v but what earlier left vectors hold
                makes, back = np.column_stack([makes, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
                w = np.zeros(d)
            beta = float(np.linalg.norm(w))
            p, s, qt = np.linalg.svd(upper)
            if self.steps >= min(wanted, d) and beta > floor and np.all(beta * np.abs(p[-1, :wanted]) <= PRECISE * s[0]):
                break
            if beta <= floor:  # an invariant space: go on outside it
                beta = 0.0
                w = clean(rng.normal(size=d), right)
                if self.steps == d:
                    break
            v = w / np.linalg.norm(w)
        if not self.steps:
            return
        _, s, qt = np.linalg.svd(upper)
        live = s[:wanted] > NONE * s[0]
        found = (right @ qt.T)[:, : len(live)][:, live]
        turn = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
        self.components = found * turn
        self.deviations = s[: len(live)][live] / np.sqrt(self.n)
        self.explained = s[: len(live)][live] ** 2 / total

    def project(self) -> Callable[[np.ndarray], np.ndarray]:
        centred, q = self.centred(), self.components / self.deviations
        return lambda x: centred(x) @ q

    def identity_error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the whitened fit list's covariance minus the identity; one pass."""
        project, k = self.project(), len(self.deviations)

        def of(x: np.ndarray) -> np.ndarray:
            w = project(x)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        got = added(rows, of) / self.n
        mean = got[:k]
        return float(np.abs(got[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, seed: int, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row that takes part and every component."""
    rows = stage(integers(vectors, id_col, vec_col), "vectors")
    distinct = stage(rows.select("x").distinct(), "fit")
    fit = Fit(distinct, seed, components)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    k, n, sums = len(fit.deviations), fit.n, fit.sums
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error, project, explained = fit.identity_error(distinct), fit.project(), fit.explained

    def far(x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact."""
        off = n * x - sums
        most = float(np.abs(off).max())
        if most * most * off.shape[1] < 2.0**62:
            return np.square(off).sum(axis=1).tolist()
        out = [sum(int(c) ** 2 for c in row) for row in off]
        return [s if s < 1 << 63 else None for s in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches):
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(far(x), pa.int64()).take(at), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
