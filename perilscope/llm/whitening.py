"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The vectors, as integers, are fitted once each. Their centred rows X are never gathered: each
step multiplies them, block by block in the tasks, with a vector v of one number for each
dimension (Xv, a number for each row), and the result back with X (Xᵀu, a number for each
dimension). What reaches the driver is the size of a few vectors. The bidiagonal matrix that the
steps give is small; its singular values and vectors are those of X, which are the components and
their deviations.

A left vector has a number for each row, but lies in the range of X: it is kept as the
coefficients p of dimensions with u = Xp, and worked out from the rows where it is needed. So no
step writes anything, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of, staged

LONG = 2**63


@dataclass(frozen=True)
class Rules:
    """``components`` are returned, of vectors rounded down to multiples of 1 / ``scale``. Steps
    end when the residuals of these components are below ``tolerance`` of the largest singular
    value, or when there are as many as dimensions. ``block`` numbers are worked on at a time,
    ``task_bytes`` of them by a task."""

    components: int = 4
    scale: int = 256
    tolerance: float = 1e-15
    block: int = 1 << 18
    task_bytes: int = 1 << 24
    seed: int = 42


def whole(vector: Column, scale: int) -> Column:
    """The entries as integers, ``floor(scale * c)``; beyond a long its nearest value."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all are finite numbers."""

    def finite(c: Column) -> Column:
        d = c.cast("double")
        return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def packed(vectors: DataFrame, size: int, rules: Rules) -> DataFrame:
    """Blocks of ``vectors`` (a column ``x`` of ``size`` numbers): ``n``, ``x`` as bytes."""
    most = max(1, rules.block // size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), most):
                x = batch.column(0).slice(at, most)
                flat = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "x"]
                )

    return vectors.select("x").mapInArrow(run, "n bigint, x binary")


def added(blocks: DataFrame, each, length: int, kind: str = "double") -> np.ndarray | list[int]:
    """The sums over all blocks of ``each(rows)``, which gives ``length`` numbers.

    Tasks add up their own blocks, and give one row of ``length`` numbers each.
    """

    names = [f"v{i}" for i in range(length)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = each(np.frombuffer(x.as_buffer(), np.int64).reshape(n, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    parts = blocks.mapInArrow(run, ", ".join(f"{n} {kind}" for n in names))
    found = [v or 0 for v in parts.agg(*[F.sum(n).alias(n) for n in names]).first()]
    return np.array(found, float) if kind == "double" else found


def moments(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of all dimensions."""

    def each(x: np.ndarray) -> np.ndarray:
        # high and low halves, so that no sum leaves 64 bits
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    found = added(blocks, each, 1 + 2 * size, "bigint")
    return found[0], [(h << 32) + low for h, low in zip(found[1 : size + 1], found[size + 1 :])]


@dataclass(frozen=True)
class Fit:
    """``n`` distinct vectors with the sums ``sums``; ``vectors`` has a unit eigenvector of their
    covariance in each column, with its eigenvalue in ``values``, falling; ``trace`` is the sum
    of all eigenvalues and ``identity_error`` the largest entry by which the covariance of the
    whitened vectors differs from the identity."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    #: Steps of the bidiagonalisation.
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` less its parts along the columns of ``basis``, taken off twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalised(
    blocks: DataFrame, mean: np.ndarray, total: float, rules: Rules
) -> tuple[np.ndarray, list[float], list[float]]:
    """Right vectors V and the bidiagonal B with Xᵀ X V = V Bᵀ B for the centred rows X.

    One step: u = X v, less its parts along the earlier left vectors, gives the diagonal; Xᵀ u,
    less its parts along the earlier right vectors, gives the next right vector and what stands
    beside the diagonal. Where nothing is left, the next vector is one at right angles to all.
    ``total`` is the sum of all squares in X.
    """
    d = len(mean)
    random = np.random.default_rng(rules.seed)
    v = random.standard_normal(d)
    v /= np.linalg.norm(v)
    right, left = np.zeros((d, 0)), np.zeros((d, 0))  # columns v, and p with u = X p
    back = np.zeros((d, 0))  # Xᵀ u of each left vector
    diagonal, beside = [], []
    beta, scale = 0.0, 0.0
    for step in range(d):
        p = v - (beta * left[:, -1] if step else 0.0)

        def each(x: np.ndarray, p: np.ndarray = p) -> np.ndarray:
            centred = x - mean
            u = centred @ p
            return centred.T @ u

        w = added(blocks, each, d)
        # u less its parts along earlier left vectors: both are combinations of the rows, so the
        # products with Xᵀ, which are known, change in the same way
        for _ in range(2):
            along = left.T @ w
            p, w = p - left @ along, w - back @ along
        alpha = float(np.sqrt(max(p @ w, 0.0)))
        scale = max(scale, alpha)
        right = np.column_stack([right, v])
        if alpha <= scale * 1e-12 or alpha == 0.0:
            # v has no part in the rows: a zero on the diagonal, and the steps begin anew
            alpha, p, w = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, w = p / alpha, w / alpha
        left, back = np.column_stack([left, p]), np.column_stack([back, w])
        diagonal.append(alpha)
        following = orthogonal(w - alpha * v, right)
        beta = float(np.linalg.norm(following))
        scale = max(scale, beta)
        if beta <= scale * 1e-13 or beta == 0.0:
            beta, following = 0.0, orthogonal(random.standard_normal(d), right)
        beside.append(beta)
        size = np.linalg.norm(following)
        if step + 1 == d or size == 0.0:
            break
        v = orthogonal(following / size, right)
        v /= np.linalg.norm(v)
        if step + 1 >= rules.components and converged(diagonal, beside, total, rules):
            break
    return right, diagonal, beside


def small_svd(diagonal: list[float], beside: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(np.diag(diagonal) + np.diag(beside[:-1], 1))


def converged(diagonal: list[float], beside: list[float], total: float, rules: Rules) -> bool:
    """Whether further steps would change none of the wanted components.

    A component is off by its residual over the distance to its neighbours. What the steps have
    not seen of ``total`` must be too little for another component, so that none of several
    equal ones is missed.
    """
    u, s, _ = small_svd(diagonal, beside)
    last = min(rules.components, len(s)) - 1
    unseen = total - sum(a * a for a in diagonal) - sum(b * b for b in beside[:-1])
    if unseen >= s[last] ** 2:
        return False
    residuals = beside[-1] * np.abs(u[-1, : last + 1])
    gaps = np.abs(np.diff(s, append=0.0))[: last + 1]
    near = np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))
    return bool((residuals <= rules.tolerance * near).all())


def fit(vectors: DataFrame, size: int, rows: int, rules: Rules = Rules()) -> Fit | None:
    """The components of the distinct ``vectors``, a column ``x`` of ``size`` integers, of at
    most ``rows`` rows; None without any. Components without variance are left out.

    Each step passes over all blocks, so a task has about ``task_bytes`` of them.
    """
    tasks = -(-rows * size * 8 // rules.task_bytes)
    blocks = staged(packed(vectors.select("x").distinct().coalesce(max(1, tasks)), size, rules))
    n, sums = moments(blocks, size)
    if n == 0:
        return None
    mean = np.array([s / n for s in sums])
    total = float(added(blocks, lambda x: ((x - mean) ** 2).sum()[None], 1)[0])
    right, diagonal, beside = bidiagonalised(blocks, mean, total, rules)
    _, s, vt = small_svd(diagonal, beside)
    found = (right @ vt.T)[:, : rules.components]
    # the spectrum's rounding errors are no components
    found = found[:, s[: rules.components] > s[0] * 1e-7] if s[0] > 0 else found[:, :0]
    k = found.shape[1]
    if not k:
        return Fit(n, tuple(sums), found, np.zeros(0), total / n, 0.0, len(diagonal))

    def each(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        y = centred @ found
        return (y.T @ y).ravel()

    covariance = added(blocks, each, k * k).reshape(k, k) / n
    values = np.diag(covariance).copy()
    root = np.sqrt(values)
    error = float(np.abs(covariance / np.outer(root, root) - np.eye(k)).max())
    return Fit(n, tuple(sums), found, values, total / n, error, len(diagonal))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sums of ``(n * x - S) ** 2``; null where they leave 64 bits."""
    largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    far = n * largest + max((abs(s) for s in sums), default=0)
    if far * far * max(x.shape[1], 1) < LONG:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(1).tolist()
    out = []
    for row in x.tolist():
        total = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        out.append(total if total < LONG else None)
    return out


def whiten(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", rules: Rules = Rules()
) -> DataFrame:
    """Whitened coordinates: a row for each row of ``df`` and component, with ``id``,
    ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error`` and ``eigenvalue``.

    Rows whose vector is null or empty, or holds null or a number that is not finite, are left
    out, and so are those of another length than the most frequent one (the longer one of equally
    frequent). Each distinct vector of integers is fitted once, repeated rows all get their
    result, a null id stays null. Components without variance are left out, so that a table with
    one distinct vector, like an empty one, gives no rows. ``deviation`` is null where it does
    not fit 64 bits. Equal eigenvalues have no order of their own; any basis may be returned.
    """
    given = df.select(col_of(id).alias("id"), col_of(vector).alias("v")).where(usable(F.col("v")))
    rows = given.select("id", whole(F.col("v"), rules.scale).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    id_type = df.schema[id].dataType.simpleString()
    schema = (
        f"id {id_type}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double, eigenvalue double"
    )
    found = None
    if most is not None:
        rows = rows.where(F.size("x") == most["size"])
        found = fit(rows, most["size"], most["n"], rules)
    if found is None or found.vectors.shape[1] == 0:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    mean, k = found.mean, found.vectors.shape[1]
    onto = found.vectors / np.sqrt(found.values)
    step = max(1, rules.block // most["size"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, len(b), step)):
            m = len(batch)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(m, -1)
            again = np.repeat(np.arange(m), k)
            apart = pa.array(deviations(x, found.n, found.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, found.n), pa.int64()),
                    apart.take(pa.array(again)),
                    pa.array(((x - mean) @ onto).ravel()),
                    pa.array(np.tile(found.values / found.trace, m)),
                    pa.array(np.full(m * k, found.identity_error)),
                    pa.array(np.tile(found.values, m)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    return rows.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id)
