"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become whole numbers x = floor(256 c). Each distinct vector counts once in the fit. Two passes over the distinct
vectors give n and the sums S, and then the centred scatter: entries are centred at their rounded mean before they are
multiplied, in whole numbers, and what rounding left is set off on the driver, so the covariance is exact whatever the
dealing. The driver turns the symmetric matrix (d x d for vectors of d entries, nothing that grows with the rows) by Jacobi
rotations, pair by pair in cycles, until every entry off the diagonal has vanished against its two diagonal ones; that
stopping rule keeps small eigenvalues accurate. Sorted components, divided by the roots of their eigenvalues, are the
whitening matrix; it goes to all tasks, and one more pass applies it to each row.

Scale: the distinct vectors are one shuffle with partial aggregation, so copies meet only once for a task. Partial sums are
d and d x d numbers a task, added by d and d x d groups. What is sent to all tasks has 4 (d + 1) numbers.

Rows are left out if the vector is null, or holds null or a value that is not finite. Ids may be null or repeat: each row is
returned. Vectors of other lengths are other spaces: each length is fitted by itself. An empty vector has no components.
A component whose eigenvalue is nothing but rounding (equal vectors, dependent dimensions) can't be whitened: `whitened` is
null, its `explained` is 0 (null if nothing varies at all), and it takes no part in identity_error. `deviation` is exact, and
null where it does not fit in a long. Entries that do not fit in a long stop at its ends. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import Scratch, tidy

COMPONENTS = 4
SCALE = 256
MOST_SWEEPS = 60
#: Rows worked on at once in a task.
ROWS = 4096
EPS = np.finfo(np.float64).eps
#: Whole numbers beyond a long go through Spark as high * 2**SPLIT + low.
SPLIT = 62
NUMBER = "high decimal(38,0), low long"


class Fit(NamedTuple):
    """What is known of the vectors of one length: n, sums, rounded means and what they lack, eigenvalues, the matrix that whitens, and the trace."""

    n: int
    sums: list[int]
    means: list[int]
    lack: np.ndarray
    values: np.ndarray
    matrix: np.ndarray
    trace: float


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries only."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(0).cast("long"))
    return rows.where(good).select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Lots of rows whose vectors have one length, and the vectors as a matrix of long numbers."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            lot = whole.slice(a, ROWS)
            lengths = pc.list_value_length(lot.column("x"))
            for d in sorted(lengths.unique().to_pylist()):
                b = lot.filter(pc.equal(lengths, d))
                if d:
                    yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums, as Python's whole numbers."""
    return (x if largest(x) * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)


def centred(x: np.ndarray, means: list[int]) -> np.ndarray:
    """x less the rounded means, in whole numbers."""
    if largest(x) < 1 << 61:
        return x - np.asarray(means, dtype=np.int64)
    return x.astype(object) - np.asarray(means, dtype=object)


def products(z: np.ndarray) -> np.ndarray:
    """z'z in Python's whole numbers: by doubles where all sums stay below 2**53, which these hold exactly."""
    if largest(z) ** 2 * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = z.astype(object)
    return o.T @ o


def numbers(values: list[int]) -> dict[str, pa.Array]:
    return {"high": pa.array([Decimal(v >> SPLIT) for v in values], pa.decimal128(38, 0)), "low": pa.array([v & ((1 << SPLIT) - 1) for v in values], pa.int64())}


def added(parts: DataFrame, *keys: str) -> dict[tuple, int]:
    """Exact sums by key. The keys are places in vectors or matrices, so a bounded number of rows comes to the driver."""
    sums = parts.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {tuple(r[k] for k in keys): (int(r["high"]) << SPLIT) + int(r["low"]) for r in sums.collect()}


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues, by cyclic rotations."""
    a, d = np.array(a, dtype=np.float64), len(a)
    v, none = np.eye(d), EPS * EPS * d * max(float(np.trace(a)), 0.0)
    for _ in range(MOST_SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= max(EPS * math.sqrt(abs(a[p, p] * a[q, q])), none):
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1.0, half) / (abs(half) + math.hypot(half, 1.0))
                c = 1 / math.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q], :] = turn.T @ a[[p, q], :]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, v = values[order], v[:, order]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(d)]) if d else np.ones(0)
    return values, v * signs


def fitted(fit: DataFrame) -> dict[int, Fit]:
    """By length: sums, then the centred scatter, from the distinct vectors; then the rotations."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b, x in matrices(batches):
            d = x.shape[1]
            total[d] = total.get(d, 0) + np.concatenate([column_sums(x), np.asarray([b.num_rows], dtype=object)])
        for d, t in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * (d + 1), pa.int32()), "i": pa.array(range(d + 1), pa.int32()), **numbers(t.tolist())})

    first = added(fit.mapInArrow(tidy(sums), f"d int, i int, {NUMBER}"), "d", "i")
    lengths = sorted({d for d, _ in first})
    n, s = {d: first[d, d] for d in lengths}, {d: [first[d, i] for i in range(d)] for d in lengths}
    means = {d: [(2 * x + n[d]) // (2 * n[d]) for x in s[d]] for d in lengths}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, x in matrices(batches):
            d = x.shape[1]
            total[d] = total.get(d, 0) + products(centred(x, means[d]))
        for d, t in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), **numbers(t[i, j].tolist())})

    second = added(fit.mapInArrow(tidy(scatter), f"d int, i int, j int, {NUMBER}"), "d", "i", "j")
    out = {}
    for d in lengths:
        rest = [x - n[d] * m for x, m in zip(s[d], means[d], strict=True)]  # sums of the centred entries
        cov = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = (n[d] * second[d, i, j] - rest[i] * rest[j]) / (n[d] * n[d])
        values, v = jacobi(cov)
        trace = float(np.trace(cov))
        values = np.where(values > d * EPS * trace, values, 0.0)[:COMPONENTS]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[d] = Fit(n[d], s[d], means[d], np.asarray([r / n[d] for r in rest]), values, np.where(values > 0, v[:, :COMPONENTS] / np.sqrt(values), np.nan), trace)
    return out


def projected(x: np.ndarray, f: Fit) -> np.ndarray:
    return (centred(x, f.means).astype(np.float64) - f.lack) @ f.matrix


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length: how far the covariance of the whitened distinct vectors is from the identity at most."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, x in matrices(batches):
            f = fits[x.shape[1]]
            w = projected(x, f)[:, f.values > 0]
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total[x.shape[1]] = total.get(x.shape[1], 0) + w.T @ w
        for d, t in total.items():
            i, j = map(np.ravel, np.indices(t.shape))
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(t.ravel())})

    rows = fit.mapInArrow(tidy(moments), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d, f in fits.items():
        k = int((f.values > 0).sum())
        m = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["d"] == d:
                m[r["i"], r["j"]] = r["v"]
        mean = m[:k, k] / f.n
        out[d] = float(np.abs(m[:k, :k] / f.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Sums over the entries of (n x - S) squared. Longs wrap around, which leaves a result that fits in a long as it is; whether it fits is seen in doubles, and in Python's numbers near the limit."""
    about = (np.square(f.n * (centred(x, f.means).astype(np.float64) - f.lack))).sum(axis=1)
    wrap = np.asarray([s % (1 << 64) for s in f.sums], dtype=np.uint64)
    exact = np.square(np.uint64(f.n) * x.astype(np.uint64) - wrap).sum(axis=1, dtype=np.uint64)
    out: list[int | None] = [int(e) if a < 9e18 else None for e, a in zip(exact.tolist(), about.tolist(), strict=True)]
    for k in np.flatnonzero((about >= 9e18) & (about < 9.5e18)).tolist():
        whole = sum((f.n * int(v) - s) ** 2 for v, s in zip(x[k].tolist(), f.sums, strict=True))
        out[k] = whole if whole < 1 << 63 else None
    return out


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of a finite vector and each of its first components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    own = vectors(rows, id_col, vector_col)
    kind = rows.schema[id_col].dataType.simpleString()
    fit = Scratch(rows.sparkSession, "whitening").write(own.select("x").distinct(), "fit")
    fits = fitted(fit)
    errors = identity_errors(fit, fits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches):
            f, d = fits[x.shape[1]], x.shape[1]
            k, rows = len(f.values), b.num_rows
            w = projected(x, f).ravel()
            at = pa.array(np.repeat(np.arange(rows), k))
            explained = np.tile(f.values / f.trace if f.trace > 0 else np.full(k, np.nan), rows)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(at), "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), "n": pa.array([f.n] * (rows * k), pa.int64()),
                "deviation": pa.array(deviations(x, f), pa.int64()).take(at), "whitened": pa.array(w, mask=np.isnan(w)), "explained": pa.array(explained, mask=np.isnan(explained)), "identity_error": pa.array([errors[d]] * (rows * k)),
            })

    return own.mapInArrow(tidy(apply), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
