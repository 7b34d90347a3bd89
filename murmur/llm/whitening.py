"""Whitening of vectors: eigenvectors found by rank-one updates, refined over all vectors.

Entries become whole numbers ``floor(256 * c)``; the model is fitted on each distinct vector once.

1. Every partition keeps a spectrum (number, mean, eigenvalues, eigenvectors of its scatter). Rows
   are taken in blocks, centred by the block's mean; a block is first turned into at most as many
   rows as there are dimensions with the same scatter (QR). Each of these rows, and the shift
   between block mean and running mean, is one rank-one update: entries that change nothing are
   deflated, the secular equation gives the eigenvalues, its solutions the eigenvectors.
2. Spectra are combined eight at a time over the cluster, again by successive rank-one updates.
3. A pass over all fitted vectors forms the covariance in that basis (Rayleigh-Ritz), whose small
   eigenproblem gives components to double precision.

What a task or the driver holds grows with the square of the dimension, never with the rows.

Rows whose vector is null or holds null or non-finite entries, or entries that exceed a long
when scaled, are dropped; shorter vectors are taken with zeros up to the longest. Components of no
variance (fewer distinct vectors than components) are left out, so a single vector or an empty
table gives no rows. Repeated rows and ids keep their rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import materialize

SCALE = 256.0
FAN = 8  # spectra that one task combines
BLOCK_ROWS = 16  # rows of a block for each dimension
EPS = np.finfo(np.float64).eps
MOST = 2.0**63
SPECTRUM = "part long, n double, mean array<double>, values array<double>, vectors array<double>"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    c = F.col("embedding")
    scaled = F.transform(c, lambda v: v.cast("double") * SCALE)
    good = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST))
    return vectors.where(c.isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda v: F.floor(v)).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of whole numbers, zeros after the end of shorter ones."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


# --- rank-one updates -----------------------------------------------------------------

def _secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum z_j^2 / (d_j - x)`` as (nearest pole, distance to it); d rises strictly.

    Root i lies between d_i and the next pole (the last below d_k + |z|^2). Distances are kept
    from the nearer pole, so that differences to poles keep their relative precision.
    """
    k = len(d)
    z2 = z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    at = np.arange(k)
    middle = 1 + (z2 / (d - (d + gap / 2)[:, None])).sum(1)
    right = (middle < 0) & (at < k - 1)
    pole = np.where(right, at + 1, at)
    delta = d - d[pole][:, None]  # poles as seen from each root's own pole
    lo = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    nxt = np.minimum(at + 1, k - 1)
    left, rest = delta[at, at], np.where(at < k - 1, delta[at, nxt], gap + z2.sum())
    mu = (lo + hi) / 2
    below = np.tril(np.ones((k, k), bool))
    for _ in range(100):
        with np.errstate(all="ignore"):
            q = z2 / (delta - mu[:, None])
            f = 1 + q.sum(1)
            lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
            # the two sums of poles as one pole each, with the same value and slope
            slope = q / (delta - mu[:, None])
            a, b = left - mu, rest - mu
            s, t = a * a * (slope * below).sum(1), b * b * (slope * ~below).sum(1)
            c = f - s / a - t / b
            p, r = c * (a + b) + s + t, c * a * b + s * b + t * a
            root = np.sqrt(np.maximum(p * p - 4 * c * r, 0))
            step = np.where(p > 0, 2 * r / (p + root), (p - root) / (2 * c))
            guess = mu + step
            inside = (guess > lo) & (guess < hi)
        new = np.where(inside, guess, (lo + hi) / 2)
        # as near as the sum's own rounding tells, or no number left between the bounds
        done = (np.abs(f) <= EPS * (1 + np.abs(q).sum(1))) | (np.abs(new - mu) <= 2 * EPS * np.abs(new)) | (
            hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        mu = np.where(done, mu, new)
        if done.all():
            break
    return pole, mu


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors' + row row'``; values rise."""
    z = vectors.T @ row
    scale = max(np.abs(values).max(initial=0.0), float(z @ z))
    if scale == 0:
        return values, vectors
    values, vectors, tiny = values.copy(), vectors.copy(), 8 * EPS * scale
    # deflation: equal values are turned until one of them carries the whole entry
    active: list[int] = []
    for j in np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > tiny):
        if active and values[j] - values[active[-1]] <= tiny:
            i = active.pop()
            r = np.hypot(z[i], z[j])
            turn = np.array([[z[j] / r, z[i] / r], [-z[i] / r, z[j] / r]])
            vectors[:, [i, j]] = vectors[:, [i, j]] @ turn
            z[i], z[j] = 0.0, r
        active.append(int(j))
    if active:
        act = np.array(active)
        d = values[act]
        pole, mu = _secular(d, z[act])
        # entries for which these roots are exact, so that the vectors come out orthogonal
        minus = (d[pole] - d[:, None]) + mu  # root j less pole i
        over = d[None, :] - d[:, None]
        np.fill_diagonal(over, 1.0)
        exact = np.sqrt(np.abs(np.prod(minus / over, axis=1))) * np.sign(z[act])
        u = exact[:, None] / -minus
        u /= np.sqrt((u * u).sum(0))
        values[act] = d[pole] + mu
        vectors[:, act] = vectors[:, act] @ u
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values, vectors


@dataclass
class Spectrum:
    """Number, mean and eigen-decomposed scatter of some vectors."""

    n: float
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0.0, np.zeros(size), np.zeros(size), np.eye(size))

    def update(self, n: float, mean: np.ndarray, rows: np.ndarray) -> None:
        """Take in ``n`` vectors of this mean whose scatter about it is ``rows' rows``."""
        shift = mean - self.mean
        total = self.n + n
        for row in [*rows, shift * np.sqrt(self.n * n / total)]:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        self.mean = self.mean + shift * (n / total)
        self.n = total

    def add(self, block: np.ndarray) -> None:
        mean = block.mean(0)
        rows = block - mean
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        self.update(len(block), mean, rows)

    def merge(self, other: Spectrum) -> None:
        rows = np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T
        self.update(other.n, other.mean, rows)

    def record(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean, "values": self.values,
                "vectors": self.vectors.ravel()}


def _spectra(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, step = Spectrum.empty(size), BLOCK_ROWS * size
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                own.add(_matrix(batch.column("x").slice(at, step), size).astype(np.float64))
        if own.n:
            record = own.record(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_pylist(
                [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in record.items()}])
    return run


def _combine(size: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        out = None
        for r in rows.itertuples():
            other = Spectrum(r.n, np.array(r.mean), np.array(r.values),
                             np.array(r.vectors).reshape(size, size))
            if out is None:
                out = other
            else:
                out.merge(other)
        return pd.DataFrame([out.record(int(rows["part"].iloc[0]) // FAN)])
    return run


def combined(spectra: DataFrame, size: int) -> Spectrum:
    """One spectrum of all parts, ``FAN`` at a time."""
    spectra = materialize(spectra, "spectra")
    while True:
        most = spectra.agg(F.max("part")).first()[0]
        if most == 0 or spectra.count() == 1:
            break
        grouped = spectra.withColumn("g", F.floor(F.col("part") / FAN)).groupBy("g")
        spectra = materialize(grouped.applyInPandas(
            lambda pdf: _combine(size)(pdf), SPECTRUM), "spectra")
    r = spectra.first()
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["values"]),
                    np.array(r["vectors"]).reshape(size, size))


# --- model ----------------------------------------------------------------------------

@dataclass
class Model:
    """``components`` has a unit eigenvector in each column, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: in longs where they surely hold it, else in Python's numbers."""
        most = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def _products(model: Model, basis: np.ndarray, scale: np.ndarray) -> Callable:
    """Sums of products of the centred vectors' coordinates in ``basis``, over one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            y = model.centred(_matrix(batch.column("x"), model.size)) @ basis / scale
            out += y.T @ y
        i, j = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, out)], ["i", "j", "s"])
    return run


def _covariance(fitted: DataFrame, model: Model, basis: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Covariance of the fitted vectors in ``basis``; its size is that of the basis."""
    sums = (fitted.select("x").mapInArrow(_products(model, basis, scale), "i long, j long, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())
    out = np.zeros((basis.shape[1],) * 2)
    out[sums["i"], sums["j"]] = sums["s"]
    return (out + out.T) / (2 * model.n)


def _sums(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, object), 0
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            safe = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0**62
            total += x.sum(0) if safe else x.astype(object).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size + 1), pa.int64()),
             pa.array([*map(Decimal, total.tolist()), Decimal(n)], pa.decimal128(38, 0))], ["i", "s"])
    return run


def fit(rows: DataFrame, components: int = 4) -> Model | None:
    """Model of ``whole_numbers``; None if nothing varies."""
    fitted = materialize(rows.select("x").distinct(), "distinct")
    size = fitted.agg(F.max(F.size("x"))).first()[0] or 0
    if not size:
        return None
    found = dict(fitted.mapInArrow(_sums(size), "i long, s decimal(38,0)").groupBy("i").agg(
        F.sum("s").cast("string")).collect())
    sums = [int(found[i]) for i in range(size)]
    model = Model(int(found[size]), sums, np.zeros(0), np.zeros((size, 0)), 0.0, 0.0)
    spectrum = combined(fitted.mapInArrow(_spectra(size), SPECTRUM), size)
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]  # updates leave it orthogonal up to rounding
    inner = _covariance(fitted, model, basis, np.ones(size))
    values, turn = np.linalg.eigh(inner)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    model.trace = float(np.trace(inner))
    keep = values > 64 * EPS * size * max(model.trace, 0.0)
    if not keep.any():
        return None
    model.values = values[keep]
    vectors = basis @ turn[:, keep]
    model.components = vectors / np.sqrt((vectors * vectors).sum(0))
    white = _covariance(fitted, model, model.components, np.sqrt(model.values))
    model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """A row for every vector and component; ``deviation`` is null beyond 38 digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = _matrix(batch.column("x"), model.size)
            away = model.deviations(x)
            if float(np.abs(away.astype(np.float64)).max(initial=0)) ** 2 * model.size >= 2.0**62:
                away = away.astype(object)
            square = [v if v < 10**38 else None for v in map(int, (away * away).sum(1))]
            deviation = pa.array([None if v is None else Decimal(v) for v in square], pa.decimal128(38, 0))
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 deviation.take(pa.array(at)), pa.array(model.whiten(x).ravel()),
                 pa.array(np.tile(model.values / model.trace, len(x)))],
                ["vec_id", "component", "deviation", "whitened", "explained"])

    out = rows.mapInArrow(run, "vec_id long, component int, deviation decimal(38,0), whitened double, "
                               "explained double")
    return out.withColumn("n", F.lit(model.n).cast("long")).withColumn(
        "identity_error", F.lit(model.identity_error))


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    rows = whole_numbers(vectors)
    model = fit(rows, components)
    if model is None:  # nothing varies: no component, so no row
        model = Model(1, [0], np.zeros(0), np.zeros((1, 0)), 1.0, 0.0)
        rows = rows.where(F.lit(False))
    return transform(rows, model)
