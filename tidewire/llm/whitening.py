"""Operator 11: embedding whitening by Welford's rank-one updates, parallel merges and a symmetric QR eigen-solve.

A component c becomes the integer x = floor(1024 c) + 100000. Every task streams its rows past a count, a mean and a matrix of
centred products, each row a rank-one update, and emits one row; these rows are merged ``FAN`` at a time by the parallel
update formula until one is left, so the driver sees one matrix however many partitions there are. The covariance is brought to
tridiagonal form by reflections and then to its eigenvalues by implicit QR steps. Rows are projected in a second pass and
written; the covariance of what was written, gathered the same way, tells the error. Sums of x are exact at any size (decimals
between tasks, Python's integers in them), and so are the deviations.

Defined cases: a vector that is null, or has a null or non-finite component, is dropped; a null vec_id is kept; vectors shorter
than the longest count as padded with zeros (an empty one is all zeros); x is clipped to +-2**45 and a deviation to a long;
repeated rows count as often as they come; eigenvectors of equal eigenvalues are any basis of their space, the same for all rows; a
component without variance (rank-deficient data, one row, equal rows) has whitened 0, explained 0, and no part in identity_error;
there are no more components than dimensions; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE, SHIFT = 1024, 100_000
CLIP = float(1 << 45)
COMPONENTS = 8
#: Partial moments that one task merges.
FAN = 16
MOMENTS = "n long, total array<decimal(38,0)>, mean array<double>, products array<double>"
#: A component's eigenvalue counts as 0 below this part of the largest one.
RANK = 1e-12


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each component; null unless all are finite."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(fine, F.transform(doubles, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-CLIP)), F.lit(CLIP))) + shift))


def matrix(column: pa.Array, width: int, pad: float) -> np.ndarray:
    """The lists of a column as rows, padded to ``width`` or the longest of them."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), pad, flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Moments:
    """Count, exact sum, mean and centred products of rows seen so far. Dimensions not met yet hold ``pad`` in all rows."""

    def __init__(self, pad: int = 0):
        self.pad, self.n = pad, 0
        self.total, self.mean, self.products = np.zeros(0, object), np.zeros(0), np.zeros((0, 0))

    def widen(self, width: int) -> None:
        more = width - len(self.mean)
        if more > 0:
            self.total = np.concatenate([self.total, np.full(more, self.n * self.pad, object)])
            self.mean = np.concatenate([self.mean, np.full(more, float(self.pad if self.n else 0))])
            self.products = np.pad(self.products, (0, more))

    def add(self, rows: np.ndarray) -> None:
        """Welford: one rank-one update a row."""
        self.widen(rows.shape[1])
        if rows.dtype.kind == "i":
            self.total = self.total + rows.sum(axis=0).astype(object)
        mean, products = self.mean, self.products
        for row in rows.astype(float):
            self.n += 1
            before = row - mean
            mean += before / self.n
            products += np.outer(before, row - mean)

    def merge(self, n: int, total: np.ndarray, mean: np.ndarray, products: np.ndarray) -> None:
        """The parallel update: moments of both sets of rows."""
        if n == 0:
            return
        other = Moments(self.pad)
        other.n, other.total, other.mean, other.products = n, total, mean, products
        self.widen(len(mean))
        other.widen(len(self.mean))
        both = self.n + n
        apart = other.mean - self.mean
        self.products = self.products + other.products + np.outer(apart, apart) * (self.n * (n / both))
        self.mean = self.mean + apart * (n / both)
        self.total, self.n = self.total + other.total, both

    def row(self) -> list:
        return [self.n, [Decimal(int(t)) for t in self.total], self.mean.tolist(), self.products.ravel().tolist()]


def unpacked(r) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    mean = np.array(r["mean"], float)
    return int(r["n"]), np.array([int(t) for t in r["total"]], object), mean, np.array(r["products"], float).reshape(len(mean), len(mean))


def moments(rows: DataFrame, scratch: Scratch, pad: int = 0) -> Moments:
    """Moments of the only column, an array of longs or doubles without nulls."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments(pad)
        for b in batches:
            if b.num_rows:
                held.add(matrix(b.column(0), len(held.mean), pad))
        if held.n:
            types = [pa.int64(), pa.list_(pa.decimal128(38)), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held.row(), types, strict=True)], names=["n", "total", "mean", "products"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        held = Moments(pad)
        for r in group.sort_values("part").to_dict("records"):
            held.merge(*unpacked(r))
        return pd.DataFrame([held.row()], columns=["n", "total", "mean", "products"])

    parts = rows.mapInArrow(gather, MOMENTS)
    while True:
        saved, path = scratch.save(parts.withColumn("part", F.spark_partition_id().cast("long")))
        count = saved.count()
        if count <= 1:
            break
        groups = -(-count // FAN)
        parts = saved.groupBy(F.pmod("part", F.lit(groups)).alias("group")).applyInPandas(merged, MOMENTS)
    held = Moments(pad)
    for r in saved.collect():  # one row at most
        held.merge(*unpacked(r))
    scratch.drop(scratch.base)
    return held


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the rows of Q, where Q a Q^T is tridiagonal: one reflection a column."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows: implicit QR steps with Wilkinson's shift."""
    scale = np.abs(a).max(initial=0.0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / scale)
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and not small[lo - 1]:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        x, z = d[lo] - d[hi] + e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half)), e[lo]
        for k in range(lo, hi):  # chase the bulge down
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            first, last, off = d[k], d[k + 1], e[k]
            d[k] = c * c * first - 2 * c * s * off + s * s * last
            d[k + 1] = s * s * first + 2 * c * s * off + c * c * last
            e[k] = c * s * (first - last) + (c * c - s * s) * off
            if k < hi - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = c * q[k] - s * q[k + 1], s * q[k] + c * q[k + 1]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, q[order]


class Whitening(NamedTuple):
    """A fit: exact sums, eigenvectors (rows) and eigenvalues of the first components, and the covariance's trace."""

    n: int
    total: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > RANK * self.values.max(initial=0.0)


def fit(held: Moments, components: int = COMPONENTS) -> Whitening:
    covariance = (held.products + held.products.T) / (2 * max(held.n, 1))
    values, vectors = eigen(covariance)
    return Whitening(held.n, held.total, vectors[:components], values[:components], float(np.trace(covariance)))


def project(model: Whitening, x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Each row's deviation, exact, and its whitened components."""
    most = max(max((abs(int(t)) for t in model.total), default=0), 1) + model.n * int(np.abs(x).max(initial=0))
    whole = most * most * max(1, x.shape[1]) < 2**62
    apart = x * model.n - model.total.astype(np.int64) if whole else x.astype(object) * model.n - model.total
    deviation = (apart * apart).sum(axis=1)
    live = model.live
    out = np.zeros((len(x), len(model.values)))
    out[:, live] = (apart.astype(float) / model.n) @ model.vectors[live].T / np.sqrt(model.values[live])
    return [min(int(v), 2**63 - 1) for v in deviation], out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening, float]:
    """A table of vec_id, deviation and whitened (array), the fit, and identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), integers(vectors[vector_col], scale, shift).alias("x")).where("x is not null")
    model = fit(moments(rows.select("x"), Scratch(spark, "moments"), shift), components)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            deviation, out = project(model, matrix(b.column(1), len(model.total), shift))
            listed = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), listed], names=["vec_id", "deviation", "whitened"])

    done, _ = Scratch(spark, "whitened").save(rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>"))
    told = moments(done.select("whitened"), Scratch(spark, "moments"))
    live = np.flatnonzero(model.live)
    error = np.abs((told.products / max(told.n, 1))[np.ix_(live, live)] - np.eye(len(live))).max(initial=0.0) if told.n else 0.0
    return done, model, float(error)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, model, error = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(v / model.trace) if live else 0.0) for v, live in zip(model.values, model.live, strict=True)] or [F.lit(0.0)])
    rows = done.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "pos").alias("explained"), F.lit(error).alias("identity_error"))
