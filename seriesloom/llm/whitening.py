"""Whitening of embeddings: centred, turned to principal components and scaled to variance one.

Vectors are quantised to integers, so that equal ones can be told by value and sums are exact.
Statistics are those of the different vectors: a vector that fills a third of the table counts
once. Tasks add up integer sums and centred products for their rows, Spark adds those of all
tasks; what comes to the driver is one number per dimension and one per pair of dimensions,
whatever the rows. There the covariance is divided spectrally (:mod:`seriesloom.llm.qdwh`),
and the components, count x dimension numbers, go out to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.qdwh import EPS, leading_eigenvectors
from seriesloom.session import cut_lineage

SCALE, COMPONENTS = 256, 4
_ROWS = 2048
_HALF = 32  # integers are added as their upper and their lower 32 bits
LARGEST = 2**63 - 1


@dataclass
class Whitening:
    """What rows need to be whitened: counts and sums of the fitted vectors, components and eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    values: np.ndarray
    total: float
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: in 64 bits where they fit, in Python's integers elsewhere."""
        large = self.n * int(np.abs(x.astype(object)).max() if x.size and x.min() == -LARGEST - 1 else np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if large <= LARGEST else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def squares(self, deviations: np.ndarray) -> np.ndarray:
        """Sums of squares, at most the largest 64-bit number."""
        wide = float(np.abs(deviations).max(initial=0)) ** 2 * max(1, deviations.shape[1]) > LARGEST / 2
        found = (deviations.astype(object) if wide else deviations) ** 2
        return np.minimum(found.sum(1), LARGEST).astype(np.int64) if len(found) else np.zeros(0, np.int64)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """A column per component; NaN where the component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > self.rank_noise, 1 / np.sqrt(self.values), np.nan)
        return (deviations / self.n).astype(float) @ self.components * scale

    @property
    def rank_noise(self) -> float:
        return len(self.components) * EPS * max(self.values, default=0.0)

    @property
    def explained(self) -> np.ndarray:
        return np.where(self.values > self.rank_noise, self.values / self.total, 0.0) if self.total > 0 else np.full(len(self.values), np.nan)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: every whole and finite vector as integers; others are dropped."""
    entry = F.col("v").cast("array<double>")
    whole = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entry, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).filter(F.col("v").isNotNull() & whole).select("vec_id", x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for a in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(a, _ROWS)
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _cells(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def sums_of(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, rows = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for batch, x in _matrices(batches, 0, size):
            high, low, rows = high + (x >> _HALF).sum(0), low + (x & ((1 << _HALF) - 1)).sum(0), rows + len(x)
        if rows:
            yield _cells({"i": np.arange(size), "high": high, "low": low, "n": np.full(size, rows)})

    found = fit.select("x").mapInArrow(run, "i bigint, high bigint, low bigint, n bigint").groupBy("i").agg(F.sum("high"), F.sum("low"), F.sum("n")).collect()
    sums = {r[0]: (r[1] << _HALF) + r[2] for r in found}
    return (found[0][3] if found else 0), [sums[i] for i in sorted(sums)]


def covariance_of(fit: DataFrame, means: Whitening, size: int, whitened: bool = False) -> np.ndarray:
    """Centred products of the vectors, or of what they are whitened to, over their number."""
    width = len(means.values) if whitened else size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, rows = np.zeros((width, width)), np.zeros(width), 0
        for _, x in _matrices(batches, 0, size):
            centred = means.deviations(x)
            centred = means.whitened(centred) if whitened else (centred / means.n).astype(float)
            products, sums, rows = products + centred.T @ centred, sums + centred.sum(0), rows + len(x)
        if rows:
            i, j = np.triu_indices(width)
            yield _cells({"i": i, "j": j, "v": products[i, j]})

    found = fit.select("x").mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    out = np.zeros((width, width))
    for i, j, v in found:
        out[i, j] = out[j, i] = v / means.n
    return out


def fit_whitening(vectors: DataFrame, count: int = COMPONENTS) -> tuple[Whitening, int] | None:
    """Components of the different ``x`` of :func:`quantised`, and their length; none without a vector.

    All vectors must have one length; :func:`whiten` sees to that.
    """
    fit = cut_lineage(vectors.select("x").distinct())
    first = fit.select(F.size("x")).first()
    if first is None:
        return None
    size = first[0]
    n, sums = sums_of(fit, size)
    means = Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    covariance = covariance_of(fit, means, size)
    values, components = leading_eigenvectors(covariance, count)
    found = Whitening(n, sums, components, values, float(np.trace(covariance)))
    error = covariance_of(fit, found, size, whitened=True) - np.eye(len(values))
    kept = values > found.rank_noise
    found.identity_error = float(np.abs(error[np.ix_(kept, kept)]).max()) if kept.any() else None
    return found, size


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    A vector is the integers ``floor(scale * c)`` of its entries; null vectors, and those with a
    null or non-finite entry, are dropped. Where lengths differ, the length that most rows have
    counts (the longer one of a tie) and vectors of others are dropped too, as are empty ones.
    The statistics are those of the ``n`` different vectors: ``deviation`` is the sum of the
    squares of ``n * x - sums``, exact and at most 2**63 - 1. A component without variance
    (fewer different vectors than components, or all alike) has a null ``whitened`` and 0 of the
    variance, or null if there is none at all. Ids may be null or tied, rows may repeat; other
    columns are not read; without vectors there are no rows.
    """
    rows = quantised(vectors, vec_id, embedding, scale)
    kind = f"vec_id {rows.schema[0].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("length")).count().filter("length > 0").orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], kind)
    rows = rows.filter(F.size("x") == lengths["length"])
    fitted, size = fit_whitening(rows, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1, size):
            deviations, k = fitted.deviations(x), len(fitted.values)
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), fitted.n)),
                pa.array(fitted.squares(deviations)[rows], pa.int64()), pa.array(fitted.whitened(deviations).reshape(-1), from_pandas=True),
                pa.array(np.tile(fitted.explained, len(x)), from_pandas=True), pa.array([fitted.identity_error] * len(rows), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind)
