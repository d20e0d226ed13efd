"""Principal coordinates of sparse rows by a randomised range finder.

The driver holds features x (k + OVER) numbers, never features x features. A pass multiplies the covariance with such a block: a task forms each
row's products with the block and adds their outer products with the row, a grouping by feature adds what tasks have. After
POWER passes the block spans the leading directions, and one more pass gives its small Gram matrix, whose eigenvectors turn it into components. Absent values are zeros;
means are subtracted without filling anything in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

#: Columns besides the wanted ones, passes, seed of the first block.
OVER, POWER, SEED = 8, 6, 42


@dataclass(frozen=True)
class Axes:
    """Components (k x features, the largest loading of each positive), their variances, and the mean."""

    components: np.ndarray
    variances: np.ndarray
    mean: np.ndarray


def dense_rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, at, values) of arrays; nulls are zeros."""
    x = F.transform(vector, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    return rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.transform(x, lambda v, i: i).alias("at"), x.alias("values"))


def sparse_rows(long: DataFrame, key: str) -> DataFrame:
    """(key, at, values) of a long form (key, feature, value): a row's stored values, which are bounded by the features."""
    pairs = F.collect_list(F.struct(F.col("feature").cast("int").alias("f"), F.col("value").cast("double").alias("v"))).alias("p")
    return long.filter(F.col("value").isNotNull()).groupBy(F.col(key).alias("key")).agg(pairs).select("key", F.col("p.f").alias("at"), F.col("p.v").alias("values"))


def _block_rows(batch):
    """(row of each value, its feature, value) and the number of rows of an Arrow batch (at, values)."""
    at, values = batch.column(0), batch.column(1)
    sizes = np.asarray(at.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), np.asarray(at.flatten().to_numpy(), np.int64), np.asarray(values.flatten().to_numpy(), np.float64), len(sizes)


def products(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """Rows (n) times block (features x columns), from their stored values."""
    return np.stack([np.bincount(row, value * block[feature, j], n) for j in range(block.shape[1])], axis=1)


def covariance_times(rows: DataFrame, block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sum over rows of (x - mean)((x - mean)' block): one pass, one grouping by feature."""
    width, features = block.shape[1], len(mean)
    shift = mean @ block

    def run(batches):
        import pyarrow as pa

        total, own = None, None
        for b in batches:
            row, feature, value, n = _block_rows(b)
            y = products(row, feature, value, n, block) - shift
            got = np.stack([np.bincount(feature, value * y[row, j], features) for j in range(width)], axis=1)
            total, own = (got, y.sum(0)) if total is None else (total + got, own + y.sum(0))
        if total is not None:
            used = np.flatnonzero(total.any(axis=1))
            every = np.concatenate([total[used], own[None, :]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), boosting.lists(every)], names=["feature", "sums"])

    parts = rows.select("at", "values").mapInArrow(run, "feature int, sums array<double>").groupBy("feature").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
    out, own = np.zeros((features, width)), np.zeros(width)
    for r in parts.select("feature", vector_to_array("s").alias("s")).collect():  # a row per feature
        if r.feature < 0:
            own = np.array(r.s)
        else:
            out[r.feature] = r.s
    return out - np.outer(mean, own)


def fitted(rows: DataFrame, k: int = 2, features: int | None = None, power: int = POWER) -> Axes:
    """Axes of (key, at, values). `features` is one more than the greatest feature by default."""
    sums = rows.select(F.explode(F.arrays_zip("at", "values")).alias("p")).groupBy("p.at").agg(F.sum("p.values").alias("s")).collect()  # a row per feature
    n = rows.count()
    features = features or max((r.at for r in sums), default=-1) + 1
    mean = np.zeros(features)
    for r in sums:
        mean[r.at] = r.s / n
    width = min(features, k + OVER)
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(features, width)))[0] if features else np.zeros((0, 0))
    if features:
        for _ in range(power):
            block = np.linalg.qr(covariance_times(rows, block, mean))[0]
        gram = block.T @ covariance_times(rows, block, mean)
        size, turn = np.linalg.eigh((gram + gram.T) / 2)
        first = np.argsort(-size)[:k]
        axes, variances = (block @ turn[:, first]).T, np.maximum(size[first], 0) / max(1, n - 1)
        axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
        return Axes(axes, variances, mean)
    return Axes(np.zeros((k, 0)), np.zeros(k), mean)


def coordinates(rows: DataFrame, axes: Axes, key: str) -> DataFrame:
    """(key, pc1, pc2, ...) of every row."""
    block, names = axes.components.T.copy(), [f"pc{j + 1}" for j in range(len(axes.components))]
    shift = axes.mean @ block

    def run(batches):
        import pyarrow as pa

        for b in batches:
            row, feature, value, n = _block_rows(b.select(["at", "values"]))
            known = feature < len(block)
            y = products(row[known], feature[known], value[known], n, block) - shift
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(y[:, j]) for j in range(len(names))]], names=[key, *names])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "at", "values").mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} double" for n in names)]))
