"""Random projections: dense signs, sparse ternary, Gaussian; blocked products on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import free, matrix


def rademacher(dim: int, k: int = 64, seed: int = 1) -> np.ndarray:
    """k rows of +-1 / sqrt(k)."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (k, dim)) / np.sqrt(k)


def ternary(dim: int, k: int, seed: int = 1) -> np.ndarray:
    """+1 and -1 with a chance of 1/6 each, else 0; not scaled."""
    return np.random.default_rng(seed).choice([1.0, -1.0, 0.0], (k, dim), p=[1 / 6, 1 / 6, 2 / 3])


def gaussian(dim: int, k: int | None = None, eps: float = 0.1, n: int = 1000, seed: int = 1) -> np.ndarray:
    """Normal entries over sqrt(k); by default k is the smaller of the bound for ``n`` points and half of ``dim``."""
    k = k or max(1, min(int(4 * np.log(n) / (eps**2 / 2 - eps**3 / 3)), dim // 2))
    return np.random.default_rng(seed).normal(size=(k, dim)) / np.sqrt(k)


def sparse_signs(dim: int, k: int, sparsity: int = 3, seed: int = 1) -> np.ndarray:
    """Each input goes to ``sparsity`` outputs with a random sign, over sqrt(sparsity)."""
    rng = np.random.default_rng(seed)
    r = np.zeros((k, dim))
    for j in range(dim):
        at = rng.choice(k, min(sparsity, k), replace=False)
        r[at, j] = rng.choice([-1.0, 1.0], len(at)) / np.sqrt(len(at))
    return r


def formula_signs(dim: int, k: int) -> np.ndarray:
    """Signs from integers alone, so that any SQL engine can make the same: + where (31 i + 17 j + i j) mod 7 is even."""
    i, j = np.arange(k)[:, None], np.arange(dim)[None, :]
    return np.where((31 * i + 17 * j + i * j) % 7 % 2 == 0, 1.0, -1.0) / np.sqrt(k)


def project(df: DataFrame, vec: str, r: np.ndarray, name: str = "projected", normalize: bool = False, kind: str = "float") -> DataFrame:
    """Adds ``r`` times the vector, a matrix product a batch; other columns pass through, one of the same name is an error."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows have a column {name!r}")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch.column(vec)) @ r.T
            if normalize:
                n = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.where(n < 1e-8, y, y / np.maximum(n, 1e-30))
            flat = pa.array(y.ravel().astype(np.float32 if kind == "float" else np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col(vec).isNotNull()).mapInArrow(run, f"{kinds}, `{name}` array<{kind}>")


def projected(vec: Column, r: np.ndarray) -> Column:
    """The same as an expression, for few dimensions."""
    row = lambda w: sum((F.get(vec, F.lit(j)).cast("double") * float(x) for j, x in enumerate(w) if x), F.lit(0.0))
    return F.array(*(row(w) for w in r))


def standardize(df: DataFrame, vec: str, dim: int, name: str = "scaled") -> DataFrame:
    """(x - mean) / standard deviation, value by value; a constant one becomes 0. One aggregate, its row broadcast."""
    mean, spread = free(df, "__m"), free(df, "__s")
    value = lambda i: F.get(vec, F.lit(i)).cast("double")
    stats = df.agg(F.array(*(F.avg(value(i)) for i in range(dim))).alias(mean), F.array(*(F.stddev_pop(value(i)) for i in range(dim))).alias(spread))
    scaled = F.transform(vec, lambda x, i: F.when(F.get(spread, i) > 0, (x - F.get(mean, i)) / F.when(F.get(spread, i) > 0, F.get(spread, i))).otherwise(0.0).cast("float"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, scaled).drop(mean, spread)


def gaussian_scaled(df: DataFrame, vec: str, dim: int, k: int | None = None, name: str = "projected", seed: int = 1) -> DataFrame:
    """Standard-scaled vectors under a Gaussian projection."""
    scaled = free(df, "__scaled")
    return project(standardize(df, vec, dim, scaled), scaled, gaussian(dim, k, seed=seed), name).drop(scaled)
