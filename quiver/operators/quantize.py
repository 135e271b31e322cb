"""Product quantisation: plain, rotated (OPQ) and stacked (residual), with asymmetric distances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ivf import kmeans
from .knn import block_distances, matrix

SAMPLE = 20_000


@dataclass
class Quantizer:
    """books[layer][part]: centroids [k, width]; layers after the first code what the ones before leave."""

    books: list[list[np.ndarray]]
    rotation: np.ndarray | None = None

    @property
    def parts(self) -> int:
        return len(self.books[0])

    def _turn(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation.T

    def encode(self, x: np.ndarray) -> np.ndarray:
        rest, codes = self._turn(x), []
        for books in self.books:
            part = np.stack([block_distances(s, b, "l2").argmin(1) for s, b in zip(np.split(rest, self.parts, axis=1), books, strict=True)], axis=1)
            codes.append(part)
            rest = rest - np.concatenate([b[part[:, j]] for j, b in enumerate(books)], axis=1)
        return np.concatenate(codes, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        y = sum(np.concatenate([b[codes[:, i * self.parts + j]] for j, b in enumerate(books)], axis=1) for i, books in enumerate(self.books))
        return y if self.rotation is None else y @ self.rotation

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of the query's parts to each centroid (one layer)."""
        return np.stack([((b - s) ** 2).sum(1) for s, b in zip(np.split(self._turn(q[None, :])[0], self.parts), self.books[0], strict=True)])


def _sample(df: DataFrame, vec: str, key: str, seed: int) -> np.ndarray:
    got = df.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).select(F.col(vec).cast("array<float>").alias("v")).limit(SAMPLE).toArrow()
    return matrix(got.column("v").combine_chunks())


def train(df: DataFrame, vec: str = "embedding", key: str = "id", m: int = 8, k: int = 256, rounds: int = 10, layers: int = 1, rotate: bool = False, seed: int = 1) -> Quantizer:
    """On a sample of SAMPLE rows by hash. ``rotate``: axes of the sample's covariance first; ``layers`` above 1: codes of residuals."""
    x = _sample(df, vec, key, seed)
    if not len(x) or x.shape[1] % m:
        raise ValueError(f"{x.shape[1] if len(x) else 0} dimensions don't part into {m}")
    rotation = None
    if rotate:
        _, axes = np.linalg.eigh(np.cov(x.T))
        rotation = axes[:, ::-1].T
        x = x @ rotation.T
    books = []
    for layer in range(layers):
        books.append([kmeans(s, min(k, len(x)), seed=seed + layer, rounds=rounds) for s in np.split(x, m, axis=1)])
        codes = Quantizer([books[-1]]).encode(x)
        x = x - Quantizer([books[-1]]).decode(codes)
    return Quantizer(books, rotation)


def encode(df: DataFrame, quantizer: Quantizer, vec: str = "embedding", key: str = "id") -> DataFrame:
    """(id, codes)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = quantizer.encode(matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "codes"])

    return df.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec")).mapInArrow(run, "id long, codes array<int>")


def decode(df: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(id, vec) from (id, codes)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = quantizer.decode(matrix(batch.column("codes")).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(y.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "vec"])

    return df.mapInArrow(run, "id long, vec array<float>")


def adc(codes: DataFrame, quantizer: Quantizer, query: Sequence[float], k: int) -> DataFrame:
    """(id, distance): k nearest by table lookups, an expression over the codes; one layer only."""
    if len(quantizer.books) != 1:
        raise ValueError("lookups need a quantizer of one layer")
    t = quantizer.tables(np.asarray(query, dtype=np.float64))
    lut = [F.array(*(F.lit(float(x)) for x in row)) for row in t]
    d = sum((F.get(row, F.get("codes", F.lit(j))) for j, row in enumerate(lut)), F.lit(0.0))
    return codes.select("id", F.sqrt(d).alias("distance")).orderBy("distance", "id").limit(k)


def codes_out(codes: np.ndarray) -> list[str]:
    """Text form of codes: {1,2,3}."""
    return ["{" + ",".join(map(str, row)) + "}" for row in codes.tolist()]


def codes_in(texts: Sequence[str]) -> np.ndarray:
    """Codes from their text form; all of one length."""
    rows = []
    for t in texts:
        body = t.strip()
        if not (body.startswith("{") and body.endswith("}")):
            raise ValueError(f"codes must stand in braces: {t!r}")
        rows.append([int(x) for x in body[1:-1].split(",")])
    if len({len(r) for r in rows}) > 1:
        raise ValueError("codes of different lengths")
    return np.array(rows, dtype=np.int64)
