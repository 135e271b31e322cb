"""Exact nearest neighbours: one query, filtered, by range, re-ranked, and a join of many queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

QUERY_BYTES = 64 << 20
"""Query vectors that may be sent to the executors at once."""


def literal(v: Sequence[float] | Column | None) -> Column:
    if v is None:
        return F.lit(None).cast("array<float>")
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)).cast("float") for x in v))


def checked(metric: str, known: Sequence[str] = ()) -> str:
    """``metric`` if it is known, an error otherwise."""
    known = known or tuple(V.DISTANCES)
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}: one of {', '.join(known)}")
    return metric


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_distance(df: DataFrame, vec: str, query, metric: str = "l2", name: str = "distance", dim: int | None = None) -> DataFrame:
    """Adds the distance; a column of that name is an error, not overwritten."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows have a column {name!r}")
    if checked(metric) == "cosine" and query is not None and not isinstance(query, Column):
        known = F.lit(float(sum(float(np.float32(x)) ** 2 for x in query)))
        return df.withColumn(name, V.cosine_distance(F.col(vec), literal(query), dim, norm2_b=known))
    return df.withColumn(name, V.DISTANCES[metric](F.col(vec), literal(query), dim))


def knn(df: DataFrame, vec: str, query, k: int, metric: str = "l2", key: str = "id", where: Column | None = None, dim: int | None = None, name: str = "distance") -> DataFrame:
    """The k nearest rows, filter first, ties by ``key``, null distances last; a partial top-k in every partition."""
    if where is not None:
        df = df.where(where)
    return with_distance(df, vec, query, metric, name, dim).orderBy(F.col(name).asc_nulls_last(), key).limit(k)


def knn_of_row(df: DataFrame, vec: str, key: str, row, k: int, metric: str = "l2", dim: int | None = None) -> DataFrame:
    """Neighbours of a stored row, itself excluded. The row is a broadcast of one."""
    q = free(df, "__q")
    one = df.where(F.col(key) == F.lit(row)).select(F.col(vec).alias(q)).limit(1)
    return knn(df.where(F.col(key) != F.lit(row)).crossJoin(F.broadcast(one)), vec, F.col(q), k, metric, key, dim=dim).drop(q)


def within(df: DataFrame, vec: str, query, radius: float, metric: str = "l2", dim: int | None = None) -> DataFrame:
    return with_distance(df, vec, query, metric, dim=dim).where(F.col("distance") < radius)


def rerank(df: DataFrame, coarse: Column, vec: str, query, candidates: int, k: int, metric: str = "l2", key: str = "id", dim: int | None = None) -> DataFrame:
    """The ``candidates`` nearest by a cheap distance, then the k nearest of them by the exact one."""
    name = free(df, "__coarse")
    near = df.withColumn(name, coarse).orderBy(F.col(name).asc_nulls_last(), key).limit(candidates)
    return knn(near, vec, query, k, metric, key, dim=dim).drop(name)


def with_ties(df: DataFrame, vec: str, query, k: int, metric: str = "l2", dim: int | None = None, digits: int | None = None) -> DataFrame:
    """All rows no farther than the k-th nearest."""
    d = with_distance(df, vec, query, metric, dim=dim)
    if digits is not None:
        d = d.withColumn("distance", F.round("distance", digits))
    edge = d.where(F.col("distance").isNotNull()).orderBy("distance").limit(k).agg(F.max("distance").alias("__edge"))
    return d.crossJoin(F.broadcast(edge)).where(F.col("distance") <= F.col("__edge")).drop("__edge")


def block_distances(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """[query, base]: ordering distances by one matrix product (L1 by differences)."""
    if checked(metric) == "l1":
        return np.stack([np.abs(base - q).sum(axis=1) for q in queries])
    dot = queries @ base.T
    if metric == "ip":
        return -dot
    if metric == "l2":
        return np.maximum(0, (queries**2).sum(1)[:, None] + (base**2).sum(1)[None, :] - 2 * dot)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip(dot / np.sqrt((queries**2).sum(1)[:, None] * (base**2).sum(1)[None, :]), -1, 1)


def nearest(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest rows of ``base``, ties by id.

    A matrix product gives distances within a bound of rounding; every row that
    may be among the k by those bounds gets its exact distance, so neither ties
    nor cancellation lose a neighbour. For L2 a common offset goes first.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(queries) or not len(base):
        return none, none, np.zeros(0)
    q, x = queries, base
    if metric == "l2":
        offset = queries.mean(axis=0)
        q, x = queries - offset, base - offset
    d = block_distances(q, x, metric)
    unit = 4 * (base.shape[1] + 4) * np.finfo(np.float64).eps
    if metric == "cosine":
        error = np.full_like(d, unit)
    elif metric == "l1":
        error = unit * d
    else:
        nq, nx = (q**2).sum(1)[:, None], (x**2).sum(1)[None, :]
        error = unit * (nq + nx if metric == "l2" else np.sqrt(nq * nx))
    d, error = np.where(np.isnan(d), np.inf, d), np.where(np.isfinite(error), error, np.inf)
    low = np.where(np.isinf(error), -np.inf, d - error)
    m = min(k, len(base))
    edge = np.partition(d + error, m - 1, axis=1)[:, m - 1]
    owner, row = np.nonzero(low <= edge[:, None])
    exact = exact_distance(queries[owner], base[row], metric)
    return top(owner, ids[row], exact, k)


def top(owner: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest (distance, id) of each owner; NaN last."""
    order = np.lexsort((ids, distance, owner))
    owner, ids, distance = owner[order], ids[order], distance[order]
    first = np.searchsorted(owner, owner)
    kept = np.arange(len(owner)) - first < k
    return owner[kept], ids[kept], distance[kept]


def exact_distance(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=-1))
    if metric == "l1":
        return np.abs(x - q).sum(axis=-1)
    if metric == "ip":
        return -(x * q).sum(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip((x * q).sum(axis=-1) / np.sqrt((x * x).sum(axis=-1) * (q * q).sum(axis=-1)), -1, 1)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, in doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


_found = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def merged(best: tuple, new: tuple, k: int) -> tuple:
    return top(*(np.concatenate(x) for x in zip(best, new, strict=True)), k) if len(new[0]) else best


NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
ROWS = 1024
"""Rows in a packed block of queries or base vectors."""


def _top(qids: np.ndarray, qs: np.ndarray, k: int, metric: str):
    def run(batches):
        best = NONE
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), matrix(batch.column("vec"))
            for a in range(0, len(qs), 256):
                for b in range(0, len(x), 4 * ROWS):
                    owner, i, d = nearest(qs[a : a + 256], x[b : b + 4 * ROWS], ids[b : b + 4 * ROWS], k, metric)
                    best = merged(best, (owner + a, i, d), k)
        yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[1]), pa.array(best[2])], schema=_found)

    return run


def _packed(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows (ids, vectors) of ROWS vectors each, as bytes."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "vecs"])

    return df.select(key, vec).mapInArrow(run, "ids binary, vecs binary")


def _top_of_pairs(k: int, metric: str):
    """Of (query block, base block) rows, the k nearest a query of each partition."""

    def run(batches):
        best: dict[bytes, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                (qids, qs), (ids, x) = ((np.frombuffer(row[i], dtype=np.int64), np.frombuffer(row[v], dtype=np.float64)) for i, v in (("qids", "qvecs"), ("ids", "vecs")))
                new = nearest(qs.reshape(len(qids), -1), x.reshape(len(ids), -1), ids, k, metric)
                best[row["qids"]] = merged(best.get(row["qids"], NONE), new, k)
        for key, (owner, ids, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, dtype=np.int64)[owner]), pa.array(ids), pa.array(d)], schema=_found)

    return run


def knn_join(base: DataFrame, queries: DataFrame, vec: str, key: str, k: int, metric: str = "l2", qvec: str | None = None, qkey: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank): the k nearest rows of ``base`` for each query, exact, ties by id.

    Queries of QUERY_BYTES at most are sent to the executors; each partition of
    ``base`` keeps k a query, by matrix products and an exact check of all rows
    that rounding leaves open. More queries are packed into blocks and paired
    with packed blocks of ``base`` there, without passing through the driver.
    Null vectors don't take part.
    """
    checked(metric)
    qvec, qkey = qvec or vec, qkey or key
    want = k + 1 if exclude_self else k
    rows = base.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    asked = queries.where(F.col(qvec).isNotNull()).select(F.col(qkey).cast("long").alias("qid"), F.col(qvec).alias("q"))
    n, width = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    if n * (width or 1) * 8 <= QUERY_BYTES:
        mine = asked.orderBy("qid").toArrow()
        qs = matrix(mine.column("q").combine_chunks())
        out = rows.mapInArrow(_top(mine.column("qid").to_numpy(), qs, want, metric), "qid long, id long, distance double")
    else:
        blocks = _packed(asked, "qid", "q").select(F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
        out = blocks.crossJoin(_packed(rows, "id", "vec")).mapInArrow(_top_of_pairs(want, metric), "qid long, id long, distance double")
    if exclude_self:
        out = out.where(F.col("qid") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, the mean share of the k true neighbours of a query that ``found`` has. Both (qid, id)."""
    both = truth.select("qid", "id").join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return both.groupBy("qid").agg((F.count("hit") / F.lit(k)).alias("r")).agg(F.avg("r").alias("recall"))


def fuse_ranks(a: DataFrame, b: DataFrame, key: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (key, rank): sum of 1 / (constant + rank)."""
    one = lambda df, n: df.select(key, F.col("rank").alias(n))
    both = one(a, "__a").join(one(b, "__b"), key, "full_outer")
    part = lambda n: F.coalesce(1.0 / (F.lit(float(constant)) + F.col(n)), F.lit(0.0))
    return both.select(key, (part("__a") + part("__b")).alias("score"))


def text_rank(df: DataFrame, text: str, key: str, terms: Sequence[str], k1: float = 1.2) -> DataFrame:
    """(key, score) of rows with a term: sum of idf * tf * (k1 + 1) / (tf + k1) over ``terms``, rounded to six places.

    Words are runs of a-z of the lower-cased text. One pass counts the terms,
    one aggregate of a row a term gives their frequencies.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    held = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    counts = df.select(key, words.alias("w")).select(key, *(held(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    seen = counts.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    parts = [F.when(F.col(f"tf{i}") > 0, F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1)).otherwise(0.0) for i in range(len(terms))]
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
    total = sum(parts[1:], parts[0])
    return counts.where(hit).crossJoin(F.broadcast(seen)).select(key, F.round(total, 6).alias("score"))
