"""Inverted-list index: sampled k-means, lists as table partitions, probes, iterative scans, inserts and vacuum."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import projection as P
from .knn import NONE, QUERY_BYTES, block_distances, checked, literal, matrix, nearest, top

MAX_LISTS = 32768
MAX_DIM = {"vector": 2000, "halfvec": 4000, "bit": 64000}
MAX_PROBES = 32768


def kmeans(x: np.ndarray, k: int, spherical: bool = False, bits: bool = False, seed: int = 1, rounds: int = 500) -> np.ndarray:
    """k-means++ seeds, then Lloyd rounds until nothing moves. Centres without points become random; spherical ones keep length 1; bit centres are majorities."""
    rng = np.random.default_rng(seed)
    if not len(x):
        c = rng.random((k, x.shape[1] if x.ndim == 2 else 1))
        return c / np.linalg.norm(c, axis=1, keepdims=True) if spherical else c
    first = [x[rng.integers(len(x))]]
    near = ((x - first[0]) ** 2).sum(1)
    while len(first) < k:
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        first.append(x[pick])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    c = np.array(first, dtype=np.float64)
    owner = None
    for _ in range(rounds):
        new = np.concatenate([block_distances(x[a : a + 4096], c, "ip" if spherical else "l2").argmin(1) for a in range(0, len(x), 4096)])
        if owner is not None and np.array_equal(new, owner):
            break
        owner = new
        n = np.bincount(owner, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(owner, x[:, j], k)
        c /= np.maximum(n, 1)[:, None]
        if bits:
            c = (c > 0.5).astype(np.float64)
        empty = n == 0
        c[empty] = rng.random((int(empty.sum()), x.shape[1]))
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
    return c


def _assign(centers: np.ndarray, metric: str, read):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = block_distances(read(batch.column("vec")), centers, metric).argmin(1)  # the lowest list wins ties
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list_id"])

    return run


def bit_matrix(column: pa.Array) -> np.ndarray:
    """A column of bit strings of one length, as 0.0 and 1.0."""
    data = b"".join(x.encode() for x in column.to_pylist())
    return (np.frombuffer(data, dtype=np.uint8) - 48.0).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


METRICS = ("l2", "ip", "cosine", "l1", "hamming")


@dataclass
class IvfIndex:
    """Lists of a table. Folders under ``path``: meta-<n>, one row that says what the index is, and lists-<n>, its rows by list and load.

    The largest complete meta folder counts, so a rewrite takes effect as one
    step, by the folder that it writes last; ``open_index`` finds it again in
    any session.
    """

    spark: SparkSession
    path: str
    metric: str
    centers: np.ndarray
    dim: int
    projection: np.ndarray | None = None
    notices: list[str] = field(default_factory=list)
    version: int = 0

    @property
    def lists(self) -> int:
        return len(self.centers)

    @property
    def _kind(self) -> str:
        return "string" if self.metric == "hamming" else "array<float>"

    def _space(self) -> str:
        return "ip" if self.metric in ("ip", "cosine") else "l1" if self.metric == "l1" else "l2"

    def _prepared(self, df: DataFrame, vec: str, key: str) -> DataFrame:
        rows = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast(self._kind).alias("vec"))
        if self.metric == "cosine":
            rows = rows.where(V.vector_norm(F.col("vec")) > 0).withColumn("vec", V.l2_normalize(F.col("vec")))
        return rows

    def assigned(self, df: DataFrame, vec: str, key: str) -> DataFrame:
        r, bits = self.projection, self.metric == "hamming"

        def read(column: pa.Array) -> np.ndarray:
            x = bit_matrix(column) if bits else matrix(column)
            return x if r is None else x @ r.T

        return self._prepared(df, vec, key).mapInArrow(_assign(self.centers, self._space(), read), f"id long, vec {self._kind}, list_id int")

    def insert(self, df: DataFrame, vec: str = "embedding", key: str = "id", load: str = "0", mode: str = "append") -> None:
        """Adds rows to the lists of their nearest centres; centres stay.

        ``load`` names the rows' folders in their lists. With mode
        "overwrite" what an earlier try of this load wrote goes, so a load can
        be repeated. Large lists are written by several tasks.
        """
        rows = self.assigned(df, vec, key).withColumn("load", F.lit(load))
        write = rows.hint("rebalance", "list_id").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        write.partitionBy("list_id", "load").parquet(self._lists(self.version))

    def _lists(self, version: int) -> str:
        return f"{self.path}/lists-{version}"

    def _commit(self, version: int) -> None:
        """From now on ``version`` counts."""
        shape = lambda x: [0, 0] if x is None else list(x.shape)
        raw = lambda x: b"" if x is None else np.ascontiguousarray(x, dtype="<f8").tobytes()
        row = (self.metric, self.dim, shape(self.centers), bytearray(raw(self.centers)), shape(self.projection), bytearray(raw(self.projection)))
        kinds = "metric string, dim int, shape array<int>, centers binary, r_shape array<int>, projection binary"
        self.spark.createDataFrame([row], kinds).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta-{version}")
        self.version = version

    def table(self) -> DataFrame:
        """(id, vec, list_id, load)."""
        return self.spark.read.schema(f"id long, vec {self._kind}, list_id int, load string").parquet(self._lists(self.version))

    def vacuum(self, dead: DataFrame, key: str = "id") -> None:
        """Writes the lists without the rows of ``dead`` as a new version, and lets it count when it is whole; centres are not trained again.

        The version before stays until the next vacuum, for searches under way.
        """
        kept = self.table().join(dead.select(F.col(key).cast("long").alias("id")), "id", "left_anti")
        after = self.version + 1
        kept.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id", "load").parquet(self._lists(after))
        self._commit(after)
        for old in range(after - 1):
            for name in ("lists", "meta"):
                _delete(self.spark, f"{self.path}/{name}-{old}")

    def _query(self, q: Sequence[float] | str) -> np.ndarray:
        if self.metric == "hamming":
            if len(q) != self.dim:
                raise ValueError(f"different bit lengths {self.dim} and {len(q)}")
            return np.frombuffer(q.encode(), dtype=np.uint8) - 48.0
        q = np.asarray(q, dtype=np.float64)
        n = np.linalg.norm(q)
        return q / n if self.metric == "cosine" and n > 0 else q

    def probe_order(self, q: Sequence[float] | str) -> list[int]:
        """Lists, nearest centre first."""
        q = self._query(q)[None, :]
        q = q if self.projection is None else q @ self.projection.T
        d = block_distances(q, self.centers, self._space())[0]
        return np.lexsort((np.arange(len(d)), d)).tolist()

    def _distance(self, q) -> Column:
        if self.metric == "hamming":
            return V.hamming_distance(F.col("vec"), F.lit(q))
        return V.DISTANCES[self.metric](F.col("vec"), literal(None if q is None else self._query(q)), self.dim)

    def search(self, q: Sequence[float] | str | None, k: int, probes: int = 1, iterative: str = "off", max_probes: int = MAX_PROBES, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(id, distance, batch) of the k nearest in the probed lists, nearest first; ``where`` filters rows of the lists.

        ``iterative='relaxed_order'`` goes on with the next ``probes`` lists, a
        batch each, until k rows pass the filter or ``max_probes`` lists are
        read; rows come batch by batch, each in order. Batches are read one,
        then three, then nine more at a time, so few jobs read few lists more
        than needed. A null query returns indexed rows with null distances.
        """
        if iterative not in ("off", "relaxed_order"):
            raise ValueError(f'invalid value for parameter "ivfflat.iterative_scan": "{iterative}"')
        probes = max(1, min(probes, self.lists))
        order = self.probe_order(q) if q is not None else list(range(self.lists))
        limit = probes if iterative == "off" else min(self.lists, max(max_probes, probes))
        order = order[:limit]

        def part(a: int, b: int, want: int) -> DataFrame:
            batch = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(order[a:b]) for x in (c, (a + i) // probes))), F.col("list_id"))
            rows = self.table().where(F.col("list_id").isin(order[a:b])).withColumn("distance", self._distance(q))
            rows = rows if where is None else where(rows)
            rows = rows.withColumn("batch", batch if b - a > probes else F.lit(a // probes))
            return rows.select("id", "distance", "batch").orderBy("batch", F.col("distance").asc_nulls_last(), "id").limit(want)

        if iterative == "off":
            return part(0, limit, k)
        rows, a, step = [], 0, probes
        while a < limit and len(rows) < k:
            rows += part(a, min(a + step, limit), k - len(rows)).collect()  # k rows at most
            a, step = a + step, min(3 * step, 1024 * probes)
        found = self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id long, distance double, batch int, place int")
        return found.orderBy("place").select("id", "distance", "batch")

    def search_many(self, queries: DataFrame, k: int, probes: int = 1, qvec: str = "embedding", qkey: str = "id") -> DataFrame:
        """(qid, id, distance, rank): each query against the rows of its nearest ``probes`` lists, ties by id.

        Queries and their lists go out in blocks of QUERY_BYTES at most; each
        partition of the lists streams by and keeps k rows a query, so lists
        of any size are read where they lie.
        """
        if self.metric == "hamming":
            raise ValueError("one bit query at a time: use search")
        asked = queries.where(F.col(qvec).isNotNull()).select(F.col(qkey).cast("long").alias("qid"), F.col(qvec).cast("array<float>").alias("q"))
        n = asked.count()
        blocks = max(1, -(-(n * (self.dim * 8 + probes * 4)) // QUERY_BYTES))
        out = None
        for b in range(blocks):
            mine = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid").toArrow()
            if mine.num_rows:
                x = matrix(mine.column("q").combine_chunks())
                if self.metric == "cosine":
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                y = x if self.projection is None else x @ self.projection.T
                near = np.argsort(block_distances(y, self.centers, self._space()), axis=1, kind="stable")[:, :probes]
                part = self.table().where(F.col("list_id").isin(np.unique(near).tolist())) if blocks * probes < self.lists else self.table()
                part = part.mapInArrow(_probe(mine.column("qid").to_numpy(), x, near, k, self.metric), "qid long, id long, distance double")
                out = part if out is None else out.union(part)
        if out is None:
            out = self.table().select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("distance")).limit(0)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _probe(qids: np.ndarray, qs: np.ndarray, near: np.ndarray, k: int, metric: str):
    asks = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

    def run(batches):
        best = NONE
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids, x = batch.column("list_id").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("vec"))
            new = [best]
            for c in np.unique(lists).tolist():
                rows, who = np.flatnonzero(lists == c), asks.get(c, np.zeros(0, dtype=np.int64))
                for a in range(0, len(who), 256):
                    w = who[a : a + 256]
                    owner, i, d = nearest(qs[w], x[rows], ids[rows], k, metric)
                    new.append((w[owner], i, d))
            best = top(*(np.concatenate(z) for z in zip(*new, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["qid", "id", "distance"])

    return run


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_index(spark: SparkSession, path: str) -> IvfIndex:
    """The index that ``build`` wrote to ``path``, in this session or another, in its last complete version."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta-*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    versions = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found]
    if not versions:
        raise ValueError(f"no index at {path}")
    r = spark.read.parquet(f"{path}/meta-{max(versions)}").first()
    array = lambda raw, shape: np.frombuffer(bytes(raw), dtype="<f8").reshape(shape) if shape[0] else None
    return IvfIndex(spark, path, r["metric"], array(r["centers"], r["shape"]), r["dim"], array(r["projection"], r["r_shape"]), version=max(versions))


def _phase(spark: SparkSession, name: str, work):
    """Runs ``work`` with its name on Spark's jobs, as a build's progress."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.job.description")
    sc.setLocalProperty("spark.job.description", name)
    try:
        return work()
    finally:
        sc.setLocalProperty("spark.job.description", before)


def check_centers(centers: np.ndarray, lists: int) -> np.ndarray:
    """Centres as the index needs them: the right number, and finite."""
    if len(centers) != lists:
        raise ValueError(f"expected {lists} centers, not {len(centers)}")
    if np.isnan(centers).any():
        raise ValueError("NaN detected. Please report a bug.")
    if np.isinf(centers).any():
        raise ValueError("Infinite value detected. Please report a bug.")
    return centers


def build(df: DataFrame, path: str, vec: str = "embedding", key: str = "id", lists: int = 100, metric: str = "l2", kind: str = "vector", seed: int = 1, project: int | np.ndarray | None = None, centers: np.ndarray | None = None) -> IvfIndex:
    """Samples max(50 * lists, 10000) rows by hash, trains centres on the driver, assigns on the executors, writes list partitions to an emptied ``path``.

    ``metric`` "hamming" takes bit strings; its centres are majorities.

    ``project``: centres live in a random projection to that many dimensions,
    or in the given one (rows keep their full vectors). Null vectors, and zero ones for cosine,
    are not indexed.
    """
    if not 1 <= lists <= MAX_LISTS:
        raise ValueError(f'value {lists} out of bounds for option "lists"')
    bits = checked(metric, METRICS) == "hamming"
    kind = "bit" if bits else kind
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("string" if bits else "array<float>").alias("vec"))
    dims = rows.select((F.length("vec") if bits else F.size("vec")).alias("n")).agg(F.min("n"), F.max("n")).first()
    if dims[0] is None:
        raise ValueError("column does not have dimensions")
    if dims[0] != dims[1]:
        raise ValueError(f"expected {dims[0]} dimensions, not {dims[1]}")
    dim = dims[0]
    if dim > MAX_DIM[kind]:
        raise ValueError(f"column cannot have more than {MAX_DIM[kind]} dimensions for ivfflat index")
    spherical = metric in ("ip", "cosine")
    if metric == "hamming" and project is not None:
        raise ValueError("bits have no projection")
    if spherical and dim < 2:
        raise ValueError("dimensions must be greater than one for this opclass")
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(50 * lists, 10_000))
    sampled = _phase(df.sparkSession, "building index: sampling for k-means", sample.toArrow)
    x = (bit_matrix if bits else matrix)(sampled.column("vec").combine_chunks())
    if spherical and len(x):
        n = np.linalg.norm(x, axis=1)
        x = x[n > 0] / n[n > 0][:, None]
    r = project if isinstance(project, np.ndarray) else P.rademacher(dim, project, seed) if project else None
    notices = [] if len(x) >= lists else ["ivfflat index created with little data"]
    if centers is None:
        space = x if r is None else x @ r.T
        if spherical and len(space):
            space = space / np.maximum(np.linalg.norm(space, axis=1, keepdims=True), 1e-30)
        centers = kmeans(space.reshape(len(x), -1) if len(x) else np.zeros((0, dim if r is None else len(r))), lists, spherical, bits, seed=seed)
    centers = check_centers(np.asarray(centers, dtype=np.float64), lists)
    spark = df.sparkSession
    _delete(spark, path)
    index = IvfIndex(spark, path, metric, centers, dim, r, notices)
    _phase(spark, "building index: loading tuples", lambda: index.insert(df, vec, key, "0", "overwrite"))
    index._commit(0)
    return index
