"""Layered-graph search, one graph a shard; searches visit all shards and merge.

Points are dense or half vectors (l2, ip, cosine, l1), bit strings (hamming,
jaccard) or sparse vectors (l2, ip, cosine, l1). A shard holds about
SHARD_ROWS rows, so their number follows the table's.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import types as T
from .knn import checked, exact_distance, matrix

SAME_KEY_LIMIT = 10
"""Rows with one vector that a search returns for it, for each of ``ef``; iterative scans return all."""
SHARD_ROWS = 50_000
LEFT = 1 << 16
"""Elements that an iterative scan keeps aside, times the memory multiplier."""
QUERY_BYTES = 8 << 20
SPREAD = 4096
"""Indices over which sparse points are compared side by side."""
CHECKED = 1024
"""Points whose distances an exact check makes at once."""
KINDS = {"vector": ("l2", "ip", "cosine", "l1"), "halfvec": ("l2", "ip", "cosine", "l1"), "bit": ("hamming", "jaccard"), "sparsevec": ("l2", "ip", "cosine", "l1")}
MAX_DIM = {"vector": 2000, "halfvec": 4000, "bit": 64000, "sparsevec": 10**9}
MAX_NONZERO = 1000


def _bits(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "hamming":
        return np.bitwise_count(x ^ q).sum(axis=1, dtype=np.int64).astype(np.float64)
    both, either = (np.bitwise_count(y).sum(axis=1, dtype=np.int64) for y in (x & q, x | q))
    return np.where(both == 0, 1.0, 1.0 - both / np.maximum(either, 1))


def _sparse(q: np.ndarray, points: list[np.ndarray], metric: str) -> np.ndarray:
    """Points are arrays [2, n] of indices and values."""
    n, q = len(points), q[:, np.argsort(q[0], kind="stable")]
    row = np.repeat(np.arange(n), [p.shape[1] for p in points])
    at, v = np.concatenate(points, axis=1)
    place = np.searchsorted(q[0], at)
    hit = np.append(q[0], np.nan)[place] == at
    x = np.zeros((n, q.shape[1]))
    x[row[hit], place[hit]] = v[hit]
    alone = lambda f: np.bincount(row[~hit], f(v[~hit]), n)  # noqa: E731  of indices that only the point has
    if metric == "l2":
        return np.sqrt(((x - q[1]) ** 2).sum(axis=1) + alone(np.square))
    if metric == "l1":
        return np.abs(x - q[1]).sum(axis=1) + alone(np.abs)
    if metric == "ip":
        return -(x * q[1]).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip((x * q[1]).sum(axis=1) / np.sqrt(np.bincount(row, v * v, n) * (q[1] * q[1]).sum()), -1, 1)


def _spread(points: list[np.ndarray]) -> np.ndarray | None:
    """Sparse points side by side over the indices that any of them holds; None if those are many."""
    at, v = np.concatenate(points, axis=1)
    held = np.unique(at)
    if len(held) > SPREAD:
        return None
    x = np.zeros((len(points), len(held)))
    x[np.repeat(np.arange(len(points)), [p.shape[1] for p in points]), np.searchsorted(held, at)] = v
    return x


def _points(column: pa.Array, kind: str) -> list[np.ndarray]:
    if kind == "bit":
        return [np.packbits(np.frombuffer(x.encode(), dtype=np.uint8) - 48) for x in column.to_pylist()]
    if kind == "sparsevec":
        return [np.array([x["indices"], x["values"]], dtype=np.float64) for x in column.to_pylist()]
    return list(matrix(column))


def _unit(v: np.ndarray, kind: str) -> np.ndarray | None:
    """For cosine: of length 1; None for a zero vector."""
    n = np.linalg.norm(v[1] if kind == "sparsevec" else v)
    return None if n == 0 else np.array([v[0], v[1] / n]) if kind == "sparsevec" else v / n


def _column(vec: str, kind: str) -> Column:
    """Checked for what a graph may hold."""
    c = F.col(vec)
    if kind == "bit":
        size, out = F.length(c), c.cast("string")
    elif kind == "sparsevec":
        size, out = c["dim"], c.cast(T.SPARSE)
        out = F.when(F.size(c["indices"]) <= MAX_NONZERO, out).otherwise(T.fail(f"sparsevec cannot have more than {MAX_NONZERO} non-zero elements for hnsw index"))
    else:
        size, out = F.size(c), c.cast("array<float>")
        out = T.vector_to_halfvec(out) if kind == "halfvec" else out
    return F.when(size <= MAX_DIM[kind], out).otherwise(T.fail(f"column cannot have more than {MAX_DIM[kind]} dimensions for hnsw index"))


@dataclass
class Graph:
    """Insert and search as in the paper by Malkov and Yashunin (2016)."""

    metric: str = "l2"
    m: int = 16
    ef_construction: int = 64
    kind: str = "vector"
    points: list[np.ndarray] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    links: list[list[list[int]]] = field(default_factory=list)
    enter: int = -1
    same: dict[bytes, int] = field(default_factory=dict)

    def distance(self, q: np.ndarray, at: Sequence[int]) -> np.ndarray:
        points = [self.points[i] for i in at]
        if self.kind == "sparsevec":
            return _sparse(q, points, self.metric)
        return (_bits if self.kind == "bit" else exact_distance)(q, np.stack(points), self.metric)

    def layer(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int, seen: set[int] | None = None, left: list | None = None) -> list[tuple[float, int]]:
        """The ef nearest found, nearest first; what is put aside goes to ``left``."""
        seen = set() if seen is None else seen
        seen.update(i for _, i in start)
        near, best = list(start), [(-d, i) for d, i in start]
        heapq.heapify(near)
        heapq.heapify(best)
        while len(best) > ef:
            d, i = heapq.heappop(best)
            if left is not None:
                left.append((-d, i))
        while near:
            d, i = heapq.heappop(near)
            if len(best) >= ef and d > -best[0][0]:
                if left is not None:
                    left += [(d, i), *near]
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for x, j in zip(self.distance(q, new).tolist(), new, strict=True):
                if len(best) < ef or x < -best[0][0]:
                    heapq.heappush(near, (x, j))
                    heapq.heappush(best, (-x, j))
                    if len(best) > ef:
                        y, k = heapq.heappop(best)
                        if left is not None:
                            left.append((-y, k))
                elif left is not None:
                    left.append((x, j))
        return sorted((-d, i) for d, i in best)

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates closer to the point than to any chosen one, filled up with the others."""
        order = sorted(found)
        points = [self.points[i] for _, i in order]
        x = _spread(points) if self.kind == "sparsevec" and points else None
        kept: list[int] = []
        rest: list[int] = []
        for a, (d, i) in enumerate(order):
            if len(kept) >= most:
                break
            if not kept:
                near = False
            elif x is None:
                near = (self.distance(points[a], [order[b][1] for b in kept]) <= d).any()
            else:
                near = (exact_distance(x[a], x[kept], self.metric) <= d).any()
            (rest if near else kept).append(a)
        return [order[a][1] for a in (kept + rest)[:most]]

    def add(self, row: int, v: np.ndarray, chance: float) -> None:
        key = v.tobytes()
        if key in self.same:
            self.ids[self.same[key]].append(row)
            return
        level = min(int(-math.log(max(chance, 1e-12)) / math.log(self.m)), 16)
        me = len(self.points)
        self.same[key] = me
        self.points.append(v)
        self.ids.append([row])
        self.links.append([[] for _ in range(level + 1)])
        if self.enter < 0:
            self.enter = me
            return
        top = len(self.links[self.enter]) - 1
        at = [(float(self.distance(v, [self.enter])[0]), self.enter)]
        for lev in range(top, level, -1):
            at = self.layer(v, at[:1], 1, lev)
        for lev in range(min(top, level), -1, -1):
            at = self.layer(v, at, self.ef_construction, lev)
            most = self.m * (2 if lev == 0 else 1)
            self.links[me][lev] = self.choose(at, self.m)
            for j in self.links[me][lev]:
                theirs = self.links[j][lev]
                theirs.append(me)
                if len(theirs) > most:
                    d = self.distance(self.points[j], theirs).tolist()
                    self.links[j][lev] = self.choose(list(zip(d, theirs, strict=True)), most)
        if level > top:
            self.enter = me

    def checked(self, q: np.ndarray, found: list[tuple[float, int]], k: int, keep=None) -> list[tuple[float, int]]:
        """The k nearest rows, ties by row: every point that isn't among the found is held against their k-th distance."""
        rows = sorted((d, r) for d, i in found for r in self.ids[i] if keep is None or r in keep)[:k]
        most, held = rows[-1][0] if len(rows) == k else math.inf, {i for _, i in found}
        rest = [i for i in range(len(self.points)) if i not in held]
        for a in range(0, len(rest), CHECKED):
            at = rest[a : a + CHECKED]
            d = self.distance(q, at)
            rows += [(float(d[j]), r) for j in np.flatnonzero(~(d > most)).tolist() for r in self.ids[at[j]] if keep is None or r in keep]
        order = np.lexsort(([r for _, r in rows], [d for d, _ in rows]))[:k]
        return [rows[j] for j in order.tolist()]

    def search(self, q: np.ndarray, ef: int, k: int, iterative: str = "off", keep=None, max_tuples: int = 20_000, most_left: int = LEFT, exact: bool = False) -> list[tuple[float, int]]:
        """(distance, row). Iterative scans go on from what was put aside until k rows pass ``keep``, ``max_tuples`` are seen or more than ``most_left`` elements
        are put aside; strict order drops rows nearer than one before. ``exact``: what is found is checked instead, see ``checked``."""
        if self.enter < 0:
            return []
        at = [(float(self.distance(q, [self.enter])[0]), self.enter)]
        for lev in range(len(self.links[self.enter]) - 1, 0, -1):
            at = self.layer(q, at[:1], 1, lev)
        seen: set[int] = set()
        left: list[tuple[float, int]] = []
        found = self.layer(q, at, ef, 0, seen, left)
        if exact:
            return self.checked(q, found, k, keep)
        out: list[tuple[float, int]] = []
        last, read = -math.inf, 0
        while True:
            for d, i in found:
                read += 1
                if iterative == "strict_order" and d < last:
                    continue
                last = max(last, d)
                rows = self.ids[i] if iterative != "off" else self.ids[i][: SAME_KEY_LIMIT * ef]
                out += [(d, r) for r in rows if keep is None or r in keep]
            if iterative == "off" or len(out) >= k or read >= max_tuples or not left or len(left) > most_left:
                break
            aside = set(left)
            start = heapq.nsmallest(ef, aside)
            left = list(aside.difference(start))
            found = self.layer(q, start, ef, 0, seen, left)
        return out[:k]

    def without(self, dead: set[int], seed: int = 1) -> Graph:
        """The graph without rows; elements that lose all their rows go, and those that linked to them get neighbours anew."""
        ids = [[r for r in rows if r not in dead] for rows in self.ids]
        kept = [i for i, rows in enumerate(ids) if rows]
        if len(kept) < 0.7 * len(ids):  # little is left to repair from
            g, rng = Graph(self.metric, self.m, self.ef_construction, self.kind), np.random.default_rng(seed)
            for i in kept:
                for r in ids[i]:
                    g.add(r, self.points[i], rng.random())
            return g
        place = {old: new for new, old in enumerate(kept)}
        g = Graph(self.metric, self.m, self.ef_construction, self.kind, [self.points[i] for i in kept], [ids[i] for i in kept], same={k: place[i] for k, i in self.same.items() if i in place})
        g.links = [[[place[j] for j in level if j in place] for level in self.links[i]] for i in kept]
        top = max((len(x) for x in g.links), default=0)
        g.enter = next((i for i, x in enumerate(g.links) if len(x) == top), -1)
        for i, old in enumerate(kept):
            for lev, level in enumerate(self.links[old]):
                if any(j not in place for j in level):
                    g._relink(i, lev)
        return g

    def _relink(self, i: int, lev: int) -> None:
        """Neighbours of an element on one level, found from the entry and from those it has left."""
        v, start = self.points[i], {self.enter, *self.links[i][lev]} - {i}
        start = [j for j in start if len(self.links[j]) > lev]
        if not start:
            return
        found = self.layer(v, list(zip(self.distance(v, start).tolist(), start, strict=True)), self.ef_construction, lev)
        self.links[i][lev] = self.choose([x for x in found if x[1] != i], self.m)
        most = self.m * (2 if lev == 0 else 1)
        for j in self.links[i][lev]:
            theirs = self.links[j][lev]
            if i not in theirs:
                theirs.append(i)
                if len(theirs) > most:
                    self.links[j][lev] = self.choose(list(zip(self.distance(self.points[j], theirs).tolist(), theirs, strict=True)), most)


_shard_schema = pa.schema([("shard", pa.int32()), ("graph", pa.binary())])


def _grown(metric: str, m: int, ef_construction: int, kind: str, seed: int):
    """A shard's graph, or none yet, with more rows."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        g = pickle.loads(old.column("graph")[0].as_py()) if old.num_rows else Graph(metric, m, ef_construction, kind)
        if new.num_rows:
            column = new.column("vec").combine_chunks()
            ids, points = new.column("id").to_pylist(), _points(column, kind)
            chances = np.random.default_rng([seed, len(g.points)]).random(len(ids)).tolist()
            for i, u in zip(np.argsort(ids, kind="stable").tolist(), chances, strict=True):
                v = _unit(points[i], kind) if metric == "cosine" else points[i]
                if v is not None:
                    g.add(ids[i], v, u)
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        return pa.table([pa.array([shard], pa.int32()), pa.array([pickle.dumps(g)], pa.binary())], schema=_shard_schema)

    return run


def _shrunk(old: pa.Table, dead: pa.Table) -> pa.Table:
    if not old.num_rows or not dead.num_rows:
        return old.select(["shard", "graph"]).cast(_shard_schema)
    g = pickle.loads(old.column("graph")[0].as_py()).without(set(dead.column("id").to_pylist()))
    return pa.table([old.column("shard").combine_chunks(), pa.array([pickle.dumps(g)], pa.binary())], schema=_shard_schema)


@dataclass
class HnswIndex:
    """Graphs of a table, in versions: ``path``/v<n> counts once it is whole, the largest of them."""

    spark: SparkSession
    path: str
    metric: str
    kind: str = "vector"
    shards: int = 1
    m: int = 16
    ef_construction: int = 64
    seed: int = 1
    version: int = 0

    def table(self) -> DataFrame:
        return self.spark.read.schema("shard int, graph binary").parquet(f"{self.path}/v{self.version}")

    def _rows(self, df: DataFrame, vec: str, key: str) -> DataFrame:
        rows = df.where(F.col(vec).isNotNull())
        return rows.select(self._shard(key), F.col(key).cast("long").alias("id"), _column(vec, self.kind).alias("vec"))

    def _shard(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.shards)).cast("int").alias("shard")

    def _write(self, graphs: DataFrame, version: int) -> None:
        graphs.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.version = version

    def insert(self, df: DataFrame, vec: str = "embedding", key: str = "id") -> None:
        """Adds rows to the graphs of their shards, as a new version. Null vectors, and zero ones for cosine, stay out."""
        grow = _grown(self.metric, self.m, self.ef_construction, self.kind, self.seed)
        old = self.table().groupBy("shard")
        self._write(old.cogroup(self._rows(df, vec, key).groupBy("shard")).applyInArrow(grow, "shard int, graph binary"), self.version + 1)

    def vacuum(self, dead: DataFrame, key: str = "id") -> None:
        """Takes the rows of ``dead`` out of the graphs and mends their neighbours' links, as a new version."""
        gone = dead.select(self._shard(key), F.col(key).cast("long").alias("id"))
        self._write(self.table().groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_shrunk, "shard int, graph binary"), self.version + 1)

    def search(self, query, k: int, ef_search: int = 40, iterative: str = "off", where: DataFrame | None = None, max_scan_tuples: int = 20_000, mem_multiplier: float = 1, exact: bool = False) -> DataFrame:
        """(id, distance) for one query: a list of numbers, a bit string, or (indices, values) of a sparse one, indices from 0."""
        if query is None:
            return self.spark.createDataFrame([], "id long, distance double")
        if self.kind == "bit":
            one = self.spark.createDataFrame([(0, query)], "qid long, q string")
        elif self.kind == "sparsevec":
            held = (int(max(query[0], default=0)) + 1, [int(i) for i in query[0]], [float(x) for x in query[1]])
            one = self.spark.createDataFrame([(0, held)], f"qid long, q {T.SPARSE}")
        else:
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, q array<float>")
        return self.search_many(one, k, ef_search, iterative, "q", "qid", where, max_scan_tuples, mem_multiplier, exact).drop("qid")

    def search_many(
        self, queries: DataFrame, k: int, ef_search: int = 40, iterative: str = "off", qvec: str = "embedding", qkey: str = "id", where: DataFrame | None = None, max_scan_tuples: int = 20_000, mem_multiplier: float = 1, exact: bool = False
    ) -> DataFrame:
        """(qid, id, distance): every shard searches, the k nearest a query stay, nearest first.

        ``where``: a table whose column ``id`` holds the rows that may be
        found; they meet the graphs shard by shard. Without an iterative scan
        a search so filtered may find fewer than k. ``max_scan_tuples`` and
        ``mem_multiplier`` end iterative scans, shard by shard. ``exact``:
        every shard holds the points that its search didn't find against the
        k-th distance, so that no near row is missed; that reads all points.
        Queries go out in blocks of QUERY_BYTES at most.
        """
        if not 1 <= ef_search <= 1000:
            raise ValueError(f'{ef_search} is outside the valid range for parameter "hnsw.ef_search" (1 .. 1000)')
        if iterative not in ("off", "relaxed_order", "strict_order"):
            raise ValueError(f'invalid value for parameter "hnsw.iterative_scan": "{iterative}"')
        asked = queries.where(F.col(qvec).isNotNull()).select(F.col(qkey).cast("long").alias("qid"), _column(qvec, self.kind).alias("q"))
        graphs = self.table()
        if where is not None:
            kept = where.select(self._shard("id"), F.col("id").cast("long").alias("id")).groupBy("shard").agg(F.collect_set("id").alias("keep"))
            graphs = graphs.join(kept, "shard")
        size = F.size("q") if self.kind in ("vector", "halfvec") else F.length("q") if self.kind == "bit" else F.size("q.indices") * 2
        total = asked.agg(F.coalesce(F.sum(size.cast("long") * 8 + 16), F.lit(0))).first()[0]
        blocks = max(1, -(-total // QUERY_BYTES))
        out = None
        for b in range(blocks):
            mine = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
            part = graphs.mapInArrow(self._searched(mine, k, ef_search, iterative, max_scan_tuples, mem_multiplier, exact), "qid long, id long, distance double")
            out = part if out is None else out.union(part)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).orderBy("qid", "rank").drop("rank")

    def _searched(self, asked: pa.Table, k: int, ef: int, iterative: str, tuples: int, memory: float, exact: bool):
        metric, kind = self.metric, self.kind
        qids = asked.column("qid").to_pylist()
        qs = _points(asked.column("q").combine_chunks(), kind) if qids else []
        if metric == "cosine":
            qs = [q if (u := _unit(q, kind)) is None else u for q in qs]

        def run(batches):
            for batch in batches:
                keeps = batch.column("keep").to_pylist() if "keep" in batch.schema.names else [None] * batch.num_rows
                for blob, keep in zip(batch.column("graph"), keeps, strict=True):
                    g, keep, rows = pickle.loads(blob.as_py()), None if keep is None else set(keep), []
                    for i, q in zip(qids, qs, strict=True):
                        rows += [(i, r, d) for d, r in g.search(q, ef, k, iterative, keep, tuples, int(memory * LEFT), exact)]
                    columns = (pa.array([x[j] for x in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64())))
                    yield pa.RecordBatch.from_arrays(list(columns), names=["qid", "id", "distance"])

        return run


def build(
    df: DataFrame, path: str, vec: str = "embedding", key: str = "id", metric: str = "l2", m: int = 16, ef_construction: int = 64, shards: int | None = None, seed: int = 1, kind: str = "vector"
) -> HnswIndex:
    """One graph for each of ``shards`` groups of rows, by hash of the key; by default one for every SHARD_ROWS rows. Null vectors, and zero ones for cosine, stay out."""
    if not 2 <= m <= 100:
        raise ValueError(f'value {m} out of bounds for option "m"')
    if not 4 <= ef_construction <= 1000:
        raise ValueError(f'value {ef_construction} out of bounds for option "ef_construction"')
    if ef_construction < 2 * m:
        raise ValueError("ef_construction must be greater than or equal to 2 * m")
    checked(metric, KINDS[kind])
    shards = shards or max(1, -(-df.count() // SHARD_ROWS))
    index = HnswIndex(df.sparkSession, path, metric, kind, shards, m, ef_construction, seed)
    rows = index._rows(df, vec, key)
    none = df.sparkSession.createDataFrame([], "shard int, graph binary")
    grow = _grown(metric, m, ef_construction, kind, seed)
    index._write(none.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(grow, "shard int, graph binary"), 0)
    return index
