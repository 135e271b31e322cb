"""Near duplicates by the Jaccard similarity of word shingles: Golay-code fuzzy keys over min-wise bits.

This isn't SimHash proper: SimHash bits of texts with a similarity of 0.8 differ in 15 % of places, too
many for selective keys; here the fingerprint is made of min-wise samples,
whose lowest bits differ in 10 %. A document has ``TABLES`` segments of 23
bits. Each is decoded to the indices of the Golay codewords near it (one to
six, as in ``simhash``); a key is one index with two whole samples. Two
texts at 0.8 share a key of a table with a chance of about 0.5, of any table
of about 0.9998.

A first pass links each text with the nearest, by 128 further bits, of the
rows that lead its keys, by all bits, and where those can't tell for sure by
the shingles themselves: one candidate a text. Keys
that hold several components after that join their rows into groups, and a
second pass compares all rows of a group whose components differ, by all bits
and then by their shingles, in cells that send links alone. So no row that
shares a key with a similar one is lost, and nothing grows with the square of
a group but the comparisons in memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, known_id, mix, prefix_hashes, row_in, slice_words, slices, span_hashes, text_rows, whole_row, window_hashes
from .components import components
from .simhash import indices

TABLES, WHOLE, CHECK, FIRST = 12, 2, 256, 128
SAMPLES = TABLES * (23 + WHOLE) + CHECK
BITS = TABLES * 23 + CHECK
SIGMAS = 3.5
GATE = 5.0
"""Of the first check bits; they are the same for all tables, so it is wider than that of all bits."""
PRIME = np.uint64(0x9E3779B97F4A7C15)
SMALL = 64 << 20
CELL = 1024
LEADERS = 256
"""Rows of a key that others are compared with in the first pass; the second one handles the rest."""


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles; of fewer words one of all, without words one that stands for none."""
    if not len(words):
        return np.zeros(1, dtype=np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def node_of(words: np.ndarray) -> int:
    """A 64-bit hash of the word sequence."""
    if not len(words):
        return 0
    whole = span_hashes(prefix_hashes(words), np.array([0]), np.array([len(words)]))
    return int(mix(whole ^ np.uint64(len(words))).view(np.int64)[0])


def samples(hashes: np.ndarray) -> np.ndarray:
    """``SAMPLES`` min-wise values: rounds of one-permutation hashing fill the cells, the rest take the least of their own permutation."""
    rounds = max(1, math.ceil(SAMPLES * (math.log(SAMPLES) + 1) / len(hashes)))
    out = np.full(SAMPLES, 2**64 - 1, dtype=np.uint64)
    r = np.arange(rounds, dtype=np.uint64)[:, None]
    x = mix(hashes[None, :] ^ (r * PRIME))
    cell = (x >> np.uint64(32)) * np.uint64(SAMPLES) >> np.uint64(32)
    np.minimum.at(out, cell.ravel().astype(np.int64), ((x & np.uint64(0xFFFFFFFF)) | r << np.uint64(32)).ravel())
    free = np.flatnonzero(out == 2**64 - 1)
    for j, seed in zip(free.tolist(), mix(-1 - free).tolist(), strict=True):
        out[j] = mix(hashes ^ np.uint64(seed)).min()
    return mix(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Words: a hash of the whole samples per table, the segments two a word, the check bits."""
    s = samples(hashes)
    whole, rest = s[: TABLES * WHOLE].reshape(TABLES, WHOLE), s[TABLES * WHOLE :] & np.uint64(1)
    key = mix(whole[:, 0] ^ mix(whole[:, 1] ^ np.arange(TABLES, dtype=np.uint64)))
    segments = (rest[: TABLES * 23].reshape(TABLES, 23) << np.arange(23, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype("<u4")
    check = np.packbits(rest[TABLES * 23 :].astype(np.uint8))
    return np.concatenate((key.astype("<u8"), segments.view("<u8"), check.view("<u8")))


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            first = 0
            for ids, texts in slices(batch):
                row, first = batch.column("row").slice(first, len(ids)), first + len(ids)
                words, at = slice_words([t.lower() for t in texts])  # bytes: only A-Z change
                parts = [words[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                nodes = pa.array([node_of(w) for w in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), row, nodes, pa.array(list(map(len, texts)), pa.int64()), pa.array([sketch(shingles_of(w, width)).tobytes() for w in parts], pa.binary())], names=["doc", "row", "node", "size", "sketch"])

    return run


def _bits() -> Column:
    """The segments and check bits of a sketch."""
    return F.substring("sketch", 8 * TABLES + 1, 4 * TABLES + CHECK // 8)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), -1)


class _Leaders:
    """Of one key's rows, those that lead: with no earlier leader ``same`` bits away or fewer."""

    def __init__(self):
        self.nodes, self.words = [], []

    def take(self, node: np.ndarray, word: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of further rows: the nearest leader (its node), how many bits it is away (a large number without one), whether the row leads."""
        near, far = np.zeros(len(node), dtype=np.int64), np.full(len(node), 999)
        leads = np.zeros(len(node), dtype=bool)
        left, at = np.arange(len(node)), 0
        while len(left):
            if at == len(self.nodes):
                if at >= LEADERS:
                    break
                x, left = left[0], left[1:]
                leads[x] = True
                self.nodes.append(node[x])
                self.words.append(word[x])
            d = np.bitwise_count(word[left] ^ self.words[at]).sum(axis=1, dtype=np.int64)
            closer = (d < far[left]) & (node[left] != self.nodes[at])
            near[left[closer]], far[left[closer]] = self.nodes[at], d[closer]
            left = left[d > same]
            at += 1
        return near, far, leads


def _close(key: np.ndarray, node: np.ndarray, word: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: (row's node, leader's node, bits between) of those that a leader settles, ``same`` bits away or fewer, and which rows go on."""
    edges = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
    goes_on = np.ones(len(key), dtype=bool)
    out = [(np.zeros(0, dtype=np.int64),) * 3]
    many = ends - starts > 1
    for i, j in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
        near, far, _ = _Leaders().take(node[i:j], word[i:j], same)
        hit = far <= same
        out.append((node[i:j][hit], near[hit], far[hit]))
        goes_on[i:j] = ~hit
    return *(np.concatenate(x) for x in zip(*out, strict=True)), goes_on


def _rows(key, node, other, word):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64()) for x in (key, node, other, *word.T)], names=["key", "node", "other", "w0", "w1"])


def _keys_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for the keys of all sketches."""
    segments = np.ascontiguousarray(s[:, TABLES : TABLES + TABLES // 2]).view("<u4")
    keys, rows = [], []
    for t in range(TABLES):
        k = indices(segments[:, t])
        row, col = np.nonzero(np.concatenate((np.ones((len(k), 1), dtype=bool), k[:, 1:] != k[:, :1]), axis=1))
        keys.append(mix(s[row, t] ^ k[row, col].astype(np.uint64)))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _fuzzy_keys(same: int):
    """Rows (key, node, node, check words), combined within the batch first; candidates found there travel as (any key, node, leader, bits, 0)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                node, s = part.column("node").to_numpy(), _words(part.column("sketch"))
                key, row = _keys_of(s)
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                word = s[row, TABLES + TABLES // 2 : TABLES + TABLES // 2 + 2]
                a, b, far, on = _close(key, node[row], word, same)
                yield _rows(key[on], node[row][on], node[row][on], word[on])
                if len(a):
                    a, b, far = _nearest(a, b, far)
                    yield _rows(mix(a), a, b, np.stack((far, np.zeros_like(far)), axis=1).view(np.uint64))

    return run


def _nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its nearest leader."""
    order = np.lexsort((b, far, a))
    a, b, far = a[order], b[order], far[order]
    first = np.concatenate((np.ones(min(1, len(a)), dtype=bool), a[1:] != a[:-1]))
    return a[first], b[first], far[first]


def _candidates(most: int, same: int):
    """(node, leader, bits) from rows sorted by key; only the leaders of the key that goes on are kept between batches."""

    def run(batches):
        last, leaders = None, _Leaders()
        for batch in batches:
            key, node, other, *word = (batch.column(c).to_numpy() for c in ("key", "node", "other", "w0", "w1"))
            ready = node != other
            out = [(node[ready], other[ready], word[0][ready])]
            key, node, word = key[~ready], node[~ready], np.stack(word, axis=1)[~ready].view(np.uint64)
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            alone = np.diff(np.concatenate(([0], edges, [len(key)]))) == 1
            for i, j, one in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], alone.tolist(), strict=True) if len(key) else ():
                if key[i] != last:
                    if one and j < len(key):
                        continue
                    last, leaders = key[i], _Leaders()
                near, far, _ = leaders.take(node[i:j], word[i:j], same)
                hit = far <= most
                out.append((node[i:j][hit], near[hit], far[hit]))
            found = _nearest(*(np.concatenate(x) for x in zip(*out, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "near", "far"])

    return run


def _limits(least: float) -> tuple[int, int]:
    """Of the first check bits: so few differ clearly above ``least``, so many at ``least`` at most."""
    differ, sigma = FIRST * (1 - least) / 2, math.sqrt(FIRST * (1 - least) * (1 + least)) / 2
    return math.floor(differ - 1.5 * sigma), math.ceil(differ + GATE * sigma)


def _doubt(least: float) -> float:
    """How far an estimate by all bits may be off."""
    return SIGMAS * 2 * math.sqrt((1 - least) / 2 * (1 + least) / 2 / BITS)


def _judged(least: float):
    """Keeps candidates that may reach ``least``; ``sure`` where all bits leave no doubt."""
    wide = _doubt(least)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.bitwise_count(_words(batch.column("x")) ^ _words(batch.column("y"))).sum(axis=1, dtype=np.int64)
            about = 1 - 2 * d / BITS
            may = about >= least - wide
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(may)), batch.column("b").filter(pa.array(may)), pa.array(about[may] >= least + wide)], names=["a", "b", "sure"])

    return run


def _key_roots(batches):
    """All keys of all nodes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            key, row = _keys_of(_words(part.column("sketch")))
            node, root = (part.column(c).to_numpy()[row] for c in ("node", "root"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(root)], names=["key", "node", "root"])


def _across(least: float):
    """Streams rows sorted by cell and side; links between different components, no two for the same pair of them. Side 0 meets side 1, side 2 itself."""
    wide = 4.5 / SIGMAS * _doubt(least)

    def links(side, node, root, bits, sets):
        parent: dict[int, int] = {}

        def find(r: int) -> int:
            while parent.setdefault(r, r) != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        out, size = [], np.array([len(x) for x in sets])
        roots = root.tolist()
        for x in range(len(node)):
            if side[x] == 1:
                break
            others = np.arange(x + 1, len(node)) if side[x] == 2 else np.flatnonzero(side == 1)
            others = others[(root[others] != root[x]) & (np.minimum(size[others], size[x]) >= least * np.maximum(size[others], size[x]))]
            near = 1 - 2 * np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64) / BITS
            may = np.flatnonzero(near >= least - wide)
            for o in others[may[np.argsort(-near[may], kind="stable")]].tolist():
                if find(roots[o]) == find(roots[x]):
                    continue
                both = len(np.intersect1d(sets[x], sets[o], assume_unique=True))
                if both >= least * (size[x] + size[o] - both):
                    out.append((int(node[x]), int(node[o])))
                    parent[find(roots[o])] = find(roots[x])
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held, now = [], None

        def flush():
            rows = [np.concatenate(x) for x in zip(*((h[0], h[1], h[2]) for h in held), strict=True)]
            return links(*rows, np.concatenate([h[3] for h in held]), [x for h in held for x in h[4]])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, side, node, root = (batch.column(c).to_numpy() for c in ("cell", "side", "node", "root"))
            bits, shingles = _words(batch.column("bits")), batch.column("shingles")
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and cell[i] != now:
                    yield flush()
                    held = []
                now = cell[i]
                held.append((side[i:j], node[i:j], root[i:j], bits[i:j], [np.frombuffer(x.as_py(), dtype=np.int64) for x in shingles.slice(i, j - i)]))
        if held:
            yield flush()

    return run


def _skipped(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, least: float) -> DataFrame | None:
    """(a, b): links between texts with a common key whose components differ still; None where no key has two components.

    Keys that share a row make one group. In a group the rows of the largest
    component meet all others, and the others meet one another, in cells of
    about ``CELL`` rows a side, so no task takes a whole large group.
    """
    now = cut(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc", "row", "sketch"))
    keyed = now.select("node", "root", "sketch").mapInArrow(_key_roots, "key long, node long, root long")
    mixed = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("b")).where("lo != hi")
    mixed = cut(mixed.select("key", "b"))
    n = mixed.count()
    if not n:
        return None
    edges = cut(keyed.join(F.broadcast(mixed) if n * 16 <= SMALL else mixed, "key").select(F.col("node").alias("a"), "b").distinct())
    groups = components(edges).select("node", F.col("root").alias("grp"))
    rows = cut(now.join(groups, "node").select("node", "root", "grp", "doc", "row", _bits().alias("bits")))
    sizes = rows.groupBy("grp", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    sizes = sizes.select("grp", F.col("top.root").alias("big"), F.ceil(F.col("top.n") / CELL).alias("c1"), F.ceil((F.col("all") - F.col("top.n")) / CELL).alias("c2"))
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda kind, i, j, side: F.struct(F.xxhash64("grp", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))
    of_big = F.transform(upto("c2"), lambda g: cell(0, at("c1"), g, F.lit(0)))
    with_big = F.transform(upto("c1"), lambda g: cell(0, g, at("c2"), F.lit(1)))
    with_rest = F.transform(upto("c2"), lambda g: cell(1, F.least(g, at("c2")), F.greatest(g, at("c2")), F.when(g == at("c2"), 2).when(g < at("c2"), 1).otherwise(0)))
    dealt = rows.join(sizes, "grp").select("node", "root", "bits", F.explode(F.when(F.col("root") == F.col("big"), of_big).otherwise(F.concat(with_big, with_rest))).alias("at"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("node", "root", "bits", "at.cell", "at.side").join(_shingles(docs, rows, width), "node")
    return dealt.repartition(parts, "cell").sortWithinPartitions("cell", "side", "node").mapInArrow(_across(least), "a long, b long")


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch):
                words, at = slice_words([t.lower() for t in texts])
                for i, j in zip(at[:-1], at[1:], strict=True):
                    part = words[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(part)], pa.int64()), pa.array([shingles_of(part, width).tobytes()], pa.binary())], names=["node", "shingles"])

    return run


def _shingles(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the texts of ``rows`` (doc, row); only these are read again."""
    ids = cut(rows.select(F.col("doc").alias("__doc"), F.col("row").alias("__row")).distinct())
    few = ids.count() * 16 <= SMALL
    texts = text_rows(docs).join(F.broadcast(ids) if few else ids, (known_id(F.col("doc_id")) == F.col("__doc")) & (row_in(F.col("text")) == F.col("__row")), "left_semi")
    return texts.mapInArrow(_sets(width), "node long, shingles binary").dropDuplicates(["node"])


def _agree(least: float):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            keep = []
            for i, j in zip(x, y, strict=True):
                i, j = np.frombuffer(i.as_py(), dtype=np.int64), np.frombuffer(j.as_py(), dtype=np.int64)
                both = len(np.intersect1d(i, j, assume_unique=True))
                keep.append(both >= least * (len(i) + len(j) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def _verified(docs: DataFrame, nodes: DataFrame, doubtful: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs whose shingles reach ``least``."""
    wanted = doubtful.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _shingles(docs, nodes.join(wanted, "node", "left_semi"), width)
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return doubtful.join(x, "a").join(y, "b").mapInArrow(_agree(least), "a long, b long")


def _stars(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    rows = text_rows(docs).withColumn("row", row_in(F.col("text")))
    return cut(rows.mapInArrow(_sketches(shingle), "doc long, row long, node long, size long, sketch binary"))


def _rank() -> Column:
    """Of the longest text the smallest rank, of equal ones that of the largest doc_id; null ids last."""
    return F.struct((-F.col("size")).alias("size"), F.bitwise_not("doc").alias("doc"), "row")


def _grouped(docs: DataFrame, found: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, doc, row, longest, root) per distinct text of ``found``: its first document and row, that of the longest spelling, and its component."""
    same, most = _limits(least)
    nodes = found.groupBy("node").agg(F.min(F.struct("doc", "row")).alias("first"), F.min(_rank()).alias("longest"), F.min("sketch").alias("sketch"))
    nodes = cut(nodes.select("node", "first.doc", "first.row", "longest", "sketch"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("node", "sketch").mapInArrow(_fuzzy_keys(same), "key long, node long, other long, w0 long, w1 long")
    near = keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_candidates(most, same), "node long, near long, far long")
    near = near.groupBy("node").agg(F.min(F.struct("far", "near")).alias("best"))
    pairs = near.select(F.least("node", "best.near").alias("a"), F.greatest("node", "best.near").alias("b")).distinct()
    for c, s in (("a", "x"), ("b", "y")):
        pairs = pairs.join(nodes.select(F.col("node").alias(c), _bits().alias(s)), c)
    judged = cut(pairs.mapInArrow(_judged(least), "a long, b long, sure boolean"))
    sure, doubtful = judged.where("sure").select("a", "b"), judged.where(~F.col("sure")).select("a", "b")
    roots = components(sure.union(_verified(docs, nodes, doubtful, shingle, least)))
    more = _skipped(docs, nodes, roots, shingle, least)
    if more is not None and not (more := cut(more)).isEmpty():
        # the stars of the first pass stand for all its links
        roots = components(_stars(roots).union(more))
    return nodes.select("node", "doc", "row", "longest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc, node, component_id) per row of ``docs``: texts link at a Jaccard similarity of ``least`` or more of their ``shingle``-word shingles.

    Words are parted by ASCII white space, A-Z lower-cased; shingles count
    once. Fewer words: one shingle of all. Null or empty texts, or those
    without words, link with one another only. component_id is the smallest
    doc_id reachable over links. Null doc_id: NO_ID, one document, smaller
    than all others. Repeated rows keep their rows. Texts of equal words are
    one ``node``. Links show up as paths where a key's rows are linked to its
    leaders; where a key has several components after that, all its rows of
    different components are compared.
    """
    found = _sketched(docs, shingle)
    least_of = _grouped(docs, found, shingle, least)
    tops = least_of.groupBy("root").agg(F.min("doc").alias("component_id"))
    return found.select("doc", "node").join(least_of.select("node", "root").join(tops, "root").select("node", "component_id"), "node")


def keep_first(docs: DataFrame, shingle: int = 5, least: float = 0.8, longest: bool = False) -> DataFrame:
    """One row of each group of similar texts, all columns kept: that of its smallest doc_id and text hash, or with ``longest`` that of its longest text (bytes) and, of those, the largest doc_id.

    A known doc_id is one document: of its rows the one of the smallest text
    hash stands for it, the others neither stay nor link. Rows with a null
    doc_id are judged each by its own text. No group of the rows that are left
    goes whole. Of rows that agree in doc_id and text the one whose JSON is
    smallest stays. Null and empty texts link with one another. Empty table:
    no rows.
    """
    found = _sketched(docs, shingle)
    again = found.where(F.col("doc") != F.lit(NO_ID)).groupBy("doc").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    again = cut(again.where("lo != hi").select("doc", "lo"))
    if not again.isEmpty():
        found = cut(found.join(again, "doc", "left").where("lo is null or row = lo").drop("lo"))
    best = F.min("longest" if longest else F.struct("doc", "row")).alias("top")
    stay = _grouped(docs, found, shingle, least).groupBy("root").agg(best)
    doc = F.bitwise_not("top.doc") if longest else F.col("top.doc")
    stay = stay.select(doc.alias("__doc"), F.col("top.row").alias("__hash"))
    rows = docs.select(known_id(F.col("doc_id")).alias("__doc"), row_in(F.col("text").cast("string")).alias("__hash"), whole_row(docs).alias("__row"))
    rows = rows.join(stay, ["__doc", "__hash"], "left_semi")
    return rows.groupBy("__doc", "__hash").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")
