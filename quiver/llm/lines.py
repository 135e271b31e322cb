"""Line dedup over range-partitioned line hashes.

Lines become (hash, document, position) rows, range-partitioned by hash and
document with the largest document first, so that a frequent line spreads
over partitions. Each partition is streamed once: the first occurrence of a
key is the one that stays. Keys that touch a partition's edge are settled by
a summary of at most two rows a partition. Decisions leave as compressed
bitmaps per document; texts are not part of that exchange.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, known_id, row_in, text_rows

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "kind int, h1 long, h2 long, doc long, row long, pos int, n long, top long"
_DROP, _OPEN, _EDGE = 0, 1, 2  # a decision; an occurrence whose key goes on elsewhere; what a partition knows of such a key
_row_schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("top", pa.int64())])


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select(known_id(F.col("doc_id")).alias("doc"), row_in(F.col("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "row", "pos")


class _Stream:
    """Reads sorted rows of one partition; holds the rows of the key's first ``least`` documents at most, and only of a key inside the partition."""

    def __init__(self, least: int):
        self.least = least
        self.key, self.first_key = None, True
        self.held: list[np.ndarray] = []
        self.docs, self.top, self.last = 0, NO_ID, None

    def rows(self, kind, part, top):
        n = len(part)
        return {"kind": np.full(n, kind, np.int32), "h1": part[:, 0], "h2": part[:, 1], "doc": part[:, 2], "row": part[:, 3], "pos": part[:, 4].astype(np.int32), "n": np.zeros(n, np.int64), "top": np.full(n, top, np.int64)}

    def edge(self):
        one = lambda x: np.array([x], np.int64)
        return {"kind": np.full(1, _EDGE, np.int32), "h1": one(self.key[0]), "h2": one(self.key[1]), "doc": one(0), "row": one(0), "pos": np.zeros(1, np.int32), "n": one(self.docs), "top": one(self.top)}

    def run(self, part: np.ndarray):
        """Rows of the current key, in order."""
        fresh = np.concatenate(([part[0, 2] != self.last], part[1:, 2] != part[:-1, 2]))
        if self.docs == 0:
            self.top = int(part[0, 2])
        self.docs += int(fresh.sum())
        self.last = int(part[-1, 2])
        if self.first_key:
            yield self.rows(_OPEN, part, 0)
        elif self.docs >= self.least:
            for p in (*self.held, part):
                if len(p := p[p[:, 2] != self.top]):
                    yield self.rows(_DROP, p, self.top)
            self.held = []
        else:
            self.held.append(part)

    def close(self, at_end: bool):
        """The key has no more rows here. A frequent key at the end has been settled but for its first document: larger ones come first, in earlier partitions."""
        if self.key is not None:
            if self.first_key or at_end:
                yield self.edge()
                for p in self.held:
                    yield self.rows(_OPEN, p, 0)
            self.held = []
            self.first_key = False
        self.key, self.docs, self.last = None, 0, None


def _stream(least: int):
    def run(batches):
        state = _Stream(least)

        def out(found):
            for x in found:
                yield pa.RecordBatch.from_arrays([pa.array(x[n], t) for n, t in zip(_row_schema.names, _row_schema.types, strict=True)], schema=_row_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "row", "pos")], axis=1)
            edges = np.flatnonzero((part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1])) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(part)]))
            lone = (ends - starts == 1) & (starts > 0) & (ends < len(part))  # inside the batch, one row: nothing to decide
            if least > 1:
                starts, ends = starts[~lone], ends[~lone]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                key = (int(part[a, 0]), int(part[a, 1]))
                if key != state.key:
                    yield from out(state.close(False))
                    state.key = key
                yield from out(state.run(part[a:b]))
        yield from out(state.close(True))

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row, pos) of each line that goes."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    # the ranges are found by a pass over the rows: over these, not over the texts again
    dealt = cut(occurrences(docs, min_chars)).repartitionByRange(parts, *order).sortWithinPartitions(*order, "row", "pos")
    found = cut(dealt.mapInArrow(_stream(min_docs), _ROW))
    # an open key has an edge row from each partition that it touches: two a partition at most
    edges = found.where(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("top").alias("most")).where(F.col("docs") >= min_docs)
    open_ = found.where(F.col("kind") == _OPEN).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("doc") != F.col("most"))
    settled = found.where(F.col("kind") == _DROP)
    return open_.select("doc", "row", "pos").union(settled.select("doc", "row", "pos"))


def _bitmaps(batches):
    for batch in batches:
        n = batch.column("n_lines").to_pylist()
        out = []
        for lines, gone in zip(n, batch.column("gone"), strict=True):
            at = gone.values
            if at is None or not len(at):
                out.append(None)
                continue
            bits = np.ones(lines, dtype=np.uint8)
            bits[at.to_numpy(zero_copy_only=False)] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), batch.column("n_lines"), pa.array(out, pa.binary())], names=["doc", "row", "n_lines", "keep"])


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per distinct row: doc (NO_ID for a null doc_id), row (hash of its text), n_lines, keep.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all their lines but those of the largest
    doc_id. ``keep`` is a zlib-compressed bitmap, first line in the highest
    bit, 1 for lines that stay; null where all stay.

    Null or empty text: one empty line. Null doc_id: one document, smaller
    than all others. Rows of one doc_id are one document: a key in several of
    them counts once, and in the largest doc_id stays in all of them.
    """
    docs = text_rows(docs)
    gone = dropped_lines(docs, min_chars, min_docs).distinct().groupBy("doc", "row").agg(F.collect_list("pos").alias("gone"))
    lines = docs.select(known_id(F.col("doc_id")).alias("doc"), row_in(F.col("text")).alias("row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines")).dropDuplicates(["doc", "row"])
    return lines.join(gone, ["doc", "row"], "left").mapInArrow(_bitmaps, "doc long, row long, n_lines int, keep binary")


RESERVED = {"doc_id", "text", "keep", "kept_text", "n_lines", "n_dropped", "kept_sha256", "__doc", "__row"}


def _kept(batches):
    for batch in batches:
        texts, dropped, shas, n = [], [], [], []
        for t, keep in zip(batch.column("text"), batch.column("keep"), strict=True):
            t, keep = t.as_py() or "", keep.as_py()
            lines = t.split("\n")
            n.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
                kept = [x for x, b in zip(lines, bits, strict=True) if b]
                t = "\n".join(kept)
                dropped.append(len(lines) - len(kept))
            else:
                dropped.append(0)
            texts.append(t)
            shas.append(hashlib.sha256(t.encode()).hexdigest())
        kept_text = pa.array(texts, pa.string())
        extra = [batch.column(c) for c in batch.schema.names if c not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays([*extra, kept_text, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())], names=[*(c for c in batch.schema.names if c not in ("text", "keep")), "kept_text", "n_lines", "n_dropped", "kept_sha256"])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies ``line_keep_bitmaps`` to the texts: doc_id, columns named in ``carry``, kept_text, n_lines, n_dropped, kept_sha256.

    A row per row of ``docs``; a null text counts as one empty line. Columns
    not named in ``carry`` are ignored; ``carry`` may not name a column that
    is returned anyway or made on the way (ValueError).
    """
    if clash := RESERVED & {c.lower() for c in carry}:
        raise ValueError(f"carry can't name {sorted(clash)}")
    bitmaps = line_keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), "keep")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows = rows.withColumns({"__doc": known_id(F.col("doc_id")), "__row": row_in(F.col("text"))})
    joined = rows.join(bitmaps, ["__doc", "__row"], "left").drop("__doc", "__row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "keep"))
    return joined.mapInArrow(_kept, f"{kinds}, kept_text string, n_lines long, n_dropped long, kept_sha256 string")
