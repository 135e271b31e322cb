"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words.

Texts are dealt to groups by a hash of id and text; a group is one task's work.

1. A group hashes all its windows and sends each distinct hash once, with a
   mark where several of its documents hold it, to the bucket of the hash's
   top bits: 4 bytes a window, no ids. A bucket counts the groups of each hash
   and answers every group with those of its hashes that occur again. So a hot
   window is one entry a group.
2. Only these candidates are read as words: a group sends the BLAKE2b digest of
   each distinct one with the smallest document that holds it. A bucket finds
   the smallest document of all and answers the groups that hold larger ones.
   Windows are the same when their digests (96 bits) are; a rolling hash alone
   removes nothing.
3. The answers meet the texts, whose repeated windows merge into maximal
   removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_id, groups_for, known_id, window_hashes, word_hashes, word_spans

LOW = 32
"""Bits of a hash that travel; its bucket stands for the top bits. A bucket gets about 2**20 windows, so one in 2**12 is read in vain."""
SLICE = 1 << 21
"""Bytes of text whose windows are hashed at once."""
_candidate = np.dtype([("doc", "<i8"), ("key", "<u8"), ("d0", "<u8"), ("d1", "<u4"), ("many", "?"), ("only", "?")])
"""Smallest document of a group that holds a window; top and low bits of its hash; its digest; whether other documents of the group hold it; whether no other window of the group has its hash."""
_owner = np.dtype([("doc", "<i8"), ("key", "<u8"), ("d0", "<u8"), ("d1", "<u4"), ("only", "?")])
_PACK = "bucket long, grp long, part binary"
_pack_schema = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("part", pa.binary())])


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        edges = np.flatnonzero(x[1:] != x[:-1]) + 1
        yield from zip([0, *edges], [*edges, len(x)], strict=True)


def _table(out: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _pack_schema.types, strict=True)], schema=_pack_schema)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte plane by byte plane: the empty planes of small differences compress away."""
    steps = np.diff(keys.astype(np.int64), prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64)


def pack_columns(records: np.ndarray) -> bytes:
    """A record array column by column."""
    return b"".join(np.ascontiguousarray(records[c]).tobytes() for c in records.dtype.names)


def unpack_columns(data: bytes, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(data) // kind.itemsize, dtype=kind)
    at = 0
    for c in kind.names:
        out[c] = np.frombuffer(data, kind[c], len(out), at)
        at += len(out) * kind[c].itemsize
    return out


def _texts(docs: pa.Table) -> Iterator[tuple[int, bytes]]:
    for batch in docs.to_batches():
        texts = batch.column("text").cast(pa.large_binary())
        for i, t in zip(batch.column("doc").to_pylist(), texts, strict=True):
            yield i, t.as_py() or b""


def _keys(docs: pa.Table, width: int, bits: int) -> Iterator[tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]]:
    """About SLICE bytes at a time: documents and texts, number of windows of each, top and low bits of the windows' hashes."""
    held, size = [], 0

    def hashed():
        words, at = word_hashes(b"\n".join(t for _, t in held))
        begin = np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for _, t in held)]))
        n = np.maximum(0, np.diff(begin) - width + 1)
        inside = np.repeat(begin[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return held, n, (window_hashes(words, width) >> np.uint64(64 - bits - LOW))[inside]

    for x in _texts(docs):
        held.append(x)
        size += len(x[1]) + 1
        if size >= SLICE:
            yield hashed()
            held, size = [], 0
    if held:
        yield hashed()


class _Table:
    """A sorted table of keys, with a bitmap of their top bits that settles most other values."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.down = keys, np.uint64(max(0, bits + LOW - 22))
        self.some = np.zeros(1 << 22, dtype=bool)
        self.some[(keys >> self.down).astype(np.int64)] = True

    def held(self, values: np.ndarray) -> np.ndarray:
        """Where in ``values`` the keys are."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64)
        may = np.flatnonzero(self.some[(values >> self.down).astype(np.int64)])
        found = values[may]
        return may[self.keys[np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)] == found]


def _by_text(hit: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Of windows ``hit``: the text, its part of ``hit``, and the words at which they begin there."""
    first = np.cumsum(n) - n
    owner = np.searchsorted(np.cumsum(n), hit, "right")
    for a, b in _runs(owner):
        k = int(owner[a])
        yield k, a, b, hit[a:b] - first[k]


def _digests(text: bytes, at: np.ndarray, width: int) -> np.ndarray:
    """12 bytes for each window that begins at a word of ``at``: [i, 0] a 64-bit, [i, 1] a 32-bit number."""
    words = text.split()
    ends = np.cumsum([len(w) + 1 for w in words])
    plain = memoryview(b" ".join(words))
    first = np.concatenate(([0], ends))[at].tolist()
    last = (ends[at + width - 1] - 1).tolist()
    raw = b"".join([hashlib.blake2b(plain[a:b], digest_size=12).digest() for a, b in zip(first, last, strict=True)])
    return np.frombuffer(raw, dtype=[("d0", "<u8"), ("d1", "<u4")])


def _counted(width: int, bits: int):
    """Distinct window hashes of a group, for their buckets."""

    def run(docs: pa.Table) -> pa.Table:
        group, out = docs.column("grp")[0].as_py(), []
        found = [([i for i, _ in held], n, keys) for held, n, keys in _keys(docs, width, bits)]
        if not any(len(k) for _, _, k in found):
            return _table([])
        keys = np.concatenate([k for _, _, k in found])
        doc = np.repeat(np.array([i for ids, _, _ in found for i in ids]), np.concatenate([n for _, n, _ in found]))
        order = np.argsort(keys)
        keys, doc = keys[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        keys = keys[first]
        for a, b in _runs(keys >> np.uint64(LOW)):
            low = keys[a:b] & np.uint64(2**LOW - 1)
            out.append((int(keys[a]) >> LOW, group, np.uint32(b - a).tobytes() + pack_sorted(low) + np.packbits(many[a:b]).tobytes()))
        return _table(out)

    return run


def _again(table: pa.Table) -> pa.Table:
    """Of one bucket: each group's hashes that several documents hold."""
    bucket, got = table.column("bucket")[0].as_py(), []
    for g, p in zip(table.column("grp").to_pylist(), table.column("part"), strict=True):
        p = p.as_py()
        n = int(np.frombuffer(p, "<u4", 1)[0])
        got.append((g, unpack_sorted(p[4 : 4 + 4 * n]), np.unpackbits(np.frombuffer(p, np.uint8, offset=4 + 4 * n), count=n).astype(bool)))
    low = np.concatenate([x[1] for x in got])
    many = np.concatenate([x[2] for x in got])
    order = np.argsort(low, kind="stable")
    same = np.zeros(len(low), dtype=bool)
    equal = low[order][1:] == low[order][:-1]
    same[order[1:]] = equal
    same[order[:-1]] |= equal
    same |= many
    out, at = [], 0
    for g, own, _ in got:
        mine = own[same[at : at + len(own)]]
        at += len(own)
        if len(mine):
            out.append((bucket, g, pack_sorted(mine)))
    return _table(out)


def _read(width: int, bits: int):
    """Digests of a group's candidate windows, for their buckets."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table([])
        group = docs.column("grp")[0].as_py()
        wanted = [unpack_sorted(p.as_py()) | np.uint64(b << LOW) for b, p in zip(answers.column("bucket").to_pylist(), answers.column("part"), strict=True)]
        wanted = _Table(np.sort(np.concatenate(wanted)), bits)
        found = []
        for held, n, keys in _keys(docs, width, bits):
            hit = wanted.held(keys)
            x = np.empty(len(hit), dtype=_candidate)
            x["key"], x["many"], x["only"] = keys[hit], False, False
            for k, a, b, at in _by_text(hit, n):
                d = _digests(held[k][1], at, width)
                x["doc"][a:b], x["d0"][a:b], x["d1"][a:b] = held[k][0], d["d0"], d["d1"]
            found.append(x)
        x = np.concatenate(found)
        if not len(x):
            return _table([])
        x = x[np.lexsort((x["doc"], x["d1"], x["d0"], x["key"]))]
        first = _firsts(x)
        many = np.maximum.reduceat(x["doc"], first) > x["doc"][first]
        x = x[first]
        x["many"] = many
        same = x["key"][1:] == x["key"][:-1]
        x["only"] = ~(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        # as the documents go, so that equal ids compress away
        x = x[np.lexsort((x["key"], x["doc"], x["key"] >> np.uint64(LOW)))]
        return _table([(int(x["key"][a]) >> LOW, group, pack_columns(x[a:b])) for a, b in _runs(x["key"] >> np.uint64(LOW))])

    return run


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new window begins in records sorted by key and digest."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["d0"][1:] != x["d0"][:-1]) | (x["d1"][1:] != x["d1"][:-1])
    return np.flatnonzero(new)


def _smallest(table: pa.Table) -> pa.Table:
    """Of one bucket: the smallest document of each window, for the groups in which a larger one holds it too."""
    bucket = table.column("bucket")[0].as_py()
    got = [unpack_columns(p.as_py(), _candidate) for p in table.column("part")]
    group = np.repeat(np.array(table.column("grp").to_pylist()), [len(x) for x in got])
    x = np.concatenate(got)
    order = np.lexsort((x["doc"], x["d1"], x["d0"], x["key"]))
    x, group = x[order], group[order]
    first = _firsts(x)
    size = np.diff(np.append(first, len(x)))
    least = np.repeat(x["doc"][first], size)
    goes = (x["doc"] > least) | x["many"]
    out = np.empty(int(goes.sum()), dtype=_owner)
    out["doc"] = least[goes]
    for c in ("key", "d0", "d1", "only"):
        out[c] = x[c][goes]
    group = group[goes]
    order = np.lexsort((out["key"], out["doc"], group))
    out, group = out[order], group[order]
    return _table([(bucket, int(group[a]), pack_columns(out[a:b])) for a, b in _runs(group)])


def _owners(owners: np.ndarray, keys: np.ndarray, text: bytes, at: np.ndarray, width: int) -> np.ndarray:
    """The smallest document of each window (``keys``, at the words ``at`` of ``text``) in ``owners``, which is sorted by key; the largest number if it isn't there.

    Where a key stands for one window of the group alone, it has been verified; others are told apart by their digests.
    """
    out = np.full(len(keys), np.iinfo(np.int64).max)
    place = np.searchsorted(owners["key"], keys)
    only = owners["only"][place]
    out[only] = owners["doc"][place[only]]
    rest = np.flatnonzero(~only)
    if len(rest):
        digests = _digests(text, at[rest], width)
        place, end = place[rest], np.searchsorted(owners["key"], keys[rest], "right")
        while len(open_ := np.flatnonzero(place < end)):
            x = owners[place[open_]]
            same = (x["d0"] == digests["d0"][open_]) & (x["d1"] == digests["d1"][open_])
            out[rest[open_[same]]] = x["doc"][same]
            place[open_] += 1
    return out


KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept_text string, kept_sha256 string"
_span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_kept_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_span)), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _apply(width: int, bits: int, with_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        owners = np.concatenate([np.empty(0, dtype=_owner), *(unpack_columns(p.as_py(), _owner) for p in answers.column("part"))])
        owners = owners[np.argsort(owners["key"], kind="stable")]
        table, rows = _Table(owners["key"], bits), []
        for held, n, keys in _keys(docs, width, bits):
            hit = table.held(keys)
            goes = {}
            for k, a, b, at in _by_text(hit, n):
                at = at[_owners(owners, keys[hit[a:b]], held[k][1], at, width) < held[k][0]]
                if len(at):
                    goes[k] = at
            for k, (doc, text) in enumerate(held):
                words = text.split()
                n_words, spans = len(words), []
                if k in goes:
                    change = np.zeros(n_words + 1, dtype=np.int64)
                    np.add.at(change, goes[k], 1)
                    np.add.at(change, goes[k] + width, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    s, e = word_spans((~gone).astype(np.uint8), np.array([False, True]))
                    spans = [{"first": int(a), "last": int(b)} for a, b in zip(s, e, strict=True)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                whole = kept.decode("utf-8", "replace") if with_text else None
                rows.append((given_id(doc), n_words, n_words - len(words), spans, whole, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_kept_schema.types)], schema=_kept_schema)

    return run


def drop_repeated_windows(docs: DataFrame, width: int = 50, with_text: bool = True) -> DataFrame:
    """Removes each word in a window that also starts in a document of smaller id.

    Returns a row per row of ``docs``: doc_id, n_words, n_removed, spans
    (maximal removed runs of words, last not included), kept_text (null
    unless ``with_text``; bytes that are no UTF-8 are replaced there, not in
    the hash), kept_sha256.

    Null or empty text: no words. Null doc_id: one document, smaller than all
    others. Rows of one doc_id are one document, so their windows never
    remove each other's; they are dealt by their texts, so many rows of one id
    (or of none) don't meet in one task. Texts of any length are judged whole;
    one text must fit a task. Other columns are ignored. Empty table: no rows.
    """
    rows = docs.select(known_id(F.col("doc_id")).alias("doc"), F.col("text").cast("string").alias("text"))
    groups = groups_for(rows, 4)
    bits = groups.bit_length() - 1
    dealt = rows.withColumn("grp", F.xxhash64("doc", "text").bitwiseAND(F.lit(groups - 1)))
    counted = dealt.groupBy("grp").applyInArrow(_counted(width, bits), _PACK)
    again = counted.groupBy("bucket").applyInArrow(_again, _PACK)
    read = dealt.groupBy("grp").cogroup(again.groupBy("grp")).applyInArrow(_read(width, bits), _PACK)
    smallest = read.groupBy("bucket").applyInArrow(_smallest, _PACK)
    return dealt.groupBy("grp").cogroup(smallest.groupBy("grp")).applyInArrow(_apply(width, bits, with_text), KEPT)
