"""Exact removal of repeated byte strings with suffix arrays over content-dealt shards.

Every string of ``width`` bytes is assigned to its anchor: the smallest hash
of its ANCHOR-byte parts, leftmost if tied, which depends on nothing outside
the string. So equal strings share an anchor.

1. Texts are dealt to groups by a hash of id and text. A group sends each of
   its anchors once, with the number of its places, to the bucket of the
   anchor's hash; the bucket answers with the anchors that occur again. So an
   anchor in every text is one entry a group.
2. The strings of such an anchor at one place overlap into one region of text.
   Equal regions of one anchor repeat as a whole. The distinct rest meets in
   the shard of its anchor, where a suffix array built by induced sorting and
   its permuted common prefixes tell which strings occur again.
3. The regions of an anchor with more than HOT places would be one unbounded
   group. Its strings are dealt out singly by their 128-bit BLAKE2b digests
   instead, each once a group, and those of which there are two go.
4. The answers meet the texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, given_id, groups_for, known_id, mix, prefix_hashes, span_hashes
from .substrings import _runs
from .suffixes import permuted_prefixes, suffix_array

ANCHOR = 64
HOT = 1024
SLICE = 1 << 21
BATCH = 1 << 19
_place = np.dtype([("row", "<i8"), ("first", "<u4"), ("count", "<u4"), ("anchor", "<u4")])
"""Text, first start, number of starts, place of the anchor."""
_held = np.dtype([("hash", "<u8"), *_place.descr])
_window = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("row", "<i8"), ("at", "<u4"), ("many", "?")])
"""Digest of a string, a text and place that hold it, whether the group holds it elsewhere too."""
_flag = np.dtype([("row", "<i8"), ("first", "<u4"), ("count", "<u4")])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum by doubling."""
    out, done = v, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _pieces(rows, texts: list[bytes], width: int) -> Iterator[tuple[list, bytes]]:
    """(row, offset in its text, start in the piece, length) of texts long enough, SLICE bytes at a time; long texts are cut with an overlap."""
    held, parts, size = [], [], 0
    for row, t in zip(rows, texts, strict=True):
        for a in range(0, max(1, len(t) - width + 1), SLICE) if len(t) >= width else ():
            part = t[a : a + SLICE + width - 1]
            held.append((row, a, size, len(part)))
            parts.append(part)
            size += len(part)
            if size >= SLICE:
                yield held, b"".join(parts)
                held, parts, size = [], [], 0
    if held:
        yield held, b"".join(parts)


def anchored(held: list, data: bytes, width: int) -> np.ndarray:
    """Records of _held: runs of string starts with one anchor."""
    buf = np.frombuffer(data, dtype=np.uint8)
    p = prefix_hashes(_BYTES[buf])
    at = np.arange(len(buf) - ANCHOR + 1)
    h = span_hashes(p, at, at + ANCHOR)
    low = np.uint64(2**24 - 1)
    best = (_least((h & ~low) | at.astype(np.uint64), width - ANCHOR + 1) & low).astype(np.int64)
    begin = np.array([x[2] for x in held])
    length = np.array([x[3] for x in held])
    valid = np.zeros(len(buf) + 1, dtype=np.int64)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + length - width + 1, -1)
    valid = np.cumsum(valid)[: len(best)] > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (best[1:] != best[:-1])
    fresh[begin[begin < len(best)]] = True
    first = np.flatnonzero(fresh & valid)
    edge = np.flatnonzero(np.concatenate((valid[:-1] & ~valid[1:], valid[-1:]))) + 1
    stop = np.minimum(np.append(first[1:], len(best)), edge[np.searchsorted(edge, first, "right")])
    owner = np.searchsorted(begin, first, "right") - 1
    shift = np.array([x[1] for x in held])[owner] - begin[owner]
    out = np.empty(len(first), dtype=_held)
    out["hash"], out["row"] = h[best[first]], np.array([x[0] for x in held], dtype=np.int64)[owner]
    out["first"], out["count"], out["anchor"] = first + shift, stop - first, best[first] + shift
    return out


def _rows(batch) -> tuple[list[int], list[bytes]]:
    return batch.column("row").to_pylist(), [t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())]


_PACK = "bucket long, part binary"
_pack_schema = pa.schema([("bucket", pa.int64()), ("part", pa.binary())])


def _packed(out: list[tuple[int, bytes]]) -> list[pa.Array]:
    return [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())]


def _by(key: np.ndarray, records: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    return [(int(key[a]), records[a:b].tobytes()) for a, b in _runs(key)]


def _anchors(width: int, bits: int):
    """Distinct anchors of a group and the number of their places, for their buckets."""

    def run(docs: pa.Table) -> pa.Table:
        group, found = docs.column("grp")[0].as_py(), [np.empty(0, dtype=np.uint64)]
        for held, data in _pieces(*_rows(docs), width):
            found.append(anchored(held, data, width)["hash"].copy())
        hashes, n = np.unique(np.concatenate(found), return_counts=True)
        records = np.empty(len(hashes), dtype=_count)
        records["hash"], records["n"] = hashes, n
        parts = _by(_bucket(hashes, bits), records)
        return pa.Table.from_arrays([*_packed(parts), pa.array([group] * len(parts), pa.int64())], schema=_count_schema)

    return run


_count = np.dtype([("hash", "<u8"), ("n", "<u4")])
_answer = np.dtype([("hash", "<u8"), ("hot", "?")])
_COUNT = f"{_PACK}, grp long"
_count_schema = _pack_schema.append(pa.field("grp", pa.int64()))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Of mixed hashes: those of anchors are small ones."""
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _group(row: np.ndarray, groups: int) -> np.ndarray:
    return row & (groups - 1)  # rows are hashes


def _repeated(most: int):
    """Of one bucket: each group's anchors with several places anywhere; hot ones have more than ``most``."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), dtype=_count) for x in table.column("part")]
        found = np.concatenate(parts)
        _, inverse = np.unique(found["hash"], return_inverse=True)
        total = np.bincount(inverse, found["n"])[inverse]
        group = np.repeat(np.array(table.column("grp").to_pylist()), [len(x) for x in parts])
        again = total > 1
        answers = np.empty(int(again.sum()), dtype=_answer)
        answers["hash"], answers["hot"] = found["hash"][again], total[again] > most
        return pa.Table.from_arrays(_packed(_by(group[again], answers)), schema=_pack_schema)

    return run


def _all_starts(x) -> tuple:
    return int(x["row"]), int(x["first"]), int(x["count"])


def _regions(width: int, bits: int, groups: int):
    """(bucket, part): 0 and more: windows of hot anchors; -1 - group: settled; from 1 << 40 on: regions of an anchor's shard."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not docs.num_rows:
            return pa.Table.from_arrays(_packed([]), schema=_pack_schema)
        wanted = np.concatenate([np.frombuffer(x.as_py(), dtype=_answer) for x in answers.column("part")])
        wanted = wanted[np.argsort(wanted["hash"])]
        rows, whole = _rows(docs)
        texts = dict(zip(rows, whole, strict=True))
        out: list[tuple[int, bytes]] = []
        settled: list[tuple] = []
        shards: dict[int, dict[tuple[int, bytes], list]] = {}
        hot: dict[bytes, list] = {}
        for held, data in _pieces(rows, whole, width):
            places = anchored(held, data, width)
            k = np.minimum(np.searchsorted(wanted["hash"], places["hash"]), len(wanted) - 1)
            again = wanted["hash"][k] == places["hash"]
            places, is_hot = places[again], wanted["hot"][k[again]]
            for x, many, shard in zip(places, is_hot.tolist(), _bucket(places["hash"], bits).tolist(), strict=True):
                row, first, count = at = _all_starts(x)
                region = texts[row][first : first + count + width - 1]
                if many:
                    hot.setdefault(region, []).append(at)
                else:
                    shards.setdefault(shard, {}).setdefault((int(x["hash"]), region), []).append(at)
        if hot:
            w = np.concatenate([_windows(region, at, width) for region, at in hot.items()])
            settled += [a for at in hot.values() if len(at) > 1 for a in at]
            w = w[np.lexsort((w["d1"], w["d0"]))]
            first = np.flatnonzero(np.concatenate(([True], (w["d0"][1:] != w["d0"][:-1]) | (w["d1"][1:] != w["d1"][:-1]))))
            n = np.diff(np.append(first, len(w)))
            again = w[np.repeat(n > 1, n) & ~w["many"]]
            settled += list(zip(again["row"].tolist(), again["at"].tolist(), [1] * len(again), strict=True))
            many = np.logical_or.reduceat(w["many"], first) | (n > 1)
            w = w[first]
            w["many"] = many
            out += _by(_bucket(w["d0"], bits), w)
        for shard, regions in shards.items():
            parts = []
            for (h, region), at in regions.items():
                if len(at) > 1:
                    settled += at
                row, first, count = at[0]
                parts.append(np.array([(h, row, first, count, len(at) > 1)], dtype=_region).tobytes() + region)
            out.append((shard + (1 << 40), b"".join(parts)))
        if settled:
            flags = np.array(settled, dtype=_flag)
            out += [(-1 - g, part) for g, part in _by(_group(flags["row"], groups), flags)]
        return pa.Table.from_arrays(_packed(out), schema=_pack_schema)

    return run


def _windows(region: bytes, at: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """Digests of all strings of a hot anchor's region."""
    row, first, count = at[0]
    data = memoryview(region)
    raw = b"".join([hashlib.blake2b(data[k : k + width], digest_size=16).digest() for k in range(count)])
    d = np.frombuffer(raw, dtype=[("d0", "<u8"), ("d1", "<u8")])
    w = np.empty(count, dtype=_window)
    w["d0"], w["d1"], w["row"], w["at"], w["many"] = d["d0"], d["d1"], row, first + np.arange(count), len(at) > 1
    return w


_region = np.dtype([("hash", "<u8"), ("row", "<i8"), ("first", "<u4"), ("count", "<u4"), ("many", "?")])


def repeated_starts(regions: list[bytes], width: int) -> list[np.ndarray]:
    """Starts in each region of strings of ``width`` bytes that start anywhere else in the regions, from one suffix array over all."""
    lengths = np.array([len(r) for r in regions])
    begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    text = np.zeros(int(lengths.sum()) + len(regions), dtype=np.int16)
    flat = np.concatenate([np.frombuffer(r, dtype=np.uint8) for r in regions]).astype(np.int16)
    inside = np.ones(len(text), dtype=bool)
    inside[begin + lengths] = False
    text[inside] = flat + 1
    sa = suffix_array(text)
    # bytes for the comparison: the separator is no byte of UTF-8
    phi, lcp = permuted_prefixes(np.where(inside, text - 1, 255).astype(np.uint8), sa, begin)
    room = np.repeat(begin + lengths, lengths + 1) - np.arange(len(text))
    twice = np.flatnonzero((lcp >= width) & (room >= width) & (phi >= 0))
    hit = np.zeros(len(text), dtype=bool)
    hit[twice] = hit[phi[twice]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]


def _shards(width: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [x.as_py() for x in table.column("part")]
        flags: list = []
        if bucket < 0:
            return pa.Table.from_arrays(_packed([(-1 - bucket, p) for p in parts]), schema=_pack_schema)
        if bucket < 1 << 40:
            w = np.concatenate([np.frombuffer(p, dtype=_window) for p in parts])
            w = w[np.lexsort((w["d1"], w["d0"]))]
            equal = (w["d0"][1:] == w["d0"][:-1]) & (w["d1"][1:] == w["d1"][:-1])
            w = w[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]
            w = w[~w["many"]]
            found = np.empty(len(w), dtype=_flag)
            found["row"], found["first"], found["count"] = w["row"], w["at"], 1
        else:
            anchors: dict[int, dict[bytes, list]] = {}
            for p in parts:
                at = 0
                while at < len(p):
                    x = np.frombuffer(p, dtype=_region, count=1, offset=at)[0]
                    at += _region.itemsize
                    n = int(x["count"]) + width - 1
                    anchors.setdefault(int(x["hash"]), {}).setdefault(p[at : at + n], []).append((*_all_starts(x), bool(x["many"])))
                    at += n
            batch, size = [], 0
            for regions in anchors.values():
                for at in regions.values():
                    if len(at) > 1:
                        flags += [a[:3] for a in at if not a[3]]
                if len(regions) > 1:
                    batch += regions.items()
                    size += sum(map(len, regions))
                if size >= BATCH:
                    flags += _batch(batch, width)
                    batch, size = [], 0
            flags += _batch(batch, width)
            found = np.array(flags, dtype=_flag) if flags else np.empty(0, dtype=_flag)
        return pa.Table.from_arrays(_packed(_by(_group(found["row"], groups), found)), schema=_pack_schema)

    return run


def _batch(batch: list, width: int) -> list:
    out = []
    if batch:
        for starts, (_, at) in zip(repeated_starts([r for r, _ in batch], width), batch, strict=True):
            if len(at) == 1 and not at[0][3] and len(starts):  # else all of it has gone
                cuts = np.flatnonzero(np.diff(starts) > 1) + 1
                out += [(at[0][0], at[0][1] + int(s[0]), len(s)) for s in np.split(starts, cuts)]
    return out


SPANS = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,last:long>>, kept_text binary, kept_sha256 string"
_span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_spans_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(_span)), ("kept_text", pa.binary()), ("kept_sha256", pa.string())])


def _apply(width: int, with_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        flags = np.concatenate([np.empty(0, dtype=_flag), *(np.frombuffer(x.as_py(), dtype=_flag) for x in answers.column("part"))])
        flags = flags[np.lexsort((flags["first"], flags["row"]))]
        starts = {int(flags["row"][a]): (a, b) for a, b in _runs(flags["row"])}
        out = []
        ids = docs.column("doc").to_pylist()
        for i, row, text in zip(ids, *_rows(docs), strict=True):
            spans, kept = [], text
            if row in starts:
                f = flags[slice(*starts[row])]
                first, last = f["first"].astype(np.int64), f["first"].astype(np.int64) + f["count"] + width - 1
                far = np.maximum.accumulate(last)
                new = np.flatnonzero(np.concatenate(([True], first[1:] > far[:-1])))
                spans = list(zip(first[new].tolist(), far[np.append(new[1:], len(far)) - 1].tolist(), strict=True))
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((row, given_id(i), len(text), len(text) - len(kept), len(spans), [{"first": a, "last": b} for a, b in spans], kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(_spans_schema.types)], schema=_spans_schema)

    return run


def drop_repeated_bytes(docs: DataFrame, width: int = 400, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """Removes each byte in a string of ``width`` bytes that also starts anywhere else, in this or another text.

    Returns a row per row of ``docs``: row (hash of id and text), doc_id,
    n_bytes, n_removed, n_spans, spans (removed runs, last byte not included;
    runs that touch are one), kept_text (bytes: a cut may split a character;
    null unless ``with_text``), kept_sha256. Strings are judged on the input.

    Null or empty text: no bytes. Repeated rows are texts of their own, so
    they repeat each other. One text must fit a task. Other columns are
    ignored. Empty table: no rows.
    """
    if width < 2 * ANCHOR:
        raise ValueError(f"width must be {2 * ANCHOR} at least")
    rows = docs.select(known_id(F.col("doc_id")).alias("doc"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc", "text"))
    groups = groups_for(rows, 4)
    bits = groups.bit_length() + 1  # four times as many shards
    dealt = rows.withColumn("grp", F.col("row").bitwiseAND(F.lit(groups - 1)))
    counts = dealt.groupBy("grp").applyInArrow(_anchors(width, bits), _COUNT)
    answers = counts.groupBy("bucket").applyInArrow(_repeated(hot), _PACK)
    by_group = lambda df: df.withColumnRenamed("bucket", "grp").groupBy("grp")
    regions = dealt.groupBy("grp").cogroup(by_group(answers)).applyInArrow(_regions(width, bits, groups), _PACK)
    flags = regions.groupBy("bucket").applyInArrow(_shards(width, groups), _PACK)
    return dealt.groupBy("grp").cogroup(by_group(flags)).applyInArrow(_apply(width, with_text), SPANS)
