"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments A and B (23 bits each) and C (18
bits). The perfect (23, 12) Golay code gives every segment value one codeword
within distance 3. K(x) holds the codeword indices of all values at most one
bit from x: one to six. Two values at most two bits apart share an index,
that of a value between them. Fingerprints at most three bits apart, with a,
b, c errors in the segments, share at least one of these keys:

- a = 0, b <= 2: A and an index of K(B);         a = 0, b = 3: A and C
- b = 0, a <= 2: B and an index of K(A);         b = 0, a = 3: B and C
- a, b >= 1, c = 0: indices of K(A) and K(B), C
- a = b = c = 1: an exact half of each of A, B, C

Every key has 32 bits of the fingerprint or more. Only distinct fingerprints
are joined; each key's group gives a spanning forest of its links.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, known_id, slices, text_rows, whole_row
from .components import components

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainders(values: np.ndarray) -> np.ndarray:
    """Syndromes: 23-bit values modulo the generator."""
    x = values.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GENERATOR << (bit - 11))
    return x


@functools.cache
def _near() -> np.ndarray:
    """[syndrome, j]: error patterns whose removal gives a codeword within one flip more than the perfect radius; padded with the first."""
    flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    patterns = flips
    for _ in range(2):
        patterns = np.unique(patterns[:, None] ^ flips[None, :])
    leader = np.empty(2048, dtype=np.int64)
    leader[_remainders(patterns)] = patterns  # 2048 patterns of weight 3 at most, one for each syndrome
    rows = []
    for s in range(2048):
        found = np.unique(leader[_remainders(flips) ^ s] ^ flips)
        rows.append(np.concatenate((found, np.repeat(found[:1], 6 - len(found)))))
    return np.array(rows)


def indices(segment: np.ndarray) -> np.ndarray:
    """K of 23-bit values: an array (n, 6) of 12-bit codeword indices, the first repeated to fill rows."""
    segment = segment.astype(np.int64)
    return (segment[:, None] ^ _near()[_remainders(segment)]) >> 11


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys."""
    f = fingerprints.view(np.uint64)
    a, b, c = ((f >> np.uint64(s) & np.uint64(2**w - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
    ka, kb = indices(a), indices(b)
    out = [(ka[:, :, None] << 12 | kb[:, None, :]).reshape(len(f), 36) << 18 | c[:, None], (1 << 58) | (a[:, None] << 12 | kb), (2 << 58) | (b[:, None] << 12 | ka), ((3 << 58) | a << 18 | c)[:, None], ((4 << 58) | b << 18 | c)[:, None]]
    half = ((a & 0xFFF, a >> 12), (b & 0xFFF, b >> 12), (c & 0x1FF, c >> 9))
    for pick in range(8):
        x, y, z = (half[i][pick >> i & 1] for i in range(3))
        out.append(((5 << 58) | pick << 40 | x << 21 | y << 9 | z)[:, None])
    keyed = np.sort(np.concatenate(out, axis=1), axis=1)
    fresh = np.concatenate((np.ones((len(f), 1), dtype=bool), keyed[:, 1:] != keyed[:, :-1]), axis=1)
    return np.nonzero(fresh)[0], keyed[fresh]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the XXH64 hashes (seed 42) of the word shingles; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(line[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch):
                f = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f, pa.int64())], names=["doc", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc, fp) per row; doc is NO_ID for a null doc_id."""
    return text_rows(docs).mapInArrow(_fingerprints(shingle), "doc long, fp long")


def _keyed(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for i in range(0, len(fp), 4096):
            part = fp[i : i + 4096]
            row, key = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part[row], pa.int64())], names=["key", "fp"])


def _distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def spanning_forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges joining what chains of distances up to ``most`` join: breadth first over what no tree holds yet."""
    out, left = [], np.sort(fps)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _distance(left, x) <= most
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
                left = left[~near]
    return out


def _links(most: int):
    def run(batches):
        held_key, held = None, []

        def flush(key, fps):
            """Runs of equal keys: pairs all at once, larger ones one by one."""
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
            n = ends - starts
            two = starts[n == 2]
            two = two[_distance(fps[two], fps[two + 1]) <= most]
            found = [(fps[two], fps[two + 1])]
            for a, b in zip(starts[n > 2].tolist(), ends[n > 2].tolist(), strict=True):
                if e := spanning_forest(fps[a:b], most):
                    found.append(tuple(np.array(e, dtype=np.int64).T))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fps = (batch.column(c).to_numpy() for c in ("key", "fp"))
            if held and key[0] != held_key:
                yield flush(np.full(sum(map(len, held)), held_key), np.concatenate(held))
                held = []
            last = int(np.searchsorted(key, key[-1]))
            if last:
                first = int(np.searchsorted(key, key[0], "right")) if held else 0
                if held:
                    held.append(fps[:first])
                    yield flush(np.full(sum(map(len, held)), held_key), np.concatenate(held))
                    held = []
                if first < last:
                    yield flush(key[first:last], fps[first:last])
            held_key = key[-1]
            held.append(fps[last:].copy())
        if held:
            yield flush(np.full(sum(map(len, held)), held_key), np.concatenate(held))

    return run


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b), a < b, over distinct fingerprints ``fp``; their components are those of all pairs at most ``most`` (0 to 3) bits apart."""
    if not 0 <= most <= 3:
        raise ValueError("the keys find up to 3 differing bits")
    keyed = fps.select("fp").distinct().mapInArrow(_keyed, "key long, fp long")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links(most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc, fp, component_id) per row of ``docs``: fingerprints link at ``most`` differing bits or fewer.

    component_id is the smallest doc_id reachable over links. Null or empty
    text, or one without words: fingerprint zero, linked like any other.
    Fewer words than ``shingle``: one shingle of all. Null doc_id: NO_ID, one
    document, smaller than all others. Repeated rows keep their rows.
    """
    found = cut(fingerprints(docs, shingle))
    roots = components(links(found, most))
    least = found.groupBy("fp").agg(F.min("doc").alias("doc"))
    least = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    tops = least.groupBy("root").agg(F.min("doc").alias("component_id"))
    return found.join(least.select("fp", "root").join(tops, "root").select("fp", "component_id"), "fp")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, all columns kept.

    Of rows with one doc_id, the one of the smallest text hash stays; of those
    of one text, the one whose JSON is smallest.
    """
    stay = near_duplicates(docs, shingle, most).where(F.col("doc") == F.col("component_id")).select(F.col("doc").alias("__doc")).distinct()
    rows = docs.select(known_id(F.col("doc_id")).alias("__doc"), F.xxhash64("text").alias("__hash"), whole_row(docs).alias("__row")).join(stay, "__doc", "left_semi")
    return rows.groupBy("__doc").agg(F.min_by("__row", F.struct("__hash", F.to_json("__row"))).alias("__row")).select("__row.*")
