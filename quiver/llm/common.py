"""Shared pieces: text slices, rolling hashes in numpy, cutting of lineage.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Rolling hashes
are 64-bit polynomials modulo 2**64 over randomised values with a final mix.
Modulo a power of two, certain strings of 1,024 values and more collide for
every base (complementary Thue-Morse strings), so words of over LONG bytes are
hashed by XXH64 instead, and nothing is removed by a rolling hash of words alone.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)
"""Stands for a null doc_id: one document, smaller than every other."""


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is
    set only where the session names none and runs on one machine, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def whole_row(df: DataFrame) -> Column:
    """A struct of all columns, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the rows' size, from file sizes; of rows that it knows nothing about, their texts' bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(size if isinstance(size, int) else size.toString())
    return size if size < 2**53 else df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def groups_for(df: DataFrame, mb: int = 8) -> int:
    """A power of two: groups of about ``mb`` MB of input each, 16 at least."""
    return 1 << max(4, int(np.ceil(np.log2(max(1, input_bytes(df) / (mb << 20))))))


def known_id(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    return _mix(np.asarray(x).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD1342543DE82EF95  # odd, 5 modulo 8: full period modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and base**-0..-n modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers = out[0], out[1]
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """p[i]: hash sum of values[:i]."""
    p = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], dtype=np.uint64, out=p[1:])
    return p


def span_hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _mix((p[ends] - p[starts]) * powers(len(p))[1][starts])


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    p = prefix_hashes(values)
    return _mix((p[width:] - p[:n]) * powers(len(p))[1][:n])


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True


def word_spans(buf: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    s = np.ones(len(buf) + 2, dtype=np.int8)
    s[1:-1] = space[buf]
    edges = np.flatnonzero(s[1:] != s[:-1])
    return edges[::2], edges[1::2]


PIECE = 1 << 17
LONG = 64


def word_hashes(text: bytes, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte offset of each word. Long texts go piece by piece."""
    buf = np.frombuffer(text, dtype=np.uint8)
    hashes, offsets, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf) and not space[buf[end]]:
            # a word goes on: to its end
            more = np.flatnonzero(space[buf[end : end + PIECE]])
            end = min(len(buf), end + (int(more[0]) if len(more) else PIECE))
        part = buf[at:end]
        starts, ends = word_spans(part, space)
        h = span_hashes(prefix_hashes(_BYTES[part]), starts, ends)
        for k in np.flatnonzero(ends - starts > LONG).tolist():
            h[k] = xxhash.xxh64_intdigest(part[starts[k] : ends[k]])
        hashes.append(h)
        offsets.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids (NO_ID for null) and texts (empty for null) of rows, about ``limit`` bytes at a time."""
    ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    texts, size, first = [], 0, 0
    for i, t in enumerate(batch.column("text").cast(pa.large_binary())):
        texts.append(t.as_py() or b"")
        size += len(texts[-1]) + 64
        if size >= limit:
            yield ids[first : i + 1], texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield ids[first:], texts


def slice_words(texts: list[bytes], space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin (one entry more at the end)."""
    h, at = word_hashes(b"\n".join(texts), space)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(at, offsets)


def text_rows(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def given_id(i: int) -> int | None:
    return None if i == NO_ID else int(i)


def row_in(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)
