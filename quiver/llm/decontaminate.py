"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. Documents and benchmark
items share seeds of ``least`` tokens; only items with a shared seed are
tiled against a document, and only the document's tokens inside seeds can be
in a tile. Tiling marks the longest common runs first, none overlapping, by
Karp-Rabin hashes at falling lengths, so passages in another order count too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, free_names, known_id, slice_words, slices, text_rows, window_hashes, word_hashes

BLOCK = 4 << 20
"""Bytes of benchmark text in one broadcast; larger benchmarks go block by block."""

IS_BREAK = np.ones(256, dtype=bool)
IS_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the tokens; bytes from 128 on count as letters."""
    return word_hashes((text or "").lower().encode(), IS_BREAK)[0]


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in text, start in item, length) of greedy string tiles, longest first.

    At each length the windows of both sides that touch no marked token are
    joined by hash; of those that match, left to right in the item, each is
    marked if its tokens are still free. The next length is the longest match
    that is left.
    """
    free_t, free_i = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)
    tiles = []
    length = min(len(text), len(item))
    while length >= least:
        ht, hi = window_hashes(text, length), window_hashes(item, length)
        open_t = np.flatnonzero(_all_free(free_t, length))
        open_i = np.flatnonzero(_all_free(free_i, length))
        order = open_t[np.argsort(ht[open_t], kind="stable")]
        sorted_t = ht[order]
        for j in open_i.tolist():
            if not free_i[j : j + length].all():
                continue
            for at in order[np.searchsorted(sorted_t, hi[j]) : np.searchsorted(sorted_t, hi[j], "right")].tolist():
                if free_t[at : at + length].all() and np.array_equal(text[at : at + length], item[j : j + length]):
                    tiles.append((at, j, length))
                    free_t[at : at + length] = free_i[j : j + length] = False
                    break
        length = min(length - 1, _longest(text, item, free_t, free_i, least, length - 1))
    return tiles


def _all_free(free: np.ndarray, length: int) -> np.ndarray:
    used = np.concatenate(([0], np.cumsum(~free)))
    return used[length:] == used[:-length] if len(free) >= length else np.zeros(0, dtype=bool)


def _longest(text, item, free_t, free_i, least: int, most: int) -> int:
    """The largest length up to ``most`` with a common free window, by bisection (a common run has common parts of all lengths); 0 if under ``least``."""
    low, high = least - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        a, b = window_hashes(text, mid)[_all_free(free_t, mid)], window_hashes(item, mid)[_all_free(free_i, mid)]
        low, high = (mid, high) if len(np.intersect1d(a, b)) else (low, mid - 1)
    return low if low >= least else 0


def _scan(items: list[tuple[int, bytes]], least: int, threshold: float):
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("matched", pa.int64()), ("item_tokens", pa.int64()), ("tiles", pa.int64()), ("longest", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        token = [np.frombuffer(b, dtype=np.uint64) for _, b in items]
        widths = sorted({min(least, len(t)) for t in token if len(t)})  # an item of fewer tokens is its own seed
        seeds = {}
        for w in widths:
            mine = [k for k, t in enumerate(token) if len(t) and min(least, len(t)) == w]
            h = np.concatenate([window_hashes(token[k], w) for k in mine])
            owner = np.concatenate([np.full(len(token[k]) - w + 1, k) for k in mine])
            order = np.argsort(h, kind="stable")
            seeds[w] = h[order], owner[order]
        for batch in batches:
            for ids, texts in slices(batch):
                words, at = slice_words([t.decode("utf-8", "replace").lower().encode() for t in texts], IS_BREAK)
                rows = []
                for w, (sh, owner) in seeds.items():
                    h = window_hashes(words, w)
                    if not len(h):
                        continue
                    hit = np.flatnonzero(sh[np.minimum(np.searchsorted(sh, h), len(sh) - 1)] == h)
                    doc = np.searchsorted(at, hit, "right") - 1
                    inside = hit + w <= at[doc + 1]
                    hit, doc = hit[inside], doc[inside]
                    for d in np.unique(doc).tolist():
                        rows += _document(int(ids[d]), hit[doc == d], words, w, sh, owner, h, token, items, least, threshold)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _document(i, hit, words, w, sh, owner, h, token, items, least, threshold):
    by_item: dict[int, list[int]] = {}
    for p in hit.tolist():
        for k in set(owner[np.searchsorted(sh, h[p]) : np.searchsorted(sh, h[p], "right")].tolist()):
            by_item.setdefault(k, []).append(p)
    for k, at in by_item.items():
        n = len(token[k])
        inside = np.zeros(n + 1, dtype=np.int64)
        places = np.flatnonzero(np.isin(window_hashes(token[k], w), h[at]))
        inside[places] += 1
        inside[places + w] -= 1
        if np.count_nonzero(np.cumsum(inside[:n])) < threshold * n:
            continue  # what its seeds cover at most, a repeated seed at each of its places
        cover = np.unique((np.array(at)[:, None] + np.arange(w)).ravel())
        gaps = np.flatnonzero(np.diff(cover) > 1) + 1
        parts = np.split(words[cover], gaps)
        # one value between parts that no item has, so that no tile crosses
        text = np.concatenate([x for j, p in enumerate(parts) for x in (p, np.array([j], dtype=np.uint64))])
        tiles = tile(text, token[k], min(w, least))
        matched = sum(x[2] for x in tiles)
        if matched >= threshold * n:
            yield {"doc": i, "item": items[k][0], "coverage": matched / n, "matched": matched, "item_tokens": n, "tiles": len(tiles), "longest": max(x[2] for x in tiles)}


def _item_tokens(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([tokens(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["item", "tokens"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6) -> DataFrame:
    """doc_id, item_id, coverage, matched, item_tokens, tiles, longest for each document and benchmark item whose tiles cover ``threshold`` of the item's tokens or more.

    Items of fewer than ``least`` tokens must occur whole; items without
    tokens, null texts and null item_ids match nothing. Null doc_id: returned
    as null. Rows of one doc_id that give the same row give it once. The
    benchmark goes out in blocks of BLOCK bytes of text, each against all
    documents, so what is broadcast is bounded.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    sized = items.withColumn("bytes", F.octet_length("text"))
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK)
    out = None
    for k in range(max(1, blocks)):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))) == k)
        block = [(r["item"], bytes(r["tokens"])) for r in mine.mapInArrow(_item_tokens, "item long, tokens binary").collect()]
        found = text_rows(docs).mapInArrow(_scan(sorted(block), least, threshold), "doc long, item long, coverage double, matched long, item_tokens long, tiles long, longest long")
        out = found if out is None else out.union(found)
    back = F.when(F.col("doc") != F.lit(NO_ID), F.col("doc"))
    return out.distinct().select(back.alias("doc_id"), F.col("item").alias("item_id"), "coverage", "matched", "item_tokens", "tiles", "longest")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept; rows of one doc_id stay or go together. Nulls, empty texts and tables: as in ``leaks``."""
    (doc,) = free_names(docs, "__doc")
    gone = leaks(docs, benchmark, least, threshold).select(known_id(F.col("doc_id")).alias(doc)).distinct()
    return docs.withColumn(doc, known_id(F.col("doc_id"))).join(gone, doc, "left_anti").drop(doc)
