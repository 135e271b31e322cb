"""Suffix arrays of byte strings by induced sorting, in numpy, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

NAMES = 512
"""Up to so many symbols suffixes are induced a bucket at a time, beyond it one by one: buckets are small then. Both give the same order in linear time."""


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S); the last is larger than the empty suffix (L)."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    s = np.zeros(n, dtype=bool)
    if len(differs):
        up = text[differs] < text[differs + 1]
        run = np.searchsorted(differs, np.arange(n))
        inside = run < len(differs)
        s[inside] = up[run[inside]]
    return s


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffixes in order, from leftmost-smaller ones in order: larger types upwards, then smaller ones downwards, each bucket as a whole."""
    n, sigma = len(text), len(starts) - 1
    sa = np.full(n, -1, dtype=np.int32)
    head, tail = starts[:-1].copy(), starts[1:].copy()
    by_char = np.searchsorted(text[seeds], np.arange(sigma + 1))  # seeds in order are in order of their first character

    def up(at: np.ndarray) -> None:
        p = at[at > 0] - 1
        p = p[~small[p]]
        if len(p):
            c = text[p]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            count = np.diff(np.append(first, len(c)))
            sa[np.repeat(head[c[first]] - first, count) + np.arange(len(c))] = p
            head[c[first]] += count

    def down(at: np.ndarray) -> None:
        """``at``: from the largest on."""
        p = at[at > 0] - 1
        p = p[small[p]]
        if len(p):
            c = text[p]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            count = np.diff(np.append(first, len(c)))
            sa[np.repeat(tail[c[first]] - 1 + first, count) - np.arange(len(c))] = p
            tail[c[first]] -= count

    up(np.array([n], dtype=np.int32))
    for c in range(sigma):
        done = starts[c]
        while done < head[c]:
            batch = sa[done : head[c]].copy()
            done = head[c]
            up(batch)
        up(seeds[by_char[c] : by_char[c + 1]])
    for c in range(sigma - 1, -1, -1):
        done = starts[c + 1]
        while done > tail[c]:
            batch = sa[tail[c] : done][::-1].copy()
            done = tail[c]
            down(batch)
        down(sa[starts[c] : head[c]][::-1])
    return sa


def _induce_singly(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As _induce, a suffix at a time: for alphabets of many small buckets."""
    n, sigma = len(text), len(starts) - 1
    at, t, s = [-1] * n, text.tolist(), small.tolist()
    begin = starts.tolist()
    head, tail = begin[:-1], begin[1:]
    by_char = np.searchsorted(text[seeds], np.arange(sigma + 1)).tolist()
    seeds = seeds.tolist()
    c = t[n - 1]
    at[head[c]] = n - 1
    head[c] += 1
    for b in range(sigma):
        i = begin[b]
        while i < head[b]:
            p = at[i] - 1
            i += 1
            if p >= 0 and not s[p]:
                c = t[p]
                at[head[c]] = p
                head[c] += 1
        for p in seeds[by_char[b] : by_char[b + 1]]:
            c = t[p - 1]
            at[head[c]] = p - 1
            head[c] += 1
    for b in range(sigma - 1, -1, -1):
        i = begin[b + 1]
        while i > tail[b]:
            i -= 1
            p = at[i] - 1
            if p >= 0 and s[p]:
                c = t[p]
                tail[c] -= 1
                at[tail[c]] = p
        for i in range(head[b] - 1, begin[b] - 1, -1):
            p = at[i] - 1
            if p >= 0 and s[p]:
                c = t[p]
                tail[c] -= 1
                at[tail[c]] = p
    return np.array(at, dtype=np.int32)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers from 0), smallest first; a suffix is larger than its prefixes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    values, text = np.unique(text, return_inverse=True)
    induce = _induce if len(values) <= NAMES else _induce_singly
    text = text.astype(np.uint16 if len(values) <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(values)))))
    if not len(lms):
        return induce(text, small, lms, starts)
    # by first character only: one round of induction sorts leftmost-smaller substrings
    first = lms[np.argsort(text[lms], kind="stable")]
    sa = induce(text, small, first, starts)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    ends = np.append(lms[1:], n)
    place = np.empty(n, dtype=np.int32)
    place[lms] = np.arange(len(lms))
    length = (ends - lms)[place[order]] + 1  # with the next one's first character; the last runs into the end
    same = length[1:] == length[:-1]
    same &= (order[1:] + length[1:] <= n) & (order[:-1] + length[:-1] <= n)
    at, off = np.flatnonzero(same), 0
    while len(at):
        equal = text[order[at] + off] == text[order[at + 1] + off]
        same[at[~equal]] = False
        off += 1
        at = at[equal]
        at = at[length[at] > off]
    name = np.concatenate(([0], np.cumsum(~same)))
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), dtype=np.int64)
        reduced[place[order]] = name
        order = lms[suffix_array(reduced)]
    return induce(text, small, order, starts)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi[i], the suffix before suffix i in order (-1: none), and the length of their common prefix.

    Only irreducible values, where the characters before differ, and those at
    ``breaks`` are found by comparing; the others are one less than the value
    before them. ``text``: bytes.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n, dtype=np.int32)
    own = (i == 0) | (phi <= 0)
    rest = np.flatnonzero(~own)
    own[rest] = text[rest - 1] != text[phi[rest] - 1]
    own[breaks] = True
    q = np.flatnonzero(own & (phi >= 0))
    padded = np.concatenate((text.astype(np.uint8), np.zeros(16, dtype=np.uint8)))
    words = np.ndarray((n + 8,), dtype="<u8", buffer=padded, strides=(1,))
    lcp = np.zeros(n, dtype=np.int32)
    at = q
    while len(at):
        a, b = at + lcp[at], phi[at] + lcp[at]
        inside = np.maximum(a, b) < n
        x = np.where(inside, words[np.minimum(a, n)] ^ words[np.minimum(b, n)], np.uint64(1))
        low = x & (~x + np.uint64(1))
        zeros = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        most = n - np.maximum(a, b)
        lcp[at] += np.where(inside, np.minimum(zeros, most), 0)
        at = at[(x == 0) & (most > 8)]
    last = np.maximum.accumulate(np.where(own, i, 0))
    return phi, np.maximum(0, lcp[last] - (i - last))
