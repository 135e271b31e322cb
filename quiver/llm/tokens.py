"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in overlapping chunks with
offsets. Two neighbours are spliced at a place of their overlap where the
tokenizer's own rules prove that what stands on one side never changes the
tokens of the other (``Codec.stable``), and where both encodings hold the same
tokens, with the same offsets, for AGREE tokens on either side. Where no such
place is found the overlap doubles, and with it, when need be, the chunk; at
last the rest of the text is one chunk, as it is from the start for a
tokenizer without such a proof.

Where the tokenizer's own rules prove that pieces of a text, parted by its
first split, are encoded each by itself, shorter texts count piece by piece
with a bounded memory of pieces; otherwise they are encoded whole.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
from collections import Counter
from unicodedata import is_normalized

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import given_id, slices, text_rows

AGREE = 4
SPACE = "\u2581"
"""Sentencepiece's space."""
REMEMBERED = 400_000


class Codec:
    """One tokenizer file: .json for tokenizers, .model for sentencepiece."""

    def __init__(self, path: str):
        self.memory: dict[str, int] = {}
        self.by_word, self.breaks = False, ""
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            with open(path, encoding="utf-8") as f:
                rules = json.load(f)
            self.by_word = words_stand_alone(rules)
            self.breaks = " \n" if self.by_word or spaces_begin_matches(rules) else ""
            if self.by_word:
                first = rules["pre_tokenizer"]
                self.pattern = regex.compile((first["pretokenizers"][0] if first["type"] == "Sequence" else first)["pattern"]["Regex"])
                self.added = [t["content"] for t in rules.get("added_tokens", [])]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_file=path)
            pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
            if not any(SPACE in p.lstrip(SPACE) for p in pieces):
                self.breaks = " "  # a space begins a piece: no merge reaches across it
        else:
            raise ValueError(f"neither .json nor .model: {path}")
        self.json = path.endswith(".json")

    def stable(self, text: str, p: int) -> bool:
        """Whether the tokens before place ``p`` and those from it on are proven not to depend on one another.

        So they are at a lone space (line feeds too, where the first split
        parts at them) that no token crosses; for sentencepiece, whose
        normaliser joins characters, between ASCII letters or digits only.
        """
        if not 0 < p < len(text) - 1 or text[p] not in self.breaks:
            return False
        before, after = text[p - 1], text[p + 1]
        if self.json:
            return not before.isspace() and not after.isspace()
        return before.isascii() and before.isalnum() and after.isascii() and after.isalnum()

    def located(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token."""
        if self.json:
            e = self.library.encode(text, add_special_tokens=False)
            return [(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)]
        pieces = self.library.encode(text, return_type="proto").pieces
        if text.isascii():
            return [(p.id, p.begin, p.end) for p in pieces]
        # its offsets count bytes
        at = [0]
        for c in text:
            at += [at[-1]] * (len(c.encode()) - 1) + [at[-1] + 1]
        return [(p.id, at[p.begin], at[p.end]) for p in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        if self.json:
            return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def count_words(self, texts: list[str]) -> list[int]:
        """Of texts, as the sum over the pieces that the rules part before merging.

        Texts in which lower case and NFC might meet, or which hold an added
        token, are encoded as they are.
        """
        plain = [self.plain(t) for t in texts]
        bags = [Counter(self.pattern.findall(t.lower())) if p else {} for t, p in zip(texts, plain, strict=True)]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        new = list({w for bag in bags for w in bag if w not in memory})
        for i in range(0, len(new), 10_000):
            memory.update(zip(new[i : i + 10_000], self.counts(new[i : i + 10_000]), strict=True))
        rest = iter(self.counts([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [sum([memory[w] * n for w, n in bag.items()]) if p else next(rest) for bag, p in zip(bags, plain, strict=True)]

    def plain(self, text: str) -> bool:
        low = text.lower()
        return (text.isascii() or "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)) and not any(t in text for t in self.added)


def words_stand_alone(rules: dict) -> bool:
    """Whether a text's tokens are those of its pieces, as the first split parts them.

    True for normalizers that work on single characters or join combining
    marks (NFC), or turn runs of white space into a space, followed by a split
    that drops all but its matches, none of which holds white space; and for
    added tokens that hold none either and don't ask for their surroundings.
    """
    steps = rules.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for n in steps["normalizers"] if steps["type"] == "Sequence" else [steps]:
        if not (n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    first = rules.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [{}])[0] if first.get("type") == "Sequence" else first
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or "Regex" not in first["pattern"]:
        return False
    pattern = regex.compile(first["pattern"]["Regex"])
    if regex.search(r"\(\?|\\[bBAzZGK]|[$^](?![^\[]*\])|(?<!\\)\.", first["pattern"]["Regex"]):
        return False  # looks around, or might match white space
    probes = [a + s + b for a in ("", "a", "1", "!", "'", "é") for s in " \n" for b in ("", "s", "a", "1", "!", "é")]
    if any(any(c.isspace() for c in m) for p in probes for m in pattern.findall(p)):
        return False
    model = rules["model"]
    return all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in rules.get("added_tokens", [])) and not model.get("dropout") and not model.get("fuse_unk")


def spaces_begin_matches(rules: dict) -> bool:
    """Whether white space after another character always begins a new piece.

    True for the byte-level split as its library defines it, without
    normalizer or added space: all its alternatives have white space first or
    alone, and look ahead from white space only. Added tokens: as above.
    """
    first = rules.get("pre_tokenizer") or {}
    plain = rules.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in rules.get("added_tokens", []))
    return bool(plain and added and not rules["model"].get("dropout"))


def boundary(text: str, left: list, right: list, start: int, end: int, stable) -> int | None:
    """A stable place in text[start:end] at which both token lists, in offsets of ``text``, agree; the one nearest the middle."""
    starts_l, starts_r = [t[1] for t in left], [t[1] for t in right]
    places = [p for p in range(start + 1, end - 1) if text[p] in " \n" and stable(text, p)]
    for p in sorted(places, key=lambda p: abs(2 * p - start - end)):
        i, j = bisect.bisect_left(starts_l, p), bisect.bisect_left(starts_r, p)
        if min(i, j) >= AGREE and left[i - AGREE : i + AGREE] == right[j - AGREE : j + AGREE] and len(left) >= i + AGREE and left[i - 1][2] <= p:
            return p
    return None


def lone(text: str, p: int) -> bool:
    """A space or line feed between other characters."""
    return not text[p - 1].isspace() and not text[p + 1].isspace()


def spliced(text: str, located, chunk: int, overlap: int, stable=lone) -> int:
    """Number of tokens of ``text``; ``located`` encodes a chunk, ``stable`` tells at which places of the text neighbours may be spliced."""

    def encode(a: int, b: int) -> list[tuple[int, int, int]]:
        return [(i, s + a, e + a) for i, s, e in located(text[a:b])]

    total, cut, start, end = 0, 0, 0, min(chunk, len(text))
    now = encode(start, end)
    while end < len(text):
        width = overlap
        while True:
            if width >= end - start:  # the overlap would be the whole chunk: widen that too
                end = min(len(text), start + 2 * (end - start))
                now = encode(start, end)
                if end == len(text):
                    break
            begin = end - width
            stop = min(len(text), begin + max(chunk, 2 * width))
            after = encode(begin, stop)
            at = boundary(text, now, after, max(begin, cut), end, stable)
            if at is not None:
                break
            width *= 2
        if end == len(text):
            break
        total += sum(cut <= t[1] < at for t in now)
        cut, start, end, now = at, begin, stop, after
    return total + sum(t[1] >= cut for t in now)


@functools.cache
def _codec(path: str) -> Codec:
    return Codec(path)


def _count(name: str, chunk: int, overlap: int, limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        codec = _codec(SparkFiles.get(name) if not os.path.isabs(name) else name)
        for batch in batches:
            for ids, raw in slices(batch):
                texts = [t.decode("utf-8", "replace") for t in raw]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                n = [0] * len(texts)
                few = codec.count_words if codec.by_word else codec.counts
                for k in range(0, len(short), 256):
                    for i, c in zip(short[k : k + 256], few([texts[i] for i in short[k : k + 256]]), strict=True):
                        n[i] = c
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[i] = spliced(t, codec.located, chunk, overlap, codec.stable) if codec.breaks else codec.counts([t])[0]
                yield pa.RecordBatch.from_arrays([pa.array([given_id(i) for i in ids.tolist()], pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    return run


def count_tokens(docs: DataFrame, path: str, chunk: int = 1 << 14, overlap: int = 1 << 9, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), a row per row of ``docs``.

    ``path`` is the tokenizer's file on the driver; executors get a copy.
    Counts are the library's for the whole text without begin, end or added
    special tokens; special strings in a text count as the library does by
    default. Null or empty text: 0. Null doc_id: returned as null. Bytes that
    are no UTF-8 count as replaced characters, but as they are in n_bytes.
    Repeated rows count each. Empty table: no rows. Other columns are ignored.
    """
    docs.sparkSession.sparkContext.addFile(path)
    return text_rows(docs).mapInArrow(_count(os.path.basename(path), chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
