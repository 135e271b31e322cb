"""Language identification by cross-parsing against suffix automata.

A language's reference is a bounded sample of its labelled text. The suffix
automaton of the reference reads a text and follows it as long as the
letters read form a part of the reference: a longest match, one phrase. The
number of phrases times the logarithm of the reference's length, over the
length of the text, estimates the cross-entropy; the language with the least
wins. Automata are dense tables with the restart after a mismatch folded in,
so that many blocks of texts are read in step, each from the start state; then
each block is read again from the state in which the block before it ended,
until both readings are in one state. So phrases go on over blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_id, slices, text_rows

BLOCK = 512
"""Letters that are read in step."""
KNOWN = 0x3000
_LETTER = np.array([chr(c).isalpha() for c in range(KNOWN)])
UND = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters as one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = np.ones(len(cp), dtype=bool)
    low = cp < KNOWN
    letter[low] = _LETTER[cp[low]]
    out = np.where(letter, cp, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return out[keep] if len(out) else out


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


@dataclass
class Reference:
    lang: str
    bits: float
    table: np.ndarray
    """[state * symbols + symbol]: the next state * symbols, times four, plus the phrases that ended: with a letter
    that the reference doesn't have, that letter too. In the start state no phrase is open."""


@dataclass
class Model:
    symbols: dict[int, int]
    references: list[Reference]

    @property
    def width(self) -> int:
        return len(self.symbols) + 2  # letters, any other letter, padding


def build(texts: dict[str, str]) -> Model:
    """From a reference text per language."""
    read = {lang: letters(t) for lang, t in sorted(texts.items())}
    read = {lang: x for lang, x in read.items() if (x != 32).any()}
    symbols = {int(c): k for k, c in enumerate(np.unique(np.concatenate([*read.values(), np.empty(0, dtype=np.uint32)])))}
    model = Model(symbols, [])
    width = model.width
    for lang, x in read.items():
        states = automaton([symbols[c] for c in x.tolist()])
        root = np.zeros(width, dtype=np.int64)
        for c, t in states[0].items():
            root[c] = t
        known = np.zeros(width, dtype=np.int64)
        known[list(states[0])] = 1
        table = np.tile((root * width) << 2 | np.where(known, 1, 2), (len(states), 1))
        table[0] -= 1  # nothing to end
        for s, moves in enumerate(states):
            for c, t in moves.items():
                table[s, c] = (t * width) << 2
        table[:, width - 1] = (np.arange(len(states)) * width) << 2
        model.references.append(Reference(lang, float(np.log2(len(x) + 1)), table.ravel().astype(np.int32)))
    return model


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """[language, text]: number of phrases of each text's letters."""
    width = model.width
    codes = np.full(KNOWN, width - 2, dtype=np.uint8 if width < 256 else np.uint16)
    for c, k in model.symbols.items():
        if c < KNOWN:
            codes[c] = k
    n = np.array([len(t) for t in texts])
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    lanes = np.full((len(owner), BLOCK), width - 1, dtype=codes.dtype)
    flat = np.concatenate([*texts, np.empty(0, dtype=np.uint32)])
    coded = np.where(flat < KNOWN, codes[np.minimum(flat, KNOWN - 1)], width - 2)
    for c, k in model.symbols.items():
        if c >= KNOWN:
            coded[flat == c] = k
    row = np.repeat((np.cumsum(blocks) - blocks) * BLOCK, n) + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    lanes.reshape(-1)[row] = coded
    lanes = np.ascontiguousarray(lanes.T)
    out = np.zeros((len(model.references), len(texts)), dtype=np.int64)
    follows = np.concatenate((np.zeros(min(1, len(owner)), dtype=bool), owner[1:] == owner[:-1]))
    for k, ref in enumerate(model.references):
        ended, last = _read(ref.table, lanes, follows)
        out[k] = np.bincount(owner, ended, len(texts))
        final = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, dtype=np.int64)
        out[k][owner[final]] += last[final] != 0  # the phrase that is open at the end
    return out


def _read(table: np.ndarray, lanes: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each lane (a column of ``lanes``) and the state at its end; a lane that ``follows`` goes on from the one before it."""
    n = lanes.shape[1]
    states, ends = np.empty(lanes.shape, dtype=np.int32), np.empty(lanes.shape, dtype=np.int8)
    state = np.zeros(n, dtype=np.int32)
    for step, symbols in enumerate(lanes):
        got = table[state + symbols]
        np.bitwise_and(got, 3, out=ends[step], casting="unsafe")
        state = np.right_shift(got, 2, out=states[step])
    count = ends.sum(axis=0, dtype=np.int64)
    last, more = state.copy(), np.zeros(n, dtype=np.int64)
    pending = np.flatnonzero(follows)
    pending = pending[last[pending - 1] != 0]
    while len(pending):
        # from the state in which the lane before ended, until both readings are in one state
        at, now = pending, last[pending - 1]
        more[pending], before = 0, last[pending]
        last[pending] = state[pending]
        for step in range(len(lanes)):
            got = table[now + lanes[step, at]]
            more[at] += (got & 3) - ends[step, at]
            now = got >> 2
            apart = now != states[step, at]
            at, now = at[apart], now[apart]
            if not len(at):
                break
        last[at] = now
        changed = pending[last[pending] != before] + 1
        changed = changed[changed < n]
        pending = changed[follows[changed]]
    return count + more, last


def learn(docs: DataFrame, per_lang: int = 64, chars_each: int = 2000, chars: int = 24_000, seed: int = 1) -> Model:
    """From ``docs`` (doc_id, text, lang; already without held-out rows) with lang and letters.

    The sample: per language the ``per_lang`` smallest hashes of doc_id, of
    each a piece of up to ``chars_each`` characters from a place anywhere in
    the text, by hash of doc_id too, and ``chars`` in all. Languages are a
    closed, small set; the sample grows with their number alone. Null ids,
    texts and langs don't count, repeated rows count once, ties can't be. Empty
    table: a model without languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # a frequent language is ranked in parts first
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    parts = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ids = known.select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(64)))
    ids = ids.withColumn("place", parts).where(F.col("place") <= per_lang)
    ids = ids.select("doc_id", "lang").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= per_lang)
    room = F.greatest(F.lit(1), F.length("text") - F.lit(chars_each - 1))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), room) + 1
    piece = F.substr("text", begin.cast("int"), F.lit(chars_each))
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "place", piece.alias("part")).distinct()
    texts: dict[str, str] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"], r["part"])):
        if len(texts.setdefault(r["lang"], "")) < chars:
            texts[r["lang"]] += r["part"] + "\n"
    return build({lang: t[:chars] for lang, t in texts.items()})


def _predict(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for ids, raw in slices(batch, 1 << 21):
                texts = [t.decode("utf-8", "replace") for t in raw]
                read = [letters(t) for t in texts]
                lang, score = [], []
                n = np.array([max(1, len(x)) for x in read])
                bits = phrases(model, read) * np.array([r.bits for r in model.references])[:, None] / n if model.references else np.zeros((1, len(texts)))
                best = bits.argmin(axis=0)
                weight = np.exp2(4 * (bits.min(axis=0) - bits))
                share = (weight / weight.sum(axis=0)).max(axis=0)
                for k, t in enumerate(texts):
                    known = bool(model.references) and any(c.isalpha() for c in t)
                    lang.append(model.references[best[k]].lang if known else UND)
                    score.append(float(share[k]) if known else 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([given_id(i) for i in ids.tolist()], pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the winner's share of two to the power of minus four times the bits a letter), a row per row of ``docs``.

    ``und``, score 0: null text, no letter, or a model without languages. Of
    languages with equal bits the smaller code wins. Texts of any length are
    read whole. Null doc_id: returned as null; repeated rows count each. Bytes
    that are no UTF-8 are read as replaced characters. Other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of about 2 * chars states a language
    return text_rows(docs).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
