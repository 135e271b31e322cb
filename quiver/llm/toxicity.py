"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts, those among them, are the
unlabelled mix of clean and toxic ones. With the class prior p and a linear score g over
hashed words, the risk is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

with logistic loss l: the second part is the clean texts' share of the
unlabelled risk, which can't be negative; where it would be, the step goes
the other way. Features of a text: which of the chosen words it has, by hash
in BINS. Words are chosen whose share among the positives is above that among
the unlabelled by ``far`` standard deviations. That and the weight decay are
picked from SETTINGS on an inner fold of the training rows; there the scores
are shifted too, so that the class prior's share of the unlabelled texts
reaches THRESHOLD.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, given_id, slice_words, slices, text_rows
from .decontaminate import IS_BREAK

BINS = 1 << 24
SETTINGS = tuple((far, decay) for far in (4.0, 3.0, 5.0, 6.0) for decay in (1e-3, 1e-4, 3e-3))
THRESHOLD = 0.3
INNER = 4
"""One training row in so many is in the inner fold."""


@dataclass
class Model:
    bins: np.ndarray
    """Chosen bins, sorted."""
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, begin: np.ndarray, bins: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        has, k = chosen(self.bins, bins)
        return 1 / (1 + np.exp(-np.bincount(owner[has], self.weights[k], len(begin) - 1) - self.bias))


def chosen(table: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``bins`` are in ``table``, and their places in it."""
    if not len(table):
        return np.zeros(len(bins), dtype=bool), np.zeros(0, dtype=np.int64)
    k = np.minimum(np.searchsorted(table, bins), len(table) - 1)
    has = table[k] == bins
    return has, k[has]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's bins begin (one entry more at the end), and the distinct bins of all texts in a row."""
    words, at = slice_words([t.decode("utf-8", "replace").lower().encode() for t in texts], IS_BREAK)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    both = np.unique(owner * BINS + (words >> np.uint64(40)).astype(np.int64) % BINS)
    return np.searchsorted(both, np.arange(len(texts) + 1) * BINS), both % BINS


def _featurised(batches):
    for batch in batches:
        for ids, texts in slices(batch):
            begin, bins = features(texts)
            parts = np.split(bins.astype("<i4"), begin[1:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "bins"])


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float) -> np.ndarray:
    """Bins far more frequent among the positives."""
    count = lambda sample: np.unique(np.concatenate(sample), return_counts=True)
    bins, n = count(positive)
    other, m = count(unlabelled)
    has, k = chosen(other, bins)
    rest = np.zeros(len(bins))
    rest[has] = m[k]
    p, u = n / len(positive), (rest + 1) / (len(unlabelled) + 2)
    far = (p - u) / np.sqrt(u * (1 - u) * (1 / len(positive) + 1 / len(unlabelled)))
    return bins[(far > least) & (n >= 3)]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 60, step: float = 0.03, far: float = 4.0, decay: float = 1e-4, seed: int = 1) -> Model:
    """Adam over batches of both samples. Without positives or unlabelled texts: a constant score, the prior."""
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), bias, prior)
    table = choose(positive, unlabelled, far)
    positive, unlabelled = ([chosen(table, x)[1] for x in sample] for sample in (positive, unlabelled))
    w = np.zeros(len(table))
    rng = np.random.default_rng(seed)
    batches = max(1, min(16, len(positive) // 32))
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0

    def rows(sample, pick):
        got = [sample[i] for i in pick]
        n = np.array([len(x) for x in got])
        return np.concatenate([*got, np.empty(0, dtype=np.int64)]).astype(np.int64), np.repeat(np.arange(len(got)), n)

    for _ in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True)
        for pick_p, pick_u in parts:
            (bp, op), (bu, ou) = rows(positive, pick_p), rows(unlabelled, pick_u)
            gp = np.bincount(op, w[bp], len(pick_p)) + bias
            gu = np.bincount(ou, w[bu], len(pick_u)) + bias
            yes = 1 / (1 + np.exp(-gp))
            clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # derivatives by each score
            if clean >= 0:
                dp = prior * (yes - 1) - prior * yes
                du = 1 / (1 + np.exp(-gu))
            else:
                dp = prior * yes
                du = -1 / (1 + np.exp(-gu))
            dp, du = dp / len(pick_p), du / len(pick_u)
            grad = np.bincount(bp, dp[op], len(w)) + np.bincount(bu, du[ou], len(w)) + decay * w
            gb = dp.sum() + du.sum()
            t += 1
            m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(table, w, bias, prior)


def pick(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 1) -> tuple[float, float, float]:
    """The setting, the first of equal ones, with the largest chance that a positive of the inner fold scores above an unlabelled text of it; and the shift of its scores, in logits.

    For a given prior that chance grows with the one to score above a clean text.
    """
    rng = np.random.default_rng(seed)
    inner = [rng.permutation(len(x)) % INNER == 0 for x in (positive, unlabelled)]
    (tp, vp), (tu, vu) = (
        ([x for x, i in zip(sample, fold, strict=True) if not i], [x for x, i in zip(sample, fold, strict=True) if i])
        for sample, fold in zip((positive, unlabelled), inner, strict=True)
    )
    if not (tp and vp and tu and vu) or not 0 < prior < 1:
        return *SETTINGS[0], 0.0

    def logits(model: Model, sample: list[np.ndarray]) -> np.ndarray:
        s = np.clip(model.score(np.cumsum([0, *map(len, sample)]), np.concatenate(sample)), 1e-12, 1 - 1e-12)
        return np.log(s / (1 - s))

    found = []
    for far, decay in SETTINGS:
        model = fit(tp, tu, prior, far=far, decay=decay, seed=seed)
        a, b = logits(model, vp), np.sort(logits(model, vu))
        above = float((np.searchsorted(b, a) + np.searchsorted(b, a, "right")).mean()) / 2 / len(b)
        found.append((above, far, decay, float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(b, 1 - prior))))
    # where the share can't be told from texts without any chosen word, the scores stay
    _, far, decay, shift = max(found, key=lambda x: x[0])
    floor = fit(tp, tu, prior, far=far, decay=decay, seed=seed).bias
    return far, decay, shift if floor + shift < np.log(THRESHOLD / (1 - THRESHOLD)) - 1e-9 else 0.0


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 2000, most_unlabelled: int = 8000, seed: int = 1) -> Model:
    """Fits on the confirmed toxic of ``labels`` (doc_id, toxic) and on a sample of all ``docs`` (both already without held-out rows).

    The samples are the smallest hashes of doc_id: at most ``most_positive``
    and ``most_unlabelled`` documents. The class prior is the share of toxic
    ones among all labels. Null ids and labels don't count; repeated rows
    count once in the sample of ids. Empty tables: a constant score.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id", F.lit(seed))
    positive = marked.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(most_positive)
    every = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(order, "doc_id").limit(most_unlabelled)
    # at most most_positive + most_unlabelled ids
    both = positive.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u")).union(every.select("doc_id", F.lit(0), F.lit(1)))
    sample = cut(both.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u")))
    found = text_rows(docs).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").mapInArrow(_featurised, "doc_id long, bins binary")
    positives, unlabelled = [], []
    for r in sorted(found.join(F.broadcast(sample), "doc_id").select("doc_id", "p", "u", "bins").collect()):
        bins = np.frombuffer(r["bins"], dtype="<i4").astype(np.int64)
        positives += [bins] * r["p"]
        unlabelled += [bins] * r["u"]
    far, decay, shift = pick(positives, unlabelled, prior)
    model = fit(positives, unlabelled, prior, far=far, decay=decay)
    model.bias += shift
    return model


def _scores(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for ids, texts in slices(batch):
                s = model.score(*features(texts))
                yield pa.RecordBatch.from_arrays([pa.array([given_id(i) for i in ids.tolist()], pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), a row per row of ``docs``.

    Null or empty text: no features, so the model's bias alone. Only the text
    counts, whole at any length, bytes that are no UTF-8 as replaced
    characters; other columns are ignored. Repeated rows score alike. Null
    doc_id: returned as null. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # no more bins than the words of the sample
    return text_rows(docs).mapInArrow(_scores(shared), "doc_id long, score double")
