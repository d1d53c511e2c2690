"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts that a label calls good; everything else is
unlabelled web text, a mixture of good and bad. The class prior (the share of
good text in the mixture) is estimated from the scores of a classifier that
tells positives from unlabelled text: in its best top bin almost only good
text is left, so the ratio of the two shares there is the prior. The linear
model then minimises the non-negative unbiased risk
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])`` with the
logistic loss, so its score is a probability. Negative labels are never used.

A text's features are shares of characters and of repeated characters and
words, all over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import widened
from .chargrams import char_table, code_points, slices

#: Positives and unlabelled texts of a fit at most (about).
POSITIVES = 3_000
UNLABELLED = 6_000
_ASCII = 128
#: ASCII characters; then upper-case letters, other letters, digits, marks,
#: marks that repeat the character before, words like the one before, word
#: length, size.
N_FEATURES = _ASCII + 8
STEPS = 600
RATE = 0.05
DECAY = 1e-3


@dataclass(frozen=True)
class QualityModel:
    """``score = sigmoid((features - mean) / scale @ weights + bias)``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _tables():
    return (char_table(str.isupper), char_table(str.isalpha), char_table(str.isdigit),
            char_table(lambda c: not c.isalnum() and not c.isspace()), char_table(str.isspace))


def features(col: pa.Array, tables) -> np.ndarray:
    """Feature matrix of a text column (null as empty: all zero)."""
    upper, alpha, digit, mark, space = tables
    n = len(col)
    count = np.zeros((n, N_FEATURES))
    chars, words = np.zeros(n), np.zeros(n)
    for rows, parts in slices(col):
        codes, places = code_points(parts)
        low = np.minimum(codes, 0xFFFF).astype(np.int64)
        rows = np.array(rows)
        owner = np.repeat(np.arange(len(rows)), np.diff(places))
        low = low[:-1]  # the last line feed is the frame's
        first = np.zeros(len(low), bool)
        first[places[:-1]] = True
        body = ~first
        own, c = owner[body], low[body]
        part = np.bincount(own * _ASCII + np.minimum(c, _ASCII - 1), minlength=len(rows) * _ASCII)
        part = part.reshape(len(rows), _ASCII)
        part[:, _ASCII - 1] = 0
        np.add.at(count, (rows[:, None], np.arange(_ASCII)), part)
        same = np.zeros(len(low), bool)
        same[1:] = low[1:] == low[:-1]
        is_mark = mark[low]
        for k, hit in enumerate((upper[low], alpha[low], digit[low], is_mark, is_mark & same & body)):
            np.add.at(count[:, _ASCII + k], rows, np.bincount(owner[hit & body], minlength=len(rows)))
        blank = space[low] | first
        begin = ~blank
        begin[1:] &= blank[:-1]
        starts = np.flatnonzero(begin)
        if len(starts):
            with np.errstate(over="ignore"):
                at = np.arange(len(low)) - starts[np.maximum(np.cumsum(begin) - 1, 0)]
                at[blank] = 0
                power = np.full(int(at.max()) + 1, 0x100000001B3, np.uint64)
                power[0] = 1
                power = np.multiply.accumulate(power)
                h = np.add.reduceat(np.where(blank, np.uint64(0), (low + 77).astype(np.uint64) * power[at]), starts)
            row = owner[starts]
            again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
            np.add.at(count[:, _ASCII + 5], rows, np.bincount(row[again], minlength=len(rows)))
            np.add.at(words, rows, np.bincount(row, minlength=len(rows)))
        np.add.at(chars, rows, np.diff(places) - 1)
    out = count / np.maximum(1, chars)[:, None]
    out[:, _ASCII + 5] = count[:, _ASCII + 5] / np.maximum(1, words)
    out = np.sqrt(out)
    out[:, _ASCII + 6] = np.log1p(chars / np.maximum(1, words))
    out[:, _ASCII + 7] = np.log1p(chars)
    return out


def _descend(gradient, n: int) -> np.ndarray:
    """Adam steps from zero along ``gradient``."""
    x, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, STEPS + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in ``unlabelled`` (standardised feature rows with a
    last column of ones) by the best bin: a discriminator is trained on one
    half of each, and on the other half the top share of scores with the
    smallest upper bound of the ratio gives the estimate."""
    p_fit, p_out = positive[::2], positive[1::2]
    u_fit, u_out = unlabelled[::2], unlabelled[1::2]
    if not min(len(p_out), len(u_out)):
        return 0.5

    def gradient(w):
        return ((_sigmoid(p_fit @ w) - 1) @ p_fit / len(p_fit) + _sigmoid(u_fit @ w) @ u_fit / len(u_fit)) + DECAY * w

    w = _descend(gradient, positive.shape[1])
    p, u = np.sort(p_out @ w), np.sort(u_out @ w)
    p_above = 1 - np.searchsorted(p, p) / len(p)
    u_above = 1 - np.searchsorted(u, p) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((u_above + slack) / p_above)
    return float(np.clip(u_above[best] / p_above[best], 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """Non-negative PU fit of a linear model on feature rows."""
    width = N_FEATURES
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    p = np.column_stack([(positive - mean) / scale, np.ones(len(positive))])
    u = np.column_stack([(unlabelled - mean) / scale, np.ones(len(unlabelled))])
    prior = estimate_prior(p, u)

    def gradient(w):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        d_rest = su @ u / len(u) - prior * (sp @ p) / len(p)
        if rest < 0:
            return -d_rest + DECAY * w
        return prior * ((sp - 1) @ p) / len(p) + d_rest + DECAY * w

    w = _descend(gradient, width + 1)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def _feature_rows(texts: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        tables = _tables()
        for batch in batches:
            x = features(batch.column(0), tables)
            flat = pa.array(x.ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, flat)], ["x"])

    return texts.select(F.col(text_col)).mapInArrow(run, "x array<double>")


def _matrix(rows: DataFrame, limit: int) -> np.ndarray:
    got = [r["x"] for r in rows.limit(limit).collect()]
    x = np.array(got, dtype=np.float64).reshape(len(got), N_FEATURES)
    return x[np.lexsort(x.T)][np.random.default_rng(5).permutation(len(x))] if len(x) else x


def fit(docs: DataFrame, positive_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """Model from bounded samples of ``docs``: texts whose id is in
    ``positive_ids`` (at most ``positives`` ids, by a hash), and unlabelled
    ones (about ``unlabelled``, by another hash) whatever their id."""
    known = docs.where(F.col(text_col).isNotNull())
    picked = (positive_ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
              .orderBy(F.xxhash64("_id"), "_id").limit(positives))
    good = known.join(F.broadcast(picked), known[id_col] == F.col("_id")).select(text_col)
    n = max(1, known.count())
    some = known.where(F.pmod(F.xxhash64(F.lit("u"), F.col(id_col)), F.lit(1_000_003)) < 1_000_003.0 * unlabelled / n)
    return train(_matrix(_feature_rows(good, text_col), 2 * positives),
                 _matrix(_feature_rows(some, text_col), 2 * unlabelled))


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that the whole text is good. A null text
    counts as an empty one. A column named like the score is replaced; all
    others are kept."""
    kept = docs.drop(score_col)
    names = kept.columns
    at = names.index(text_col)
    table = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights, model.bias))

    def run(batches):
        mean, scale, weights, bias = table.value
        tables = _tables()
        for batch in batches:
            x = (features(batch.column(at), tables) - mean) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(x @ weights + bias))],
                                             [*names, score_col])

    return kept.mapInArrow(run, widened(kept.schema, **{score_col: "double"}))
