"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams (with word edges) and whole
words (a word said again and again counts once), each hashed to a row of an embedding matrix. The mean of the rows goes
through a linear layer with a softmax over clean and toxic. Embeddings and
layer are trained jointly by gradient steps in numpy on a bounded sample of
labelled rows; a misspelt or inflected word that was never seen shares most
of its n-grams, and so its meaning, with those that were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import widened
from .chargrams import char_table, code_points, gram_buckets, slices

#: Labelled rows of each class at most (clean, toxic), and their largest text.
SAMPLE_ROWS = (5_000, 1_700)
SAMPLE_TEXT_BYTES = 32_768
BITS = 18
DIM = 8
SIZES = (3, 4, 5)
#: Passes over the sample; more for a small one, up to so many steps.
EPOCHS = 14
MIN_STEPS = 2_000
BATCH = 32
RATE = 0.5
#: Steps of embedding rows are so many times longer: each has a small share
#: in the mean.
EMB_RATE = 200
DECAY = 2e-4
#: Buckets that fewer texts of the sample have say nothing.
MIN_TEXTS = 3
#: Empty subwords added to every bag, so that the few words of a very short
#: text do not decide alone.
PADDING = 100


@dataclass(frozen=True)
class ToxicityModel:
    """``bucket_logit[b]``: what bucket b adds to the toxic-minus-clean logit
    (its embedding times the layer's weights); ``bias`` of the layer."""

    bucket_logit: np.ndarray
    bias: float


def _word_buckets(codes: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of every whole word."""
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, starts
    run = np.cumsum(begin) - 1
    place = np.arange(len(codes)) - starts[np.maximum(run, 0)]
    place[~word] = 0
    with np.errstate(over="ignore"):
        power = np.full(int(place.max()) + 1, 0x100000001B3, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        value = np.where(word, (codes.astype(np.uint64) + np.uint64(77)) * power[place], np.uint64(0))
        h = np.add.reduceat(value, starts)
        return starts, ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def _features(parts: list[str], word_chars: np.ndarray):
    """``(place, bucket)`` arrays of all subwords and words of the parts, one
    pair for each n-gram size, and the parts' places."""
    codes, places = code_points([p.lower() for p in parts])
    word = word_chars[np.minimum(codes, 0xFFFF)]
    codes = np.where(word, codes, np.uint32(10))  # one mark for a word's edge
    starts, bucket = _word_buckets(codes, word, BITS)
    if len(starts):
        again = np.append(False, (bucket[1:] == bucket[:-1]) & (np.diff(np.searchsorted(places, starts, "right")) == 0))
        begin = np.zeros(len(codes), bool)
        begin[starts] = True
        word = word & ~again[np.maximum(np.cumsum(begin) - 1, 0)]
        starts, bucket = starts[~again], bucket[~again]
    out = [(starts, bucket)]
    for n in SIZES:
        bucket = gram_buckets(codes, word, n, BITS)
        at = np.flatnonzero(bucket >= 0)
        out.append((at, bucket[at]))
    return out, places


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Joint training of embeddings and layer (softmax cross-entropy,
    mini-batches in a fixed shuffled order, falling rate)."""
    if not texts or labels.min() == labels.max():
        rate = (float(labels.sum()) + 0.5) / (len(texts) + 1)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(rate / (1 - rate))))
    table = char_table(str.isalnum)
    bags = []
    for text in texts:
        found, _ = _features([text], table)
        bucket, times = np.unique(np.concatenate([b for _, b in found]), return_counts=True)
        bags.append((bucket.astype(np.int32), (times / (PADDING + times.sum())).astype(np.float32)))
    # Rows of buckets that fewer than MIN_TEXTS texts have stay at nothing.
    seen = np.bincount(np.concatenate([b for b, _ in bags]), minlength=1 << BITS) >= MIN_TEXTS
    bags = [(b[seen[b]], t[seen[b]]) for b, t in bags]
    rng = np.random.default_rng(seed)
    emb = np.zeros((1 << BITS, DIM), np.float32)
    layer = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // len(bags)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            used, inverse = np.unique(np.concatenate([bags[i][0] for i in pick]), return_inverse=True)
            x = np.zeros((len(pick), len(used)), np.float32)
            x[np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick]), inverse] = np.concatenate(
                [bags[i][1] for i in pick])
            rows = emb[used]
            hidden = x @ rows
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            emb[used] = rows * (1 - DECAY) - rate * EMB_RATE * (x.T @ (p @ layer.T))
            layer -= rate / len(pick) * (hidden.T @ p)
            bias -= rate / len(pick) * p.sum(0)
    return ToxicityModel(emb @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str = "doc_id",
                    text_col: str = "text", rows: tuple[int, int] = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES):
    """Texts and labels of at most ``rows`` labelled rows of class 0 and 1, picked
    by a hash of their id, whose text is not longer than ``text_bytes``.
    Only the ids of the pick are broadcast."""
    wanted = None
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    for value, most in enumerate(rows):
        some = known.where(F.col("_y") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        wanted = some if wanted is None else wanted.unionByName(some)
    found = (docs.where(F.octet_length(text_col) <= text_bytes).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
             .join(F.broadcast(wanted.distinct()), "_id").select("_id", "_y", "_t").limit(2 * sum(rows)).collect())
    found.sort(key=lambda r: (r["_id"], r["_y"], r["_t"]))
    return [r["_t"] for r in found], np.array([r["_y"] for r in found], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, **options) -> ToxicityModel:
    """Model of ``labels.toxic`` from a bounded sample; see ``labelled_sample``."""
    return train(*labelled_sample(docs, labels, label_col=options.pop("label_col", "toxic"), **options))


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic class for every whole text.
    A text without words (null or empty too) has the layer's bias alone. A
    column named like the score is replaced; all others are kept."""
    kept = docs.drop(score_col)
    names = kept.columns
    at = names.index(text_col)
    table = docs.sparkSession.sparkContext.broadcast((model.bucket_logit, model.bias))  # 4 << BITS bytes

    def run(batches):
        logit, bias = table.value
        word_chars = char_table(str.isalnum)
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for rows, parts in slices(batch.column(at)):
                found, places = _features(parts, word_chars)
                for place, bucket in found:
                    sums = np.concatenate([np.zeros(1), np.cumsum(logit[bucket], dtype=np.float64)])
                    ends = np.searchsorted(place, places)
                    np.add.at(total, rows, np.diff(sums[ends]))
                    np.add.at(count, rows, np.diff(ends))
            mean = total / (PADDING + count) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(mean, -500, 500))))],
                                             [*names, score_col])

    return kept.mapInArrow(run, widened(kept.schema, **{score_col: "double"}))
