"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of an item (a shorter item is one
window) and, as a set, its shingles of ``shingle`` words. A document contains
a window only if it has all of its shingles, so one of them, the necessary
prefix, is enough to find it: the rarest in the documents. The jobs are

1. one scan of the documents that counts the items' shingles over the whole
   corpus (and notes every document's word count);
2. windows whose rarest shingle never occurs are dropped, the others are
   indexed by that shingle;
3. a second scan joins document shingles to the index; a match fixes where
   the window would start (positional bound), must leave room for it (length
   bound), and is verified word by word.

Items are worked through in blocks of at most ``BLOCK_WORDS`` words, so what a
task holds is bounded whatever the benchmark's size; documents are read once
for the counts and once for every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrowtext import ALNUM_SEP, by_bytes, shingle_hashes, text_buffer, word_hashes

#: Words of the items of one block (its index is a few times 8 bytes a word).
BLOCK_WORDS = 2_000_000
_SIEVE = 1 << 20


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """Lists of ``(item_id, word hashes)``, block by block; ids may be null."""
    def words(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            h, first = word_hashes(data, offsets, ALNUM_SEP)
            rows = [h[first[i]:first[i + 1]] for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()),
                                              pa.array([r.tobytes() for r in rows], pa.binary())], ["item", "n", "words"])

    hashed = cut_lineage(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
                         .mapInArrow(words, "item string, n long, words binary").where("n > 0").distinct(), "items")
    total = hashed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_words))
    for k in range(n_blocks):
        part = hashed if n_blocks == 1 else hashed.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k)
        rows = part.select("item", "words").collect()  # about block_words words
        if rows:
            yield [(r["item"], np.frombuffer(bytes(r["words"]), np.uint64)) for r in rows]


def _windows(block, size: int, shingle: int):
    """Distinct windows of a block: ``{length: (word hashes, [item indexes])}``
    and the shingle width of each length."""
    found: dict[int, dict[bytes, set[int]]] = {}
    for i, (_, words) in enumerate(block):
        length = min(size, len(words))
        rows = np.lib.stride_tricks.sliding_window_view(words, length)
        for r in rows:
            found.setdefault(length, {}).setdefault(r.tobytes(), set()).add(i)
    return {n: (np.array([np.frombuffer(k, np.uint64) for k in w]), [sorted(v) for v in w.values()], min(shingle, n))
            for n, w in sorted(found.items())}


class _Sieve:
    """Positions of wanted hashes in a hash array: a bit table, then a search."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.bits = np.zeros(_SIEVE, bool)
        self.bits[(wanted & np.uint64(_SIEVE - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray):
        at = np.flatnonzero(self.bits[(hashes & np.uint64(_SIEVE - 1)).astype(np.int64)])
        place = np.searchsorted(self.wanted, hashes[at])
        place[place == len(self.wanted)] = 0
        ok = self.wanted[place] == hashes[at]
        return at[ok], place[ok]


def _inside(first: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Whether ``at .. at + length`` lies within one document."""
    row = np.searchsorted(first, at, "right") - 1
    return (at >= 0) & (at + length <= first[np.minimum(row + 1, len(first) - 1)])


def _scan_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """``id, text_key, n_words`` of every document, and for the shingles
    rows ``width, shingle (index), n`` of their occurrences in a partition."""
    table = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        sieves = {w: _Sieve(h) for w, h in table.value.items()}
        counts = {w: np.zeros(len(h), np.int64) for w, h in table.value.items()}
        for batch in by_bytes(batches, 1):
            data, offsets = text_buffer(batch.column(1))
            words, first = word_hashes(data, offsets, ALNUM_SEP)
            for w, sieve in sieves.items():
                at, place = sieve.find(shingle_hashes(words, w))
                counts[w] += np.bincount(place[_inside(first, at, w)], minlength=len(counts[w]))
            n = len(offsets) - 1
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first), pa.int64()),
                                              nothing, nothing, nothing],
                                             ["id", "text_key", "n_words", "width", "shingle", "n"])
        for w, c in counts.items():
            hit = np.flatnonzero(c)
            nothing = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array(np.full(len(hit), w), pa.int64()),
                                              pa.array(hit, pa.int64()), pa.array(c[hit], pa.int64())],
                                             ["id", "text_key", "n_words", "width", "shingle", "n"])

    return docs.mapInArrow(run, "id long, text_key long, n_words long, width long, shingle long, n long")


def _prefix_index(windows, counts: dict[int, np.ndarray], wanted: dict[int, np.ndarray]):
    """Per shingle width: sorted prefix shingles, and for each its windows as
    ``(offset of the shingle in the window, window number)``."""
    index: dict[int, list] = {}
    number = 0
    for length, (rows, _, width) in windows.items():
        grams = np.array([shingle_hashes(r, width) for r in rows])
        often = counts[width][np.searchsorted(wanted[width], grams)]
        rarest = often.argmin(1)
        pick = np.arange(len(rows))
        there = often[pick, rarest] > 0
        index.setdefault(width, []).append(
            (grams[pick, rarest][there], rarest[there], number + pick[there]))
        number += len(rows)
    out = {}
    for width, parts in index.items():
        gram, offset, window = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(gram, kind="stable")
        keys, start = np.unique(gram[order], return_index=True)
        if len(keys):
            out[width] = (keys, np.append(start, len(order)), offset[order], window[order])
    return out


def _scan_hits(docs: DataFrame, index, windows, names: list[str]) -> DataFrame:
    """``id, text_key, items, starts, ends`` of the documents with windows;
    starts and ends are the hit word runs."""
    lengths = np.concatenate([np.full(len(rows), n) for n, (rows, _, _) in windows.items()])
    owners = [o for _, (_, own, _) in windows.items() for o in own]
    table = docs.sparkSession.sparkContext.broadcast((index, windows, names, lengths, owners))

    def run(batches):
        index, windows, names, lengths, owners = table.value
        sieves = {w: _Sieve(x[0]) for w, x in index.items()}
        base, parts = 0, []
        for n, (rows, _, _) in windows.items():
            parts.append((n, base, rows))
            base += len(rows)
        for batch in by_bytes(batches, 1):
            data, offsets = text_buffer(batch.column(1))
            words, first = word_hashes(data, offsets, ALNUM_SEP)
            begins, found = [], []
            for w, (_, start, offset, window) in index.items():
                at, place = sieves[w].find(shingle_hashes(words, w))
                many = start[place + 1] - start[place]
                entry = np.repeat(start[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                begin, win = np.repeat(at, many) - offset[entry], window[entry]
                ok = _inside(first, begin, lengths[win])
                begin, win = begin[ok], win[ok]
                for n, base, rows in parts:
                    mine = np.flatnonzero((win >= base) & (win < base + len(rows)))
                    same = (words[begin[mine, None] + np.arange(n)] == rows[win[mine] - base]).all(1)
                    begins.append(begin[mine][same])
                    found.append(win[mine][same])
            begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
            win = np.concatenate(found) if found else begin
            row = np.searchsorted(first, begin, "right") - 1
            order = np.lexsort((begin, row))
            begin, win, row = begin[order], win[order], row[order]
            docs_hit, cut = np.unique(row, return_index=True)
            items, starts, ends = [], [], []
            for k, a in enumerate(cut):
                b = cut[k + 1] if k + 1 < len(cut) else len(row)
                s, e = begin[a:b] - first[docs_hit[k]], begin[a:b] - first[docs_hit[k]] + lengths[win[a:b]]
                top = np.maximum.accumulate(e)
                new = np.append(True, s[1:] > top[:-1])
                starts.append(s[new])
                ends.append(top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)])
                items.append(sorted({names[o] for w in np.unique(win[a:b]) for o in owners[w]} - {None}))
            hit = pa.array(docs_hit, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(hit), batch.column(2).take(hit), pa.array(items, pa.list_(pa.string())),
                 pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                ["id", "text_key", "items", "starts", "ends"])

    return docs.mapInArrow(run, "id long, text_key long, items array<string>, starts array<long>, ends array<long>")


def _covered(runs) -> F.Column:
    """Words covered by sorted ``(start, end)`` runs that may overlap."""
    step = F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("top")),
                       lambda acc, r: F.struct(
                           (acc["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(r["s"], acc["top"]))).alias("n"),
                           F.greatest(acc["top"], r["e"]).alias("top")))
    return step["n"]


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", size: int = 10, shingle: int = 3,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col, n_words, n_hit, items`` for every row of ``docs``: words in
    all, words inside any occurrence of a window, and the ids (as strings,
    sorted) of the items with occurring windows.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased. A null or empty text has no words; an item without words has
    no window, and one with a null id counts but is not named; items with equal
    windows are all named.
    Repeated rows are each returned, rows with a null id too; other columns
    are not read. An empty benchmark leaves every count of hits at 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("text_key"))
    hits, base = None, None
    for block in _item_blocks(items, item_col, item_text_col, block_words):
        windows = _windows(block, size, shingle)
        wanted: dict[int, np.ndarray] = {}
        for _, (words, _, width) in windows.items():
            grams = np.unique(np.concatenate([shingle_hashes(r, width) for r in words]))
            wanted[width] = np.union1d(wanted[width], grams) if width in wanted else grams
        scan = cut_lineage(_scan_counts(rows, wanted), "counts")
        base = base if base is not None else scan.where("width is null").select("id", "text_key", "n_words")
        counts = {w: np.zeros(len(h), np.int64) for w, h in wanted.items()}
        for r in scan.where("width is not null").groupBy("width", "shingle").agg(F.sum("n").alias("n")).collect():
            counts[r["width"]][r["shingle"]] = r["n"]  # at most the block's shingles
        index = _prefix_index(windows, counts, wanted)
        if index:
            part = _scan_hits(rows, index, windows, [name for name, _ in block])
            hits = part if hits is None else hits.unionByName(part)
    if base is None:
        base = cut_lineage(_scan_counts(rows, {}), "counts").select("id", "text_key", "n_words")
    if hits is None:
        out = base.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"),
                          F.array().cast("array<string>").alias("items"))
    else:
        whole = hits.select("id", "text_key", "items",
                            F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")).alias("runs"))
        merged = (whole.dropDuplicates(["id", "text_key", "items", "runs"]).groupBy("id", "text_key")
                  .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                       F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
                  .select("id", "text_key", "items", _covered(F.col("runs")).alias("n_hit")))
        key = [base["id"].eqNullSafe(merged["id"]), base["text_key"] == merged["text_key"]]
        out = base.join(merged, key, "left").select(
            base["id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items")
