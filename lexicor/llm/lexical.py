"""Ranked lexical search with deduplicated bags of terms.

The items' terms are the vocabulary; every document is read once and kept as
its term frequencies over that vocabulary and a length norm. Documents whose
frequencies and norm are equal score alike for every item, so they are one
class: grouped by a hash and the compared values themselves. Classes are
scored, not documents, and only the members with the smallest ids, as many as
an item returns, are kept of a class, because no other can be among its best.

Classes meet the items block by block: a dense block of term weights (terms of
some items by some classes) is gathered and summed by item in 64-bit integers,
and each task keeps the best members of every item.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Terms of lower-cased texts.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of item texts that share one scan of the documents: they bound the
#: vocabulary and the items that are broadcast.
ITEM_BYTES = 32 << 20
#: Cells of a block of term weights (8 bytes each), and its most terms.
CELLS = 1 << 21
BLOCK_TERMS = 1 << 14
#: Bytes of a text counted at once.
SLICE_BYTES = 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folds() -> bytes:
    """Every byte as itself, A-Z as a-z, bytes outside terms as a blank."""
    keep = set(b"0123456789" + LOWER.encode()) | set(range(0x80, 0x100))
    return bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


def term_counts(text: str, folds: bytes, slice_bytes: int = SLICE_BYTES) -> Counter:
    """How often each term occurs in a whole text."""
    flat = text.encode("utf-8", "replace").translate(folds)
    counts: Counter = Counter()
    a = 0
    while a < len(flat):
        b = len(flat)
        if b - a > slice_bytes:
            b = flat.find(b" ", a + slice_bytes)
            b = len(flat) if b < 0 else b
        counts.update(flat[a:b].split())
        a = b
    return counts


def _item_terms(items: DataFrame, item_col: str, text_col: str, item_bytes: int) -> tuple[DataFrame, int]:
    """``item, term, times, block`` and the number of blocks."""
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = -(-total // item_bytes)
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    terms = items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0))).alias("term"))
    return terms.groupBy("item", "term").agg(F.count("*").alias("times")).withColumn(
        "block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))), blocks


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tfs``: all terms of every document with repeats, and the
    numbers of those in the vocabulary, ascending, with their frequencies."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of a block of items

    def run(batches):
        number, folds = table.value, _folds()
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                counts = term_counts(text.as_py() or "", folds)
                n.append(counts.total())
                own = sorted((number[t], c) for t, c in counts.items() if t in number)
                terms.extend(t for t, _ in own)
                tfs.extend(c for _, c in own)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, terms array<int>, tfs array<long>")


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``m, terms, tfs, ids`` of the distinct vectors of ``rows``: rows meet by
    the hash of norm and vector and are one class only if these are equal.
    ``ids`` (null last) are the ``k`` smallest; others are dropped before the
    shuffle, so that a class of any size costs a task no more than ``k`` rows."""
    alike = ["hash", "m", "terms", "tfs"]
    order = Window.partitionBy(*alike).orderBy(F.col("id").asc_nulls_last())
    first = rows.withColumn("hash", F.xxhash64("m", "terms", "tfs")).withColumn("place", F.row_number().over(order)).where(f"place <= {int(k)}")
    ids = F.array_sort(F.collect_list(F.struct("place", "id")))["id"]
    return first.groupBy(*alike).agg(ids.alias("ids")).drop("hash")


class _Best:
    """The ``k`` best members of every item so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, k), np.int64)  # 0: no member
        self.id = np.zeros((n, k), np.int64)
        self.none = np.zeros((n, k), bool)  # a null id

    def add(self, items: np.ndarray, scores: np.ndarray, members: list[np.ndarray], none: list[np.ndarray]):
        """Scores (items by classes) of classes with those members."""
        k = self.k
        floor = np.maximum(self.score[items, -1], 1)
        if scores.shape[1] > k:
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        row, col = np.nonzero(scores >= floor[:, None])
        if not len(row):
            return
        many = np.array([len(members[c]) for c in col])
        touched = np.unique(row)
        item = np.concatenate([np.repeat(row, many), np.repeat(touched, k)])
        score = np.concatenate([np.repeat(scores[row, col], many), self.score[items[touched]].ravel()])
        name = np.concatenate([*(members[c] for c in col), self.id[items[touched]].ravel()])
        no = np.concatenate([*(none[c] for c in col), self.none[items[touched]].ravel()])
        order = np.lexsort((name, no, -score, item))
        item = item[order]
        start = np.searchsorted(item, touched)
        pick = order[(start[:, None] + np.arange(k)).ravel()]  # an item has k entries at least
        for held, new in ((self.score, score), (self.id, name), (self.none, no)):
            held[items[touched]] = new[pick].reshape(len(touched), k)


def _item_blocks(starts: np.ndarray, terms: np.ndarray, most: int):
    """Runs of items with at most ``most`` terms together, or one item."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
        yield a, b
        a = b


def score_classes(classes: DataFrame, item_ids: pa.Array, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray,
                  n_terms: int, k: int, schema: str, cells: int = CELLS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item, id, score`` of the ``k`` best members per item of every task.
    Item i has the terms ``terms[starts[i]:starts[i + 1]]``, each with its
    weight times its occurrences in the item."""
    table = classes.sparkSession.sparkContext.broadcast((item_ids, starts, terms, weights))

    def run(batches):
        item_ids, starts, terms, weights = table.value
        best = _Best(len(item_ids), k)
        blocks = []
        for a, b in _item_blocks(starts, terms, block_terms):
            used, place = np.unique(terms[starts[a]:starts[b]], return_inverse=True)
            blocks.append((a, b, used, place))
        number = np.full(n_terms, -1, np.int32)
        for batch in batches:
            m = batch.column(0).to_numpy()
            ends = batch.column(1).offsets.to_numpy().astype(np.int64)
            own, tf = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
            first = batch.column(3).offsets.to_numpy()
            none = batch.column(3).values.is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(3).values.fill_null(0).to_numpy()
            members = [ids[a:b] for a, b in zip(first, first[1:])]
            nulls = [none[a:b] for a, b in zip(first, first[1:])]
            row = np.repeat(np.arange(len(m)), np.diff(ends))
            part = (1_000_000_000 * tf[ends[0]:ends[-1]]) // (1000 * tf[ends[0]:ends[-1]] + 12 * m[row])
            own, ends = own[ends[0]:ends[-1]], ends - ends[0]
            for a, b, used, place in blocks:
                number[used] = np.arange(len(used))
                step = max(1, cells // max(1, len(used)))
                for i in range(0, len(m), step):
                    j = min(len(m), i + step)
                    x, y = ends[i], ends[j]
                    at = number[own[x:y]]
                    hit = np.flatnonzero(at >= 0)
                    block = np.zeros((len(used), j - i), np.int64)
                    block[at[hit], row[x:y][hit] - i] = part[x:y][hit]
                    items = max(1, cells // max(1, j - i))
                    for c, d in _item_blocks(starts[a:b + 1], terms, items):
                        lo, hi = starts[a + c] - starts[a], starts[a + d] - starts[a]
                        got = block[place[lo:hi]] * weights[starts[a + c]:starts[a + d], None]
                        scores = np.add.reduceat(got, starts[a + c:a + d] - starts[a + c], axis=0)
                        best.add(np.arange(a + c, a + d), scores, members[i:j], nulls[i:j])
                number[used] = -1
        item, place = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays(
            [item_ids.take(pa.array(item)), pa.array(best.id[item, place], mask=best.none[item, place]),
             pa.array(best.score[item, place])], ["item", "id", "score"])

    return classes.select("m", "terms", "tfs", "ids").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents of every item
    by score, equal ones by ascending id (null last).

    Terms are runs of ASCII letters and digits and non-ASCII characters, A-Z
    lower-cased; a null has none. With N documents that have a term, L terms in
    all, n terms of a document, df documents with a term and tf its occurrences
    in a document, a term weighs ``floor(1000 ln((2N + 2)/(2 df + 1)))`` and adds
    that times ``10^9 tf div (1000 tf + 12 m)`` for each time the item has it,
    where ``m = 75 + 25 n N div L``. Documents without any of an item's terms,
    and those that only have terms of weight 0, are not returned.

    Every row of ``docs`` is a document, repeated rows and null ids too. Rows of
    one item id (null is an id) are one item. Items without terms, and all if
    either table is empty, return nothing. Other columns are not read. Items
    are worked through in blocks of about ``item_bytes`` of text, each with one
    scan of the documents."""
    spark = docs.sparkSession
    per_item, blocks = _item_terms(items, item_col, item_text_col, item_bytes)
    item_type = items.schema[item_col].dataType.simpleString()
    schema = f"item {item_type}, id long, score long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        table = per_item.where(F.col("block") == block).select("item", "term", "times").orderBy("item", "term").toArrow()
        if not table.num_rows:
            continue
        item_ids, starts = _runs(table["item"].combine_chunks())
        used = table["term"].combine_chunks().dictionary_encode()
        names = used.dictionary.to_pylist()
        rows = cut_lineage(vectors(docs, {t.encode(): i for i, t in enumerate(names)}, id_col, text_col), "vectors")
        n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(names), np.int64)
        often = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weigh = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        for r in often.select("term", weigh.alias("w")).toLocalIterator():  # the block's vocabulary
            weights[r["term"]] = r["w"]
        terms = used.indices.to_numpy().astype(np.int64)
        norm = F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L")
        classes = cut_lineage(classes_of(rows.where(F.size("terms") > 0).select("id", norm.alias("m"), "terms", "tfs"), k), "classes")
        out = out.unionByName(score_classes(classes, item_ids, starts, terms, weights[terms] * table["times"].to_numpy(),
                                            len(names), k, schema))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _runs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a sorted column and where each begins (and the end)."""
    codes = column.dictionary_encode(null_encoding="encode")
    number = codes.indices.to_numpy()
    begin = np.append(0, np.flatnonzero(np.diff(number)) + 1)
    return column.take(pa.array(begin)), np.append(begin, len(column)).astype(np.int64)
