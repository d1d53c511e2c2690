"""Substring search by trigram posting lists.

An index is two tables. ``texts`` numbers the documents and keeps their texts in
lower case. ``postings`` has for every trigram and block of ``BLOCK`` documents
the numbers of the documents that contain it, ascending, as differences; a
trigram of every document is many short lists, never one. Postings are
partitioned by a hash of the trigram and sorted by it, so that looking up a
keyword reads the row groups of its trigrams alone (pushed filters).

A keyword's lists are intersected block by block, the shortest first, and only
the documents left are read to verify the keyword. Keywords of one or two
characters have no trigram: they are looked for in every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import numbered
from .search import keyword_hits

#: Documents of one posting list at most.
BLOCK = 1 << 16
PARTITIONS = 64
#: Bytes of texts whose trigrams are worked out at once.
SPAN_BYTES = 1 << 22


@dataclass(frozen=True)
class TrigramIndex:
    """``texts``: ``number, id, low``; ``postings``: ``gram, block, steps, part``."""

    texts: DataFrame
    postings: DataFrame


def _grams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


def _spans(texts: pa.Array, size: int = SPAN_BYTES):
    """Rows ``i`` to ``j`` of about ``size`` bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + size, "right")))
        yield i, j
        i = j


def _lists(number: np.ndarray, texts: list[str], block: int) -> pa.RecordBatch:
    """``gram, block, numbers`` of some texts: every trigram is one number, made
    of its characters' places in the texts' alphabet, and a (trigram, text) pair
    another; sorting those finds the distinct pairs."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letters, place = _alphabet(chars)
    n, d = max(1, len(letters)), max(1, len(texts))
    if n ** 3 * d >= 1 << 63 and d > 1:
        half = d // 2
        parts = [_lists(number[x], texts[x], block) for x in (slice(half), slice(half, None))]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    doc = np.repeat(np.arange(len(texts)), size)
    place = place.astype(np.int64)
    pair = ((place[:-2] * n + place[1:-1]) * n + place[2:]) * d + doc[2:]
    pair = np.sort(pair[doc[2:] == doc[:-2]])
    pair = pair[np.diff(pair, prepend=-1) > 0]
    code, of = pair // d, number[pair % d]
    first = np.ones(len(pair), bool)
    first[1:] = (code[1:] != code[:-1]) | (of[1:] // block != of[:-1] // block)
    start = np.flatnonzero(first)
    code = code[start]
    spelt = letters[np.stack([code // (n * n), code // n % n, code % n], 1)].astype("<u4").tobytes().decode("utf-32-le")
    return pa.RecordBatch.from_arrays(
        [pa.array([spelt[k:k + 3] for k in range(0, len(spelt), 3)], pa.string()), pa.array(of[start] // block, pa.int64()),
         pa.ListArray.from_arrays(pa.array(np.append(start, len(of)), pa.int32()), pa.array(of, pa.int64()))],
        ["gram", "block", "numbers"])


def _alphabet(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct characters and each one's place among them, without a sort."""
    there = np.zeros(int(chars.max(initial=0)) + 1, bool)
    there[chars] = True
    return np.flatnonzero(there).astype(np.uint32), (np.cumsum(there) - 1)[chars]


def build(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> TrigramIndex:
    """The index of ``docs`` written under ``path``. Null texts contain
    nothing; rows of one id and rows with a null id are documents of their own."""
    spark = docs.sparkSession
    texts = numbered(docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low")).where("low is not null"), ["id", "low"], "number")
    texts.select("number", "id", "low").write.mode("overwrite").parquet(f"{path}/texts")

    def run(batches):
        for b in batches:
            number, low = b.column(0).to_numpy(), b.column(1)
            for i, j in _spans(low):
                yield _lists(number[i:j], low.slice(i, j - i).to_pylist(), block)

    found = spark.read.parquet(f"{path}/texts").select("number", "low").mapInArrow(run, "gram string, block long, numbers array<long>")
    ordered = F.array_sort(F.flatten(F.collect_list("numbers")))
    lists = found.groupBy("gram", "block").agg(ordered.alias("n"))
    steps = F.transform("n", lambda x, i: (x - F.coalesce(F.get("n", i - 1), F.col("block") * block)).cast("int"))
    (lists.select("gram", "block", steps.alias("steps"), _part(F.col("gram")).alias("part"))
     .repartition("part", F.pmod(F.xxhash64("gram"), F.lit(4 * PARTITIONS))).sortWithinPartitions("part", "gram", "block")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings"))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> TrigramIndex:
    postings = spark.read.schema("gram string, block long, steps array<int>, part int").parquet(f"{path}/postings")
    return TrigramIndex(spark.read.parquet(f"{path}/texts"), postings)


def _part(gram):
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(PARTITIONS)).cast("int")


def lookup(index: TrigramIndex, keyword: str) -> DataFrame:
    """Posting lists of one keyword's trigrams: partitions and row groups of
    other trigrams are not read."""
    import zlib

    grams = sorted(_grams(keyword.lower()))
    parts = sorted({zlib.crc32(g.encode("utf-8", "replace")) % PARTITIONS for g in grams})
    return index.postings.where(F.col("part").isin(parts) & F.col("gram").isin(grams))


def _meet(block: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = sorted((s for s in table["steps"].combine_chunks()), key=len)
        left = None
        if len(lists) == table["wanted"][0].as_py():
            for x in lists:
                n = np.cumsum(x.values.to_numpy().astype(np.int64)) + key[1].as_py() * block
                left = n if left is None else np.intersect1d(left, n, assume_unique=True)
                if not len(left):
                    break
        left = np.zeros(0, np.int64) if left is None else left
        return pa.table({"kw": pa.array([key[0].as_py()] * len(left), pa.string()), "number": pa.array(left, pa.int64())})

    return run


def search(index: TrigramIndex, keywords: DataFrame, *, keyword_col: str = "keyword", block: int = BLOCK) -> DataFrame:
    """``keyword_col, id`` of the documents that contain each keyword,
    upper and lower case alike: the same rows as a scan of every text. Null and
    empty keywords find nothing; a keyword that comes twice counts once."""
    words = keywords.select(F.col(keyword_col).alias("word"), F.lower(keyword_col).alias("kw")).where("kw <> ''").distinct()
    distinct = words.select("kw").distinct()
    long = distinct.where(F.length("kw") >= 3)
    grams = long.select("kw", F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("kw") - 2), lambda i: F.substring("kw", i, F.lit(3)))).alias("grams"))
    wanted = grams.select("kw", F.size("grams").alias("wanted"), F.explode("grams").alias("gram")).withColumn("part", _part(F.col("gram")))
    lists = wanted.join(index.postings, ["part", "gram"]).select("kw", "wanted", "block", "steps")
    numbers = lists.groupBy("kw", "block").applyInArrow(_meet(block), "kw string, number long")
    found = numbers.join(index.texts, "number").where(F.contains("low", "kw")).select("kw", "id")
    # Keywords too short for a trigram: one automaton reads every text.
    hits = keyword_hits(index.texts, distinct.where(F.length("kw") < 3), text_col="low", id_col="number", kw_id_col="kw", kw_col="kw")
    scanned = hits.withColumnRenamed("kw_id", "kw").join(index.texts.select("number", "id"), "number").select("kw", "id")
    return found.unionByName(scanned).join(words, "kw").select(F.col("word").alias(keyword_col), "id")
