"""Corpus search (F5) and keyword batches.

``keyword_hits`` finds, for every document, which keywords it contains
(case-insensitive). Lower-casing runs on the JVM; matching uses one
Aho-Corasick automaton per task (Arrow batches in ``mapInPandas``), so a
document is scanned once whatever the number of keywords - no theta join of
documents x keywords. The keyword list is read once per chunk of at most
``MAX_KEYWORDS_PER_CHUNK`` entries (its size is checked first); longer lists
are split into hash chunks processed one after another.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_KEYWORDS_PER_CHUNK = 200_000
MAX_KEYWORD_BYTES_PER_CHUNK = 64 * 1024 * 1024


def search_filter(df: DataFrame, *, type_col: str = "type", subject_col: str = "subject",
                  text_col: str = "abstract", subject: str = "", keyword: str = "") -> Column:
    """``type:Journal`` AND optional exact subject AND optional keyword;
    an empty clause adds no constraint."""
    cond = F.col(type_col) == F.lit("Journal")
    if subject:
        cond = cond & (F.col(subject_col) == F.lit(subject))
    if keyword:
        cond = cond & F.lower(F.col(text_col)).contains(keyword.lower())
    return cond


def clean_keywords(lines: DataFrame, col: str = "value") -> DataFrame:
    """Keyword lines stripped; blank lines dropped."""
    return lines.select(F.trim(F.col(col)).alias("keyword")).where(F.col("keyword") != "")


def _matcher(pairs):
    if not pairs:
        return lambda text: set()
    import ahocorasick

    by_kw: dict[str, list] = {}
    for kid, kw in pairs:
        by_kw.setdefault(kw, []).append(kid)
    auto = ahocorasick.Automaton()
    for kw, ids in by_kw.items():
        auto.add_word(kw, ids)
    auto.make_automaton()

    def find(text):
        found = set()
        for _, ids in auto.iter(text):
            found.update(ids)
        return found
    return find


def keyword_hits(docs: DataFrame, keywords: DataFrame, *, text_col: str = "text", id_col: str = "doc_id",
                 kw_id_col: str = "kw_id", kw_col: str = "keyword") -> DataFrame:
    """distinct ``(kw_id, doc id)`` pairs where the document contains the keyword."""
    spark = docs.sparkSession
    kws = (keywords.select(F.col(kw_id_col).alias("kw_id"), F.lower(F.col(kw_col)).alias("kw"))
           .where(F.col("kw").isNotNull() & (F.col("kw") != "")))
    stats = kws.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("kw")), F.lit(0)).alias("bytes")).first()
    n_chunks = max(1, math.ceil(stats["n"] / MAX_KEYWORDS_PER_CHUNK),
                   math.ceil(stats["bytes"] / MAX_KEYWORD_BYTES_PER_CHUNK))
    id_type = docs.schema[id_col].dataType
    kid_type = kws.schema["kw_id"].dataType
    schema = T.StructType([T.StructField("kw_id", kid_type), T.StructField(id_col, id_type)])
    low = docs.select(F.col(id_col), F.lower(F.col(text_col)).alias("_low"))
    out = None
    for c in range(n_chunks):
        part = kws if n_chunks == 1 else kws.where(F.pmod(F.xxhash64("kw"), F.lit(n_chunks)) == c)
        pairs = [(r["kw_id"], r["kw"]) for r in part.collect()]
        bc = spark.sparkContext.broadcast(pairs)

        def run(batches, bc=bc):
            find = _matcher(bc.value)
            for pdf in batches:
                ids, kids = [], []
                for doc, text in zip(pdf[id_col].tolist(), pdf["_low"].tolist()):
                    if text is None:
                        continue
                    for k in find(text):
                        kids.append(k)
                        ids.append(doc)
                yield pd.DataFrame({"kw_id": kids, id_col: ids})

        hits = low.mapInPandas(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out
