"""A training corpus from ``documents``, stage by stage.

Every stage works on all rows that the one before it kept, and its result is
written as Parquet and read again before the next. All but the last return the
columns of ``documents``. No stage can be expressed in SQL (two are trained,
one runs a compression library, one a tokenizer model), so ``ORACLE_SQL`` is
None and the tests hold ``run`` against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicor.llm import decontam, langid, quality, spm
from lexicor.llm.jaccard import jaccard_components
from lexicor.llm.queries import PIECE_MODEL, QUALITY_AT, language_model, quality_model, tokenizer_path
from lexicor.operators.joins import lookup
from lexicor.session import cut_lineage, load

ORACLE_SQL = None

#: Near copies share so many percent of their shingles of so many words.
SHINGLE_WORDS = 5
NEAR_PERCENT = 80


def _framed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``text``: names that an operator adds cannot
    clash with those of ``docs``."""
    return docs.select(F.struct("*").alias("row"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``QUALITY_AT``; a null text is
    scored as an empty one."""
    scored = quality.score(_framed(docs), quality_model(spark, docs, sf_dir))
    return scored.where(F.col("score") >= QUALITY_AT).select("row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is settled: texts without a letter and those
    with a narrow margin between languages go."""
    return langid.classify(_framed(docs), language_model(docs)).where("lang_accepted").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text`` and ``key``, a number of the row's own.
    That is the id where one row has it; rows whose id is null or comes again
    are written with numbers below all ids."""
    again = cut_lineage(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id"), "repeated")
    framed = _framed(docs)
    if again.isEmpty():
        return framed.withColumn("key", F.col("row.doc_id").cast("long"))
    below = docs.agg(F.coalesce(F.min("doc_id").cast("long"), F.lit(0))).first()[0] - 1
    known, odd = (framed.join(again, F.col("row.doc_id").eqNullSafe(again["doc_id"]), how) for how in ("left_anti", "left_semi"))
    odd = cut_lineage(odd.withColumn("key", below - F.monotonically_increasing_id()), "odd")
    return known.withColumn("key", F.col("row.doc_id").cast("long")).unionByName(odd)


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is not in ``keys``, a written table: its
    size is known, so Spark broadcasts it while it is small."""
    return keyed.drop("text").join(cut_lineage(keys.select("key"), "dropped"), "key", "left_anti").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (5-word shingles, Jaccard of 0.8) the
    row of the smallest id (a null id last). Rows, not ids, are compared: of
    rows of one id only those that are near copies go."""
    keyed = _keyed(docs)
    groups = jaccard_components(keyed, id_col="key", n_words=SHINGLE_WORDS, threshold=NEAR_PERCENT)
    named = groups.join(keyed.select("key", F.col("row.doc_id").alias("id")), "key").select(
        "component_id", "key", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("order"))
    first = named.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1")
    return _without(keyed, lookup(named, cut_lineage(first, "groups"), "component_id", "n").where("order <> first"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any 10-word window of a benchmark item."""
    keyed = _keyed(docs)
    found = decontam.find_contamination(keyed, load(spark, sf_dir, "benchmark"), id_col="key")
    return _without(keyed, found.where("n_hit > 0"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every document left: its
    pieces, and whether they decode to its text."""
    return spm.encode(docs.select("doc_id", "text"), tokenizer_path(PIECE_MODEL), decoded_col="round_trip").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is a written table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
