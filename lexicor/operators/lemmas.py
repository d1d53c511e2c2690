"""Lemma tables (T15 input).

The original takes lemmas from an NLP library; here the lemma table is an
input ``(form, lemma)``. ``plural_lemmas`` derives one from a corpus: a token
ending in ``s`` whose stem (the token without that ``s``) is itself a token
of the corpus gets the stem as lemma. It is a join on the distinct
vocabulary, so its cost grows with the vocabulary, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plural_lemmas(token_rows: DataFrame, token_col: str = "token", min_length: int = 4) -> DataFrame:
    vocab = token_rows.select(F.col(token_col).alias("form")).distinct()
    plural = (vocab.where((F.length("form") >= min_length) & F.col("form").endswith("s"))
              .withColumn("lemma", F.expr("substring(form, 1, length(form) - 1)")))
    return plural.join(vocab.select(F.col("form").alias("lemma")), "lemma").select("form", "lemma")


def spelling_table(spark, pairs) -> DataFrame:
    """Ordered GB->US pairs as a table ``(pos, gb, us)``."""
    return spark.createDataFrame([(i, gb, us) for i, (gb, us) in enumerate(pairs)],
                                 "pos int, gb string, us string")
