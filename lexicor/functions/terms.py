"""Query-term and result-term string forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_term(word: Column) -> Column:
    """P10: ``soy_-_based_food`` -> ``soy-based food``."""
    return F.replace(F.replace(word.cast("string"), F.lit("_-_"), F.lit("-")), F.lit("_"), F.lit(" "))


def normalise_query_term(term: Column, lower: bool = True) -> Column:
    """Serving form lower-cases and joins words with ``_``; library form
    (``lower=False``) only joins words."""
    t = F.lower(term) if lower else term
    return F.replace(t, F.lit(" "), F.lit("_"))


def query_label(term: Column, vectors: Column) -> Column:
    """``flavor`` + (plant, +) + (animal, -) -> ``flavor + plant - animal``."""
    parts = F.transform(
        F.coalesce(vectors, F.array().cast("array<struct<term:string,positive:boolean>>")),
        lambda v: F.concat(F.when(v["positive"], F.lit(" + ")).otherwise(F.lit(" - ")), v["term"]))
    return F.concat(term, F.array_join(parts, ""))
