"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least one in HOT_SHARE of the weight, so at
#: most HOT_SHARE keys can be hot: that bounds the broadcast below.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row per ``key``; ``weight`` is
    how many of ``rows`` have it, dropped from the result).

    Hot keys (at most ``HOT_SHARE``) go through a broadcast of that proven
    size, so their rows stay where they are; the others through a shuffle."""
    heavy = F.col(weight) * HOT_SHARE >= table.agg(F.sum(weight)).scalar()
    values = [c for c in table.columns if c not in (key, weight)]
    hot = F.broadcast(table.where(heavy).select(F.col(key).alias("_hot"), *values))
    cold = table.where(~heavy).select(key, *values)
    cols = [*rows.columns, *values]
    on_hot = rows.join(hot, rows[key] == F.col("_hot")).select(*cols)
    rest = rows.where(F.col(key).isNotNull()).join(
        F.broadcast(table.where(heavy).select(key)), key, "left_anti").join(cold, key, "left").select(*cols)
    none = rows.where(F.col(key).isNull()).select(
        *rows.columns, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values))
    return on_hot.unionByName(rest).unionByName(none)
