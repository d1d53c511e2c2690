"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the words of the mix are shared by weight, but no
source gives more than ``epochs`` times its own words. Sources above that cap
are clamped to it and what they leave is shared among the others by weight,
round by round, until none is above. A document is then taken as many whole
times as its source's target holds its size, and the rest of the target is
filled with one further repetition of documents in a seeded order; the last
of them gives only the words that are left.

DataFrame functions alone. Sources are summed before they meet anything. The
seeded order of a source is not sorted as a whole: its documents are summed in
``BUCKETS`` ranges of the order's key, and only the documents of the one range
in which the target ends are sorted (1 in 65,536 of a source, in expectation).
Rows that share source and key (repeated ids) are in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut_lineage

#: Words are runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the key that make a range of the order.
RANGE_DIGITS = 4


def by_place(weights: tuple[int, ...]):
    """Weights dealt in turn to the sources in the order of their names."""
    return lambda place: F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))


def water_fill(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``: together
    ``share`` times all sizes, by weight, none above ``epochs`` times its size
    (all at that cap if ``share`` asks for more)."""
    cap = F.col("source_size") * float(epochs)
    total = sources.agg(F.sum("source_size")).first()[0]
    if total is None:
        return sources.withColumn("target", cap)
    level = None
    while True:
        below = F.lit(True) if level is None else cap > F.lit(level) * F.col("weight")
        r = sources.agg(F.sum(F.when(~below, cap)).alias("clamped"), F.sum(F.when(below, F.col("weight"))).alias("weight")).first()
        # Each round clamps at least one further source, or the level stays.
        if not r["weight"]:
            return sources.withColumn("target", cap)
        new = (share * total - (r["clamped"] or 0.0)) / r["weight"]
        if new == level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _placed(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 in the order of the names, null last:
    sorted by ranges and numbered there; only one count a range meets the
    others."""
    row = cut_lineage(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()),
                      "ranges").withColumn("range", F.shiftright("at", 33))
    counts = row.groupBy("range").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.orderBy("range")) - F.col("n")  # one row a shuffle partition
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (row.join(F.broadcast(counts.withColumn("start", start).drop("n")), "range")
            .withColumn("place", place).drop("range", "start", "at"))


def mix(docs: DataFrame, *, weight=by_place((3, 1, 2)), share: float = 1.5, epochs: int = 2, seed: int = 13,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, source, size, source_size, target, copies, part, taken`` for
    every row of ``docs``: its words, those of its source, the words its source
    gives to the mix, how often the row is taken whole, the words (from its
    beginning) of one further repetition, and all words taken.

    ``weight`` gives a source's weight from its place (from 0) in the order of
    the names by code point, null last. The words taken of a source differ
    from its target by less than one. A null or empty text has size 0 and is
    never taken; a null source is a source like others; rows with a null or
    repeated id are rows of their own, equal ones in no particular order. An
    empty table gives none. Other columns are not read. ``seed`` and the id
    set the order, so reruns agree."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("name")), "sizes")
    sources = rows.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("w"))
    filled = cut_lineage(water_fill(cut_lineage(_placed(sources).withColumn("weight", weight(F.col("place"))), "sources"), share, epochs)
                         .withColumn("copies", F.least(F.lit(epochs), F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
                                     .cast("long"))
                         .withColumn("rest", F.floor(F.col("target") - F.col("copies") * F.col("source_size") + 0.5).cast("long")),
                         "targets")
    per = rows.groupBy("name", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy("range"))
    ends = (per.withColumn("upto", upto).join(filled.select("name", "rest"), "name").where("upto > rest").groupBy("name")
            .agg(F.min(F.struct("range", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("end")))
    table = filled.join(ends, "name", "left").select("name", "source_size", "target", "copies", "end", "w")
    dealt = cut_lineage(lookup(rows, cut_lineage(table, "ends"), "name", "w")
                        .withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "dealt")
    inside = F.coalesce(F.col("range") == F.col("end.range"), F.lit(False))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("name").orderBy("key", "size").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    last = dealt.where(inside).withColumn("part", _between(F.col("end.left") - before, F.col("size")))
    whole = dealt.where(~inside).withColumn(
        "part", F.when(F.coalesce(F.col("range") < F.col("end.range"), F.lit(True)), F.col("size")).otherwise(0))
    return whole.unionByName(last).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", F.col("part").cast("long").alias("part"),
        (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def _between(words: Column, size: Column) -> Column:
    """``words``, but not below 0 nor above ``size``."""
    return F.greatest(F.lit(0), F.least(words, size))
