"""Sentence borders with learned abbreviations.

A full stop and a blank end a sentence unless the word before is an
abbreviation. Abbreviations are learned from the corpus without labels, after
Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006):
a type is one if the log-likelihood ratio of it being followed by a full stop
nearly always, against as often as any word, is large for its length, its inner
full stops and its occurrences without one. Behind an abbreviation there is a
border only before a capitalised word that the corpus writes in lower case
elsewhere and never capitalises inside a sentence.

All counts come from one aggregation over the chunks (runs without blanks) of
every text. The learned tables are read by an Arrow function as broadcast sets
up to ``MAX_BROADCAST_ROWS`` rows and ``MAX_BROADCAST_BYTES``; beyond, every row
is joined to the entries that its own chunks need, and cut by the same function.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20
#: The published threshold and the assumed share of full stops behind an abbreviation.
THRESHOLD = 0.3
SURE = 0.99
#: Marks around a word that are not part of its type.
OPENING, CLOSING = r"""["'(\[{]+""", r"""[)"'\]},;:!?]+"""
EDGES_RE = rf"^{OPENING}|{CLOSING}$"


def _kind(chunk: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(chunk, EDGES_RE, ""), r"\.$", ""))


def type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, stopped, plain, lower, inner``: of every type with a letter how
    often it comes with and without a full stop, in lower case, and capitalised
    inside a sentence. Lines and blanks separate chunks; null texts have none."""
    line = docs.select(F.explode(F.split(text_col, "\n")).alias("line"))
    chunks = line.select(F.filter(F.split("line", r"[ \t\r]+"), lambda c: c != "").alias("c"))
    one = chunks.select(F.explode(F.transform("c", lambda c, i: F.struct(
        c.alias("chunk"), F.coalesce(~F.get("c", i - 1).rlike(r"[.!?]$"), F.lit(False)).alias("inside")))).alias("x")).select("x.*")
    bare = F.regexp_replace("chunk", EDGES_RE, "")
    typed = one.select(_kind(F.col("chunk")).alias("word"), bare.endswith(".").alias("stop"),
                       bare.rlike(r"^\p{Ll}").alias("low"), (bare.rlike(r"^\p{Lu}") & F.col("inside")).alias("cap"))
    count = [F.count(F.when(c, 1)).alias(n) for c, n in (
        (F.col("stop"), "stopped"), (~F.col("stop"), "plain"), (F.col("low"), "lower"), (F.col("cap"), "inner"))]
    return typed.where(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(*count)


def abbreviations(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``word, stopped, plain, score`` of the types that are abbreviations."""
    n, stops = counts.agg(F.sum(F.col("stopped") + F.col("plain")), F.sum("stopped")).first()
    p = (stops or 0) / n if n else 0.0
    if not 0 < p < 1:
        return counts.select("word", "stopped", "plain", F.lit(0.0).alias("score")).limit(0)
    with_, without = F.col("stopped"), F.col("plain")

    def log_share(q: float) -> Column:
        return with_ * F.log(F.lit(q)) + without * F.log(F.lit(1 - q))

    dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - dots
    ratio = 2 * (log_share(SURE) - log_share(p))
    score = ratio * F.exp(-letters) * (dots + 1) * F.pow(letters.cast("double"), -without)
    return counts.where(with_ > 0).withColumn("score", score).where(F.col("score") >= threshold).select(
        "word", "stopped", "plain", "score")


def starters(counts: DataFrame) -> DataFrame:
    """``word`` of the types that, when capitalised, begin a sentence."""
    return counts.where("lower > 0 and inner = 0").select("word")


_BORDER = re.compile(r"[.!?][ \t]+")
_EDGES = re.compile(EDGES_RE)


def _type_of(chunk: str) -> str:
    return re.sub(r"\.$", "", _EDGES.sub("", chunk)).lower()


def _candidates(line: str):
    """``(end of the sentence, start of the next, type before, chunk after)`` of
    every possible border; the type is None behind ``!`` and ``?``."""
    for m in _BORDER.finditer(line):
        at, after = m.start() + 1, m.end()
        if line[at - 1] != ".":
            yield at, after, None, None
            continue
        begin = max(line.rfind(" ", 0, at), line.rfind("\t", 0, at), line.rfind("\r", 0, at)) + 1
        nxt = re.match(r"[^ \t\r]*", line[after:after + 256]).group()
        yield at, after, _type_of(line[begin:at]), _EDGES.sub("", nxt)


def _capital(word: str) -> bool:
    return bool(word) and unicodedata.category(word[0]) == "Lu"


def cut(text: str, abbreviated, begins) -> list[str]:
    """Sentences of a text, trimmed, without empty ones."""
    out = []
    for line in text.split("\n"):
        a = 0
        for at, after, kind, nxt in _candidates(line):
            if kind is not None and kind in abbreviated and not (_capital(nxt) and _type_of(nxt) in begins):
                continue
            out.append(line[a:at])
            a = after
        out.append(line[a:])
    return [s for s in (s.strip(" \t\r") for s in out) if s]


def _small(table: DataFrame, rows: int) -> bool:
    size = table.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    return size[0] <= rows and (size[1] or 0) <= MAX_BROADCAST_BYTES


def split_sentences(docs: DataFrame, abbreviated: DataFrame, begins: DataFrame, *, text_col: str = "text",
                    out_col: str = "sentences", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the array of sentences of every text, in order. A
    line break is a border, ``!`` and ``?`` before a blank too. Null and empty
    texts have none. A column named like the new one is replaced."""
    kept = docs.drop(out_col)
    abbreviated, begins = (cut_lineage(t.select("word"), "words") for t in (abbreviated, begins))
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.StringType()))])
    names = kept.columns
    at = names.index(text_col)
    kind = pa.list_(pa.string())
    if _small(abbreviated, max_rows) and _small(begins, max_rows):
        sets = docs.sparkSession.sparkContext.broadcast(tuple(
            frozenset(r[0] for r in t.toLocalIterator()) for t in (abbreviated, begins)))

        def run(batches):
            abbr, first = sets.value
            for b in batches:
                got = [cut(t.as_py() or "", abbr, first) for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], [*names, out_col])

        return kept.mapInArrow(run, schema)
    keyed = cut_lineage(kept.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "rows")

    def needs(batches):
        for b in batches:
            keys, kinds, words = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for line in (text or "").split("\n"):
                    for _, _, kind_, nxt in _candidates(line):
                        if kind_:
                            keys += [key, key]
                            kinds += [0, 1]
                            words += [kind_, _type_of(nxt)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(words, pa.string())],
                                             ["at", "kind", "word"])

    wanted = keyed.select("at", f"row.{text_col}").mapInArrow(needs, "at long, kind int, word string").distinct()
    have = abbreviated.select(F.lit(0).alias("kind"), "word").unionByName(begins.select(F.lit(1).alias("kind"), "word"))
    found = wanted.join(have, ["kind", "word"]).groupBy("at").agg(
        *(F.collect_set(F.when(F.col("kind") == k, F.col("word"))).alias(n) for k, n in ((0, "abbr"), (1, "first"))))
    rows = keyed.join(found, "at", "left").select("row.*", F.col("abbr").alias("_abbr"), F.col("first").alias("_first"))

    def run_own(batches):
        for b in batches:
            got = [cut(t or "", set(x or ()), set(y or ())) for t, x, y in zip(*(b.column(i).to_pylist() for i in (at, -2, -1)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(got, kind)], [*names, out_col])

    return rows.mapInArrow(run_own, schema)
