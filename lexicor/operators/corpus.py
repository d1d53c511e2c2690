"""Corpus jobs over a document table.

``normalise`` runs one of the three recipes of the original pipeline over a
whole table as a single narrow projection (no shuffle); ``sentence_rows`` /
``token_rows`` give long tables for counting; ``clean_corpus`` is T19.

Recipes (order matters):

* ``api``    - sentence split -> ``process`` per sentence -> tokens joined by a
  space, sentences by a line break.
* ``loader`` - lemma + stop-word removal over the whole text -> spelling ->
  ``process`` on the result as one flat token list, one line. With
  ``lemmatize=False`` just ``process``.
* ``s2orc``  - sentence split -> lemma + stop words -> spelling per sentence;
  of ``process`` only the overflow test matters (the original discards the
  processed tokens), so only that test runs, per token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ascii_text as at
from ..functions import materials as mat
from ..functions import text as tx
from .spelling import fold_spelling


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc id, sent_no, sentence)``, order kept."""
    return docs.select(id_col, F.posexplode(tx.sentences(F.col(text_col))).alias("sent_no", "sentence"))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T2 long form: ``(doc id, sent_no, pos, token)``."""
    s = sentence_rows(docs, id_col, text_col)
    return s.select(id_col, "sent_no", F.posexplode(tx.tokens(F.col("sentence"))).alias("pos", "token"))


def overflow(steps: Column) -> Column:
    """a sentence is unprocessable when a formula amount overflows."""
    return F.exists(steps, lambda s: s["overflow"])


def process_sentences(toks: Column, formulas: Column, **flags) -> Column:
    """``process`` applied to each sentence's tokens: ``ARRAY<ARRAY<STRUCT>>``."""
    return F.transform(toks, lambda s, i: tx.process_tokens(s, formulas=F.get(formulas, i), **flags))


def process_text(docs: DataFrame, text_col: str = "text", *, split_oxidation: bool = True,
                 phrase_table: DataFrame | None = None, reps: int = 2, **flags) -> DataFrame:
    """T14 on whole texts: adds ``processed`` (tokens) and ``materials``.
    With ``phrase_table`` the tokens are merged into phrases ``reps`` times."""
    from .phrases import make_phrases

    out = docs.withColumn("_toks", tx.tokens(F.col(text_col), split_oxidation))
    out = out.withColumn("_steps", tx.process_tokens(F.col("_toks"), **flags)).select(
        *docs.columns, tx.processed(F.col("_steps")).alias("processed"), tx.mentions(F.col("_steps")).alias("materials"))
    return out if phrase_table is None else make_phrases(out, [phrase_table], reps, "processed", docs.columns)


def normalise(docs: DataFrame, recipe: str = "api", *, text_col: str = "text",
              lemma_table: DataFrame | None = None, spelling: Column | DataFrame | None = None,
              stop_words=None, lemmatize: bool = True, **flags) -> DataFrame:
    """Adds ``processed_abstract``, ``materials`` (T13 mentions) and
    ``unprocessable`` (F3) to ``docs`` using the named recipe. ``lemma_table``
    has ``form, lemma`` (any size, see ``text.lemmatize_column``); ``spelling``
    is a table ``pos, gb, us`` of any size (``spelling.fold_spelling``) or, for a
    short list, the ordered pair array attached by ``text.attach_spelling``."""
    text = F.col(text_col)

    if recipe == "api":
        # ASCII texts are worked through in Arrow functions, one for each group
        # of results, so that what nobody reads is not made; others by columns.
        plain, rest = F.when(at.is_ascii(text), text), F.when(~at.is_ascii(text), text)
        staged = docs.withColumn("_found", at.mentions_and_overflow(plain, **flags)).withColumn(
            "_text", at.processed_text(plain, **flags))
        # tokens are projected once and read by two consumers
        staged = staged.withColumn("_stoks", F.transform(tx.sentences(rest), lambda s: tx.tokens(s)))
        staged = staged.withColumn("_table", mat.formula_table(F.col("_stoks"), nested=True))
        out = staged.withColumn("_steps", process_sentences(F.col("_stoks"), F.col("_table"), **flags)).select(
            *docs.columns, "_steps",
            F.coalesce("_text", F.array_join(F.transform("_steps", lambda st: F.array_join(tx.processed(st), " ")), "\n"))
            .alias("processed_abstract"),
            F.coalesce("_found.materials", F.flatten(F.transform("_steps", tx.mentions))).alias("materials"),
            F.coalesce("_found.unprocessable", F.exists("_steps", overflow)).alias("unprocessable"))
    elif recipe == "loader":
        if lemmatize:
            docs = docs.withColumn("_ltoks", tx.remove_stop_words(
                F.flatten(F.transform(tx.sentences(text), lambda s: tx.tokens(s))), stop_words))
            if lemma_table is not None:
                docs = tx.lemmatize_column(docs, "_ltoks", lemma_table)
            docs = _spelled(docs.withColumn("_base", F.array_join("_ltoks", " ")).drop("_ltoks"), "_base", spelling)
        else:
            docs = docs.withColumn("_base", text)
        flat = F.flatten(F.transform(tx.sentences(F.col("_base")), lambda s: tx.tokens(s)))
        out = docs.withColumn("_flat", flat).withColumn("_steps", tx.process_tokens(F.col("_flat"), **flags)).select(
            *docs.columns, "_steps", F.array_join(tx.processed(F.col("_steps")), " ").alias("processed_abstract"),
            tx.mentions(F.col("_steps")).alias("materials"),
            overflow(F.col("_steps")).alias("unprocessable")).drop("_base")
    elif recipe == "s2orc":
        # sentence tokens are projected once and read by two consumers (two
        # references keep the optimizer from inlining the tokenisation twice)
        staged = docs.withColumn("_stoks", F.transform(tx.sentences(text), lambda s: tx.tokens(s))).withColumn(
            "_kept", F.transform("_stoks", lambda tk: tx.remove_stop_words(tk, stop_words)))
        if lemma_table is not None:
            staged = tx.lemmatize_column(staged, "_kept", lemma_table, nested=True)
        staged = _spelled(staged.withColumn("_kept", F.transform("_kept", lambda k: F.array_join(k, " "))), "_kept", spelling)
        out = staged.select(
            "*",
            F.array_join("_kept", "\n").alias("processed_abstract"),
            F.array().cast("array<struct<original:string,normalized:string>>").alias("materials"),
            mat.any_overflow(F.col("_stoks")).alias("unprocessable"))
        out = out.drop("_stoks", "_kept")
    else:
        raise ValueError(f"unknown recipe {recipe!r}")
    return out.drop("_steps")


def _spelled(df: DataFrame, col: str, spelling: Column | DataFrame | None) -> DataFrame:
    """``df`` with the texts (or array of texts) of ``col`` folded."""
    if spelling is None:
        return df
    if isinstance(spelling, DataFrame):
        return fold_spelling(df, spelling, text_col=col)
    if df.schema[col].dataType.typeName() == "array":
        return df.withColumn(col, F.transform(col, lambda s: tx.fold_spelling(s, spelling)))
    return df.withColumn(col, tx.fold_spelling(F.col(col), spelling))


def clean_corpus(articles: DataFrame, tag: str, *, lemma_table: DataFrame | None = None,
                 spelling: Column | DataFrame | None = None, stop_words=None, key_cols=("doc_id",),
                 text_col: str = "processed_abstract") -> DataFrame:
    """Tag filter -> stop words -> lemmas -> spelling, one record per
    article. The lemma table is a broadcast lookup within its size bound and
    an equi-join on the exploded tokens beyond it (``text.lemmatize_column``)."""
    keys = [c for c in key_cols if c in articles.columns]
    sel = articles.where(F.array_contains("tags", tag))
    toks = F.flatten(F.transform(F.split(F.col(text_col), "\n"), lambda s: tx.tokens(s)))
    staged = sel.select(*keys, *(["_spelling"] if isinstance(spelling, Column) else []),
                        tx.remove_stop_words(toks, stop_words).alias("_ct"))
    if lemma_table is not None:
        staged = tx.lemmatize_column(staged, "_ct", lemma_table)
    staged = _spelled(staged.withColumn("cleaned", F.array_join("_ct", " ")), "cleaned", spelling)
    return staged.select(*keys, "cleaned")


def write_corpus_text(cleaned: DataFrame, path: str, column: str = "cleaned") -> None:
    """Records joined by ``\\n+++\\n`` in text files (partition-parallel)."""
    from ..functions.fixed_values import CORPUS_RECORD_SEP

    cleaned.select(column).write.mode("overwrite").option("lineSep", CORPUS_RECORD_SEP).text(path)
