"""Learned lemmas (T15) and ordered spelling replacement at size (T17) over
``documents``; lexicon and spelling list are derived from their vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lemma_trees, spelling
from ..session import cut_lineage, load
from .phrase_queries import _BASE, corpus_sentences
from .registry import register

_WORD = "^[a-z]{2,}$"


def _vocabulary(spark, sf_dir):
    """``form, half`` of the distinct plain words of even and odd documents."""
    rows = corpus_sentences(spark, sf_dir).select((F.col("doc_id") % 2).alias("half"), F.explode("toks").alias("form"))
    return cut_lineage(rows.where(F.col("form").rlike(_WORD)).distinct(), "vocabulary")


@register("lemma_learned", _BASE + f""",
t AS (SELECT DISTINCT doc_id % 2 AS half, w FROM (SELECT doc_id, unnest(toks) AS w FROM p0_out) WHERE regexp_matches(w, '{_WORD}')),
ev AS (SELECT w FROM t WHERE half = 0),
lx AS (SELECT w AS form, len(w) >= 4 AND ends_with(w, 's') AND w[:len(w) - 1] IN (SELECT w FROM ev) AS cut FROM ev),
sf AS (SELECT right(form, k) AS suffix, cut, count(*) AS n FROM lx, (SELECT unnest(range(0, {lemma_trees.SUFFIX + 1})) AS k)
       WHERE k <= len(form) GROUP BY 1, 2),
rl AS (SELECT suffix, arg_max(cut, 2 * n + CASE WHEN cut THEN 0 ELSE 1 END) AS cut FROM sf GROUP BY 1),
un AS (SELECT DISTINCT w FROM t WHERE w NOT IN (SELECT w FROM ev)),
rs AS (SELECT w, arg_max(cut, k) AS cut FROM un, (SELECT unnest(range(0, {lemma_trees.SUFFIX + 1})) AS k) JOIN rl ON right(w, k) = suffix
       WHERE k <= len(w) AND (NOT cut OR ends_with(w, 's')) GROUP BY 1)
SELECT form, CASE WHEN cut THEN form[:len(form) - 1] ELSE form END AS lemma, true AS known FROM lx
UNION ALL
SELECT un.w, CASE WHEN coalesce(rs.cut, false) THEN un.w[:len(un.w) - 1] ELSE un.w END, false FROM un LEFT JOIN rs USING (w)""")
def lemma_learned(spark, sf_dir):
    """Edit trees of the plurals and other words of even documents, applied
    to every word of all documents."""
    words = _vocabulary(spark, sf_dir)
    even = words.where("half = 0").select("form")
    stem = F.substring("form", F.lit(1), F.length("form") - 1)
    plural = even.where((F.length("form") >= 4) & F.col("form").endswith("s")).select("form", stem.alias("lemma")).join(
        even.withColumnRenamed("form", "lemma"), "lemma").select("form", "lemma")
    pairs = even.join(plural, "form", "left").select("form", F.coalesce("lemma", "form").alias("lemma"))
    return lemma_trees.resolve(words, lemma_trees.induce(pairs))


_PLAIN = "^[a-z]{5}$"


@register("spelling_at_size", f"""
WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^a-z]+')) AS w FROM documents),
p AS (SELECT list({{'gb': w, 'us': reverse(w)}} ORDER BY md5(w)) AS pairs FROM t WHERE regexp_matches(w, '{_PLAIN}'))
SELECT doc_id, md5(list_reduce(list_concat([{{'gb': '', 'us': text}}], pairs),
                               lambda a, x: {{'gb': '', 'us': replace(a.us, x.gb, x.us)}}).us) AS folded_md5
FROM documents, p WHERE text IS NOT NULL
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def spelling_at_size(spark, sf_dir):
    """Every five-letter word of the corpus spelt backwards, in the order
    of a hash, in every document (replacements make and break later ones)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.split("text", "[^a-z]+")).alias("gb")).distinct().where(F.col("gb").rlike(_PLAIN))
    table = words.select(F.md5(F.col("gb").cast("binary")).alias("pos"), "gb", F.reverse("gb").alias("us"))
    return spelling.fold_spelling(docs, cut_lineage(table, "spelling")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("folded_md5"))
