"""Learned lemmatiser (T15): edit trees of a lexicon, and a suffix trie.

A lexicon pairs forms with lemmas. How a form becomes its lemma is an edit
tree: the longest common part stays, what is before and behind it is changed
by trees of their own, down to plain replacements (after Chrupala, 2008). Trees
are counted under every suffix of their forms up to ``SUFFIX`` characters; the
most frequent one of a suffix is that node's rule. A form of the lexicon has its
lemma from there; any other takes the rule of its longest suffix whose tree
fits, and stays as it is if there is none.

Everything runs on distinct forms: induction and application of a tree are small
row functions, counting and finding are aggregations and joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Longest suffix of the trie.
SUFFIX = 5


@dataclass(frozen=True)
class LemmaModel:
    """``lexicon``: ``form, lemma``; ``rules``: ``suffix, tree, n`` with one
    row a suffix."""

    lexicon: DataFrame
    rules: DataFrame


def common_part(a: str, b: str) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the longest common
    substring, the leftmost in ``a``, then in ``b``."""
    best = (0, 0, 0)
    ends = [0] * (len(b) + 1)
    for i in range(len(a)):
        new = [0] * (len(b) + 1)
        for j in range(len(b)):
            if a[i] == b[j]:
                n = new[j + 1] = ends[j] + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
        ends = new
    return best


def edit_tree(form: str, lemma: str):
    """``[before, behind, tree before, tree behind]``, the numbers counting the
    form's characters around the common part, or ``[form, lemma]`` without one."""
    i, j, n = common_part(form, lemma)
    if not n:
        return [form, lemma]
    return [i, len(form) - i - n, edit_tree(form[:i], lemma[:j]), edit_tree(form[i + n:], lemma[j + n:])]


def apply_tree(tree, form: str) -> str | None:
    """The lemma, or None where the tree does not fit."""
    if len(tree) == 2:
        return tree[1] if form == tree[0] else None
    before, behind, left, right = tree
    if len(form) <= before + behind:
        return None
    a, b = apply_tree(left, form[:before]), apply_tree(right, form[len(form) - behind:])
    return None if a is None or b is None else a + form[before:len(form) - behind] + b


def _suffixes(col: str, longest: int):
    size = F.least(F.lit(longest), F.length(col))
    return F.transform(F.sequence(F.lit(0), size), lambda k: F.substring(col, F.length(col) - k + 1, k))


def induce(pairs: DataFrame, *, form_col: str = "form", lemma_col: str = "lemma", suffix: int = SUFFIX) -> LemmaModel:
    """A model of ``pairs``. A form with several lemmas has the most frequent
    (the first by code point of equal ones); pairs with a null or an empty form
    are left out. An empty table gives a model that changes nothing."""
    known = pairs.where(F.col(form_col).isNotNull() & F.col(lemma_col).isNotNull() & (F.length(form_col) > 0))
    counts = known.groupBy(F.col(form_col).alias("form"), F.col(lemma_col).alias("lemma")).agg(F.count("*").alias("n"))
    best = counts.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("best"))
    lexicon = cut_lineage(best.select("form", "best.lemma"), "lexicon")

    def run(batches):
        for b in batches:
            trees = [json.dumps(edit_tree(f, x), separators=(",", ":")) for f, x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.string())], ["form", "tree"])

    trees = lexicon.select("form", "lemma").mapInArrow(run, "form string, tree string")
    rows = trees.select(F.explode(_suffixes("form", suffix)).alias("suffix"), "tree").groupBy("suffix", "tree").agg(F.count("*").alias("n"))
    rules = rows.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "tree")).alias("best"))
    return LemmaModel(lexicon, cut_lineage(rules.select("suffix", "best.tree", (-F.col("best.n")).alias("n")), "rules"))


def resolve(forms: DataFrame, model: LemmaModel, *, form_col: str = "form", suffix: int = SUFFIX) -> DataFrame:
    """``form, lemma, known`` of the distinct non-null forms of ``forms``:
    ``known`` where the lexicon has the form. This is a lemma table that
    ``functions.text.lemmatize_column`` joins back to tokens."""
    distinct = forms.select(F.col(form_col).alias("form")).where(F.col("form").isNotNull()).distinct()
    found = cut_lineage(distinct.join(model.lexicon, "form", "left"), "forms")
    unseen = found.where("lemma is null").select("form", F.explode(_suffixes("form", suffix)).alias("suffix"))
    ruled = unseen.join(model.rules.select("suffix", "tree"), "suffix").groupBy("form").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.length("suffix").alias("n"), "tree")), asc=False), lambda x: x["tree"]).alias("trees"))
    none = found.where("lemma is null").select("form").join(ruled, "form", "left")

    def run(batches):
        for b in batches:
            out = []
            for form, trees in zip(*(c.to_pylist() for c in b.columns)):
                got = (apply_tree(json.loads(t), form) for t in trees or ())
                out.append(next((x for x in got if x is not None), form))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["form", "lemma"])

    new = none.mapInArrow(run, "form string, lemma string").withColumn("known", F.lit(False))
    return found.where("lemma is not null").withColumn("known", F.lit(True)).unionByName(new)
