"""Ingest, reject, identity, upsert, tag and metric queries (F1-F4, F6, P9,
U1-U8, A1-A3) over ``documents`` + ``labels`` + ``benchmark``.

Stand-in provider rows are shaped from ``documents``: identifiers from simple
rules on the row (some empty, some shared between documents), an empty
abstract for very short texts, and the two label columns as the predictions
of two classifiers (``quality`` = quality, ``clean`` = not toxic). Batches
are split by ``doc_id`` parity. The operators see only rows of the unified
article schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import GENERAL_TAG
from ..operators import rejects as rj
from ..operators import search
from ..operators import store as st
from ..session import load
from .registry import register

_TAGS = ["quality", "clean"]
_FIELDS = ["doc_id", "database", "title"]
_TAG_RENAMES = [("draft_a", "set_2"), ("draft_b", "set_1")]
_COUNT_TAGS = ["draft_b", "set_1", "set_2", "draft_a", GENERAL_TAG]


def articles(spark, sf_dir):
    """Unified-schema rows (plus doc_id, predictions and an arrival order)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(F.lit("10.1000/"), (F.col("doc_id") % 400).cast("string")))
        .otherwise(F.lit("")).alias("doi"),
        F.when(F.col("source").isin("src1", "src2", "src3"), F.concat(F.lit("pm"), F.col("doc_id").cast("string")))
        .alias("uid"),
        F.when(F.col("lang") == "de", F.concat(F.lit("PMC"), F.col("doc_id").cast("string"))).alias("pmc"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("p"), (F.col("doc_id") % 500).cast("string")))
        .alias("paperid"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("n_chars") < 40, F.lit("")).otherwise(F.col("text")).alias("abstract"),
        F.lit("s2orc").alias("database"),
        F.col("quality").alias("pred_quality"),
        (F.lit(1) - F.col("toxic")).alias("pred_clean"),
        (F.col("doc_id") % 2).alias("batch"),
        F.col("doc_id").alias("_seq"),
        F.array("lang", "source").alias("base_tags"))


_ART_SQL = """
art AS (
  SELECT d.doc_id,
         CASE WHEN d.lang = 'en' THEN '10.1000/' || CAST(d.doc_id % 400 AS VARCHAR) ELSE '' END AS doi,
         CASE WHEN d.source IN ('src1', 'src2', 'src3') THEN 'pm' || CAST(d.doc_id AS VARCHAR) END AS uid,
         CASE WHEN d.lang = 'de' THEN 'PMC' || CAST(d.doc_id AS VARCHAR) END AS pmc,
         CASE WHEN d.lang <> 'fr' THEN 'p' || CAST(d.doc_id % 500 AS VARCHAR) END AS paperid,
         concat_ws('-', d.source, CAST(d.doc_id AS VARCHAR)) AS title,
         CASE WHEN d.n_chars < 40 THEN '' ELSE d.text END AS abstract,
         l.quality AS pred_quality, 1 - l.toxic AS pred_clean, d.doc_id % 2 AS batch,
         [d.lang, d.source] AS base_tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
rr AS (
  SELECT *, CASE WHEN coalesce(nullif(uid, ''), nullif(pmc, ''), nullif(doi, ''), nullif(paperid, '')) IS NULL THEN 'no_id'
                 WHEN coalesce(length(abstract), 0) = 0 THEN 'no_abstract' END AS reject_reason
  FROM art),
idn AS (
  SELECT *, CASE WHEN nullif(doi, '') IS NOT NULL THEN 'doi' WHEN nullif(uid, '') IS NOT NULL THEN 'uid'
                 WHEN nullif(pmc, '') IS NOT NULL THEN 'pmc' WHEN nullif(paperid, '') IS NOT NULL THEN 'paperid' END AS key_type,
            coalesce(nullif(doi, ''), nullif(uid, ''), nullif(pmc, ''), nullif(paperid, '')) AS key
  FROM rr WHERE reject_reason IS NULL),
tagged AS (
  SELECT *, list_filter([CASE WHEN pred_quality = 1 THEN 'quality' END, CASE WHEN pred_clean = 1 THEN 'clean' END,
                         '""" + GENERAL_TAG + """'], lambda x: x IS NOT NULL) AS tags
  FROM idn)"""


def _accepted(spark, sf_dir):
    a = rj.with_reject_reason(articles(spark, sf_dir), "s2orc")
    return a.where(F.col("reject_reason").isNull())


def _tagged(spark, sf_dir):
    """Accepted rows with identity and tags: every classifier predicting 1
    adds its tag (U3); the general tag is added to all rows (U4)."""
    a = rj.with_identity(_accepted(spark, sf_dir))
    preds = {t: F.col(f"pred_{t}") for t in _TAGS}
    return a.withColumn("tags", F.array_append(st.tags_from_predictions(preds), F.lit(GENERAL_TAG)))


@register("reject_counts", "WITH " + _ART_SQL.strip() + """
SELECT reject_reason, count(*) AS n FROM rr WHERE reject_reason IS NOT NULL GROUP BY reject_reason""")
def reject_counts(spark, sf_dir):
    """per-reason reject counts in one pass (no id, no abstract)."""
    return rj.reject_counts(rj.with_reject_reason(articles(spark, sf_dir), "s2orc"))


@register("identity_choice", "WITH " + _ART_SQL.strip() + """
SELECT doc_id, key_type, key, CASE WHEN key_type = 'doi' THEN doi END AS doi,
       CASE WHEN key_type = 'uid' THEN uid END AS uid, CASE WHEN key_type = 'pmc' THEN pmc END AS pmc,
       CASE WHEN key_type = 'paperid' THEN paperid END AS paperid FROM idn""")
def identity_choice(spark, sf_dir):
    """Doi > uid > pmc > paperid; losing identifiers cleared."""
    return rj.with_identity(_accepted(spark, sf_dir)).select(
        "doc_id", "key_type", "key", "doi", "uid", "pmc", "paperid")


def _two_batch_store(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    store1, _ = st.upsert(None, rows.where("batch = 0"), _FIELDS)
    store2, per_key = st.upsert(store1, rows.where("batch = 1"), _FIELDS)
    return store2, per_key, rows


@register("upsert_first_wins", "WITH " + _ART_SQL.strip() + """,
k AS (SELECT key_type, key, min(batch) AS first_batch FROM tagged GROUP BY ALL)
SELECT t.key_type, t.key, min(t.doc_id) FILTER (WHERE t.batch = k.first_batch) AS doc_id,
       array_to_string(list_sort(list_distinct(flatten(list(t.tags)))), ',') AS tags
FROM tagged t JOIN k USING (key_type, key) GROUP BY t.key_type, t.key""")
def upsert_first_wins(spark, sf_dir):
    """U1 + U2 + U3 + U4: two batches upserted in order; the first writer's
    fields are kept, tag sets accumulate."""
    store, _, _ = _two_batch_store(spark, sf_dir)
    return store.select("key_type", "key", "doc_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@register("store_metrics", "WITH " + _ART_SQL.strip() + """,
b0 AS (SELECT DISTINCT key_type, key, unnest(tags) AS tag FROM tagged WHERE batch = 0),
b1 AS (SELECT DISTINCT key_type, key, unnest(tags) AS tag FROM tagged WHERE batch = 1),
rel AS (SELECT tag, count(*) AS relevant FROM b1 WHERE NOT EXISTS (
          SELECT 1 FROM b0 WHERE b0.key_type = b1.key_type AND b0.key = b1.key AND b0.tag = b1.tag) GROUP BY tag),
tot AS (SELECT 'quality' AS tag, count(*) AS total, count(*) FILTER (WHERE coalesce(pred_quality, 0) <> 1) AS irrelevant
        FROM tagged WHERE batch = 1
        UNION ALL SELECT 'clean', count(*), count(*) FILTER (WHERE coalesce(pred_clean, 0) <> 1) FROM tagged WHERE batch = 1)
SELECT tot.tag, tot.total, coalesce(rel.relevant, 0) AS relevant, tot.irrelevant,
       tot.total - coalesce(rel.relevant, 0) - tot.irrelevant AS already_tagged
FROM tot LEFT JOIN rel USING (tag)""")
def store_metrics(spark, sf_dir):
    """A2: per classifier tag for the second batch: analysed, newly stored or
    newly tagged, predicted irrelevant, already tagged."""
    _, per_key, rows = _two_batch_store(spark, sf_dir)
    return st.store_metrics(rows.where("batch = 1"), per_key, _TAGS)


@register("general_tag_metrics", "WITH " + _ART_SQL.strip() + """,
k0 AS (SELECT DISTINCT key_type, key FROM tagged WHERE batch = 0),
k1 AS (SELECT DISTINCT key_type, key FROM tagged WHERE batch = 1)
SELECT (SELECT count(*) FROM tagged WHERE batch = 1) AS total,
       (SELECT count(*) FROM k1 WHERE NOT EXISTS (SELECT 1 FROM k0 WHERE k0.key_type = k1.key_type AND k0.key = k1.key)) AS new""")
def general_tag_metrics(spark, sf_dir):
    """A3: second batch under the general tag: analysed and newly stored."""
    _, per_key, rows = _two_batch_store(spark, sf_dir)
    total = rows.where("batch = 1").select(F.count("*").alias("total"))
    new = per_key.select(F.count_if("is_new").alias("new"))
    return total.select("total", new.select("new").scalar().alias("new"))


@register("unique_check", "WITH " + _ART_SQL.strip() + """
SELECT id_type, value, n FROM (
  SELECT 'doi' AS id_type, doi AS value, count(*) AS n FROM art WHERE doi IS NOT NULL AND doi <> '' GROUP BY doi
  UNION ALL SELECT 'uid', uid, count(*) FROM art WHERE uid IS NOT NULL AND uid <> '' GROUP BY uid
  UNION ALL SELECT 'pmc', pmc, count(*) FROM art WHERE pmc IS NOT NULL AND pmc <> '' GROUP BY pmc) WHERE n > 1""")
def unique_check(spark, sf_dir):
    """U8: sparse-unique identifiers that occur more than once in the raw
    rows (the upsert keeps one row per key)."""
    return st.unique_violations(articles(spark, sf_dir))


_RENAME_SQL = "WITH " + _ART_SQL.strip() + """,
t0 AS (SELECT doc_id, list_filter(list_concat(base_tags, [CASE WHEN pred_quality = 1 THEN 'draft_a' END,
                                          CASE WHEN pred_clean = 0 THEN 'draft_b' END]), lambda x: x IS NOT NULL) AS tags
       FROM art),
t1 AS (SELECT doc_id, tags AS before,
              CASE WHEN list_contains(tags, 'draft_a') THEN list_filter(list_distinct(list_concat(tags, ['set_2'])), lambda x: x <> 'draft_a') ELSE tags END AS tags
       FROM t0),
t2 AS (SELECT doc_id, before,
              CASE WHEN list_contains(tags, 'draft_b') THEN list_filter(list_distinct(list_concat(tags, ['set_1'])), lambda x: x <> 'draft_b') ELSE tags END AS tags
       FROM t1)"""


def _renamed(spark, sf_dir):
    a = articles(spark, sf_dir).select(
        "doc_id", F.array_compact(F.concat("base_tags", F.array(
            F.when(F.col("pred_quality") == 1, F.lit("draft_a")),
            F.when(F.col("pred_clean") == 0, F.lit("draft_b"))))).alias("tags"))
    return st.rename_tags(a, _TAG_RENAMES)


@register("tag_rename", _RENAME_SQL + """
SELECT doc_id, array_to_string(list_sort(tags), ',') AS tags, list_sort(before) <> list_sort(tags) AS changed FROM t2""")
def tag_rename(spark, sf_dir):
    """draft_a -> set_2 and draft_b -> set_1 over every article."""
    r = _renamed(spark, sf_dir)
    return r.select("doc_id", F.array_join(F.array_sort("tags"), ",").alias("tags"), "changed")


@register("tag_counts", _RENAME_SQL + """,
c AS (SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM t2) GROUP BY tag),
w AS (SELECT unnest(""" + "[" + ", ".join("'" + t + "'" for t in _COUNT_TAGS) + """]) AS tag)
SELECT w.tag, coalesce(c.n, 0) AS n FROM w LEFT JOIN c USING (tag)""")
def tag_counts(spark, sf_dir):
    """A1: documents per tag for the fixed tag list (absent tags give 0)."""
    return st.tag_counts(_renamed(spark, sf_dir), _COUNT_TAGS)


@register("load_new_vs_old", """
WITH lab AS (
  SELECT 'quality' AS name, doc_id, quality = 1 AS relevant FROM labels
  UNION ALL SELECT 'toxic', doc_id, toxic = 1 FROM labels),
first AS (SELECT DISTINCT name, doc_id FROM lab WHERE doc_id % 2 = 0)
SELECT name, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.name = l.name AND f.doc_id = l.doc_id)) AS stored_new,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM first f WHERE f.name = l.name AND f.doc_id = l.doc_id)) AS already_stored
FROM (SELECT DISTINCT name, doc_id FROM lab) l GROUP BY name""")
def load_new_vs_old(spark, sf_dir):
    """U5 + U6: labelled sets (one per label column) loaded twice - first the
    even ids, then all ids - reporting newly stored vs already stored."""
    lab = load(spark, sf_dir, "labels")
    rows = lab.select(F.lit("quality").alias("name"), F.col("doc_id").alias("id"),
                      (F.col("quality") == 1).alias("relevant"), F.col("doc_id").alias("_seq")).unionByName(
        lab.select(F.lit("toxic").alias("name"), F.col("doc_id").alias("id"),
                   (F.col("toxic") == 1).alias("relevant"), F.col("doc_id").alias("_seq")))
    store, _, _ = st.insert_if_absent(None, rows.where(F.col("id") % 2 == 0))
    _, counts, _ = st.insert_if_absent(store, rows)
    return counts


@register("keyword_hits", """
SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def keyword_hits(spark, sf_dir):
    """every ``benchmark`` passage used as a keyword against every
    document (case-insensitive containment)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kw = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("kw_id"), F.col("text").alias("keyword"))
    hits = search.keyword_hits(docs, kw, text_col="text")
    return hits.select(F.col("kw_id").alias("item_id"), "doc_id")


@register("tagged_corpus_size", "WITH " + _ART_SQL.strip() + """,
st AS (SELECT key_type, key, list_distinct(flatten(list(tags))) AS tags FROM tagged GROUP BY ALL),
w AS (SELECT unnest(['quality', 'clean', '""" + GENERAL_TAG + """', 'set_1']) AS tag)
SELECT w.tag, (SELECT count(*) FROM st WHERE list_contains(st.tags, w.tag)) AS n FROM w""")
def tagged_corpus_size(spark, sf_dir):
    """S9 + A4: per tag, the size of the corpus a training job would read
    (rows of the store whose tag set holds the tag; absent tag -> 0)."""
    store, _, _ = _two_batch_store(spark, sf_dir)
    return st.tag_counts(store, ["quality", "clean", GENERAL_TAG, "set_1"])
