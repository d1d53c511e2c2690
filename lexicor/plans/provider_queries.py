"""Provider scans, files and predicates (S3-S8, S12, P1-P7, F5) as queries.

Builders land payloads shaped from ``documents`` in a fresh folder under the
shared checkpoint folder: pages of records as JSON lines, articles as XML. The
readers, projections and reject rules then run on those files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import embeddings as em
from ..operators import rejects as rj
from ..operators import search
from ..operators import store as st
from ..session import load, numbered, scratch_path
from ..sources import providers as pv
from .registry import register

PAGE = 20


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _pages(records, wrap):
    """One row per page of ``PAGE`` records; ``wrap`` makes it a payload."""
    pages = records.groupBy(F.floor(F.col("doc_id") / PAGE).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "r"))).alias("rs"))
    return pages.select(*wrap(F.transform("rs", lambda x: x["r"])))


def _date():
    """P3 input: a date with one-digit parts, an empty one, an impossible one."""
    day = F.concat_ws("-", (2000 + F.col("doc_id") % 20).cast("string"), (1 + F.col("doc_id") % 12).cast("string"),
                      (1 + F.col("doc_id") % 28).cast("string"))
    return F.when(F.col("doc_id") % 3 == 0, day).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("2020-13-40"))


_DATE_SQL = ("CASE WHEN doc_id % 3 = 0 THEN make_date(2000 + doc_id % 20, 1 + doc_id % 12, 1 + doc_id % 28) END"
             " AS publication_date")


def _title(c="doc_id"):
    return F.concat_ws("-", "source", F.col(c).cast("string"))


@register("springer_scan", f"""
SELECT CASE WHEN doc_id % 7 <> 6 THEN '10.2/' || doc_id ELSE '' END AS doi, source || '-' || doc_id AS title, text AS abstract,
       CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' || doc_id ELSE 'https://h.example/' || doc_id END AS url,
       lang || ', ' || source AS creators, source AS publication_name, lang || '-1' AS issn, lang || '-2' AS eissn,
       {_DATE_SQL}, CASE WHEN doc_id % 7 = 6 THEN 'no_id' WHEN length(text) = 0 THEN 'no_abstract' END AS reject_reason
FROM documents""")
def springer_scan(spark, sf_dir):
    """S3 with P1, P3, P6, P7a and F1/F2: landed response pages read,
    projected and checked."""
    d = _docs(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    rec = F.struct(
        F.when(F.col("doc_id") % 7 != 6, F.concat(F.lit("10.2/"), key)).otherwise("").alias("doi"), _title().alias("title"),
        F.col("text").alias("abstract"), F.col("source").alias("publicationName"),
        F.concat("lang", F.lit("-1")).alias("issn"), F.concat("lang", F.lit("-2")).alias("eIssn"), _date().alias("publicationDate"),
        F.when(F.col("doc_id") % 2 == 0, F.array(
            F.struct(F.lit("pdf").alias("format"), F.concat(F.lit("https://p.example/"), key).alias("value")),
            F.struct(F.lit("").alias("format"), F.concat(F.lit("https://a.example/"), key).alias("value"))))
        .otherwise(F.array(F.struct(F.lit("html").alias("format"), F.concat(F.lit("https://h.example/"), key).alias("value"))))
        .alias("url"),
        F.array(F.struct(F.concat_ws(", ", "lang", "source").alias("creator"))).alias("creators"))
    path = scratch_path(spark, "springer-landing")
    _pages(d.select("doc_id", rec.alias("r")), lambda rs: [
        F.array(F.struct(F.size(rs).cast("string").alias("total"))).alias("result"), rs.alias("records")]).write.json(path)
    arts = rj.with_reject_reason(pv.springer_articles(pv.read_springer(spark, path, multi_line=False)), "springer")
    return arts.select("doi", "title", "abstract", "url", F.array_join("creators", "|").alias("creators"),
                       "publication_name", "issn", "eissn", "publication_date", "reject_reason")


def _xml(c):
    out = F.regexp_replace(c, "[\\x00-\\x08\\x0B-\\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@register("pubmed_scan", """
SELECT CASE WHEN doc_id % 2 = 0 THEN '10.3/' || doc_id END AS doi, CAST(doc_id AS VARCHAR) AS uid,
       'On ' || source || ' (' || doc_id || ')' AS title, '1-' || lang AS issn, '2-' || lang AS eissn,
       lang || ', ' || source || '|' || source || ', ' AS creators,
       CASE WHEN doc_id % 3 = 0 THEN make_date(2000 + doc_id % 20, 1 + doc_id % 12, 1 + doc_id % 28) END AS publication_date,
       trim(regexp_replace(text, '<[A-Za-z/!?][^>]*>', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS abstract
FROM documents""")
def pubmed_scan(spark, sf_dir):
    """S4 with P1, P3, P4, P5 and P7c: landed article XML read and projected.
    (The XML reader drops white space at the ends of a text.)"""
    key = F.col("doc_id").cast("string")

    def tag(name, *parts):
        return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name.split(' ')[0]}>"))

    date = F.when(F.col("doc_id") % 3 == 0, tag("ArticleDate", *[
        tag(n, v.cast("string")) for n, v in (("Year", 2000 + F.col("doc_id") % 20), ("Month", 1 + F.col("doc_id") % 12),
                                              ("Day", 1 + F.col("doc_id") % 28))])).otherwise("")
    ids = F.when(F.col("doc_id") % 2 == 0, tag('ELocationID EIdType="doi"', F.lit("10.3/"), key)).otherwise("")
    article = tag(
        "Article",
        tag("Journal", tag('ISSN IssnType="Print"', F.lit("1-"), "lang"), tag('ISSN IssnType="Electronic"', F.lit("2-"), "lang"),
            tag("Title", F.lit("J <i>"), "source", F.lit("</i>"))),
        tag("ArticleTitle", F.lit("On <b>"), "source", F.lit("</b> ("), key, F.lit(")")),
        tag('ELocationID EIdType="pii"', F.lit("x"), key), ids,
        tag("Abstract", tag("AbstractText", _xml(F.col("text")))),
        tag("AuthorList", tag("Author", tag("LastName", "lang"), tag("ForeName", "source")),
            tag("Author", tag("LastName", "source"))), date)
    path = scratch_path(spark, "pubmed-landing")
    rows = _docs(spark, sf_dir).select(
        tag("PubmedArticle", tag("MedlineCitation", tag('PMID Version="1"', key), article)).alias("value"))

    def one_set(batches):  # every file is one document
        yield pa.RecordBatch.from_arrays([pa.array(["<PubmedArticleSet>"])], ["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</PubmedArticleSet>"])], ["value"])

    rows.mapInArrow(one_set, "value string").write.text(path)
    arts = pv.pubmed_articles(pv.read_pubmed(spark, path))
    return arts.select("doi", "uid", "title", "issn", "eissn", F.array_join("creators", "|").alias("creators"),
                       "publication_date", "abstract")


def _elsevier_listing(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    rec = F.struct(
        F.concat(F.lit("10.4/"), key).alias("prism:doi"), F.col("text").alias("prism:teaser"), _title().alias("dc:title"),
        F.concat(F.lit("https://e.example/"), key).alias("prism:url"), F.col("source").alias("prism:publicationName"),
        _date().alias("prism:coverDate"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.col("lang").alias("$")), F.struct(F.col("source").alias("$")))).alias("dc:creator"))
    path = scratch_path(spark, "elsevier-landing")
    _pages(_docs(spark, sf_dir).select("doc_id", rec.alias("r")), lambda rs: [
        F.struct(F.size(rs).cast("string").alias("opensearch:totalResults"), rs.alias("entry")).alias("search-results")]).write.json(path)
    return pv.read_elsevier_search(spark, path, multi_line=False)


@register("elsevier_scan", f"""
SELECT '10.4/' || doc_id AS doi, source || '-' || doc_id AS title, text AS abstract, 'https://e.example/' || doc_id AS url,
       CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source END AS creators, source AS publication_name, {_DATE_SQL}
FROM documents""")
def elsevier_scan(spark, sf_dir):
    """S5 with P1, P3 and P7d: landed search pages read and projected."""
    arts = pv.elsevier_search_articles(_elsevier_listing(spark, sf_dir))
    return arts.select("doi", "title", "abstract", "url", F.array_join("creators", "|").alias("creators"),
                       "publication_name", "publication_date")


@register("elsevier_payloads", f"""
SELECT '10.4/' || doc_id AS doi, CASE WHEN doc_id % 5 > 1 THEN upper(lang) || ': ' || text END AS abstract,
       CASE WHEN doc_id % 5 > 1 THEN lang || '|' || source END AS creators,
       CASE WHEN doc_id % 5 > 1 THEN {_DATE_SQL.split(' AS pub')[0]} END AS publication_date,
       CASE WHEN doc_id % 5 <= 1 THEN 'no_abstract' END AS reject_reason
FROM documents""")
def elsevier_payloads(spark, sf_dir):
    """The listing's DOIs with their payloads; a fifth has none and a
    fifth cannot be read, and both are counted by the reject rules."""
    key = F.col("doc_id").cast("string")
    core = F.struct(F.struct(F.struct(
        _title().alias("dc:title"), F.concat_ws(": ", F.upper("lang"), "text").alias("dc:description"), _date().alias("prism:coverDate"),
        F.array(F.struct(F.col("lang").alias("$")), F.struct(F.col("source").alias("$"))).alias("dc:creator")).alias("coredata"))
        .alias("full-text-retrieval-response"))
    path = scratch_path(spark, "elsevier-payloads")
    (_docs(spark, sf_dir).where("doc_id % 5 > 0").select(
        F.concat(F.lit("10.4/"), key).alias("doi"),
        F.when(F.col("doc_id") % 5 == 1, F.lit("{not json")).otherwise(F.to_json(core)).alias("payload")).write.json(path))
    arts = pv.elsevier_two_phase(_elsevier_listing(spark, sf_dir), pv.read_elsevier_payloads(spark, path))
    return rj.with_reject_reason(arts, "elsevier").select(
        "doi", "abstract", F.array_join("creators", "|").alias("creators"), "publication_date", "reject_reason")


@register("search_predicate", """
SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND lang = 'en' AND contains(lower(text), 'the')""")
def search_predicate(spark, sf_dir):
    """journal articles of one subject whose text has a keyword."""
    d = _docs(spark, sf_dir).withColumn("type", F.when(F.col("doc_id") % 3 == 0, "Book").otherwise("Journal"))
    return d.where(search.search_filter(d, subject_col="lang", text_col="text", subject="en", keyword="The")).select("doc_id")


@register("keyword_file", """
SELECT trim(k) AS keyword, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS k FROM benchmark)
WHERE trim(k) <> '' GROUP BY 1""")
def keyword_file(spark, sf_dir):
    """A keyword file (one per line, padded, blank lines between) read,
    stripped and counted."""
    path = scratch_path(spark, "keywords")
    line = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("  \n ")), F.lit(" \n   "))
    load(spark, sf_dir, "benchmark").select(line).write.text(path)
    return pv.read_keywords(spark, path).groupBy("keyword").agg(F.count("*").alias("n"))


@register("spelling_file", """
SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name || ' ' || p_partkey AS gb, p_type AS us FROM part""")
def spelling_file(spark, sf_dir):
    """A large spelling table, landed as one JSON line an entry with its
    position and read as the ordered table."""
    part = load(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("gb"), F.col("p_type").alias("us"))
    order = [F.col(c).asc_nulls_last() for c in ("p_partkey", "gb", "us")]
    path = scratch_path(spark, "spelling")
    numbered(part, order, "pos").select("pos", "gb", "us").write.json(path)
    return pv.read_spelling_lines(spark, path)


@register("vector_file", """
SELECT vec_id AS word, round(sqrt(list_sum([x * x for x in embedding::DOUBLE[]])), 4) AS norm,
       round(embedding[1]::DOUBLE, 4) AS first FROM embeddings""")
def vector_file(spark, sf_dir):
    """The vector table saved and loaded again."""
    from ..functions import vectors as vx

    path = scratch_path(spark, "vectors")
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    em.save_vectors(e, path)
    got = spark.read.parquet(path)
    return got.select("word", F.round(vx.norm(F.col("vector")), 4).alias("norm"),
                      F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("first"))


@register("article_json", """
SELECT doc_id::VARCHAR AS paperid, text AS abstract, CASE WHEN lang = 'en' THEN '10.1/' || doc_id END AS doi,
       CASE WHEN lang = 'en' THEN 3 ELSE 2 END AS n_fields FROM documents""")
def article_json(spark, sf_dir):
    """Articles written as JSON lines without null fields, and read back;
    ``n_fields`` counts the fields a line has."""
    d = _docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("paperid"), F.col("text").alias("abstract"),
        F.when(F.col("lang") == "en", F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("doi"), "lang")
    path = scratch_path(spark, "articles")
    pv.write_articles(pv.unified(d.drop("lang")), path)
    line = spark.read.text(path)
    obj = F.from_json("value", "paperid string, abstract string, doi string")
    return line.select(obj.alias("o"), F.size(F.json_object_keys("value")).alias("n_fields")).select("o.*", "n_fields")


@register("bucket_upsert", """
WITH k AS (SELECT doc_id % 400 AS k, doc_id, doc_id % 3 AS batch, lang FROM documents),
f AS (SELECT k, min(batch) AS b FROM k GROUP BY k)
SELECT 'doi' AS key_type, '10.1/' || k.k AS key, min(doc_id) FILTER (WHERE batch = f.b) AS doc_id,
       array_to_string(list_sort(list_distinct(list(lang))), ',') AS tags
FROM k JOIN f USING (k) GROUP BY k.k""")
def bucket_upsert(spark, sf_dir):
    """U1, U2 on the stored table: three batches into hash buckets, each
    rewriting only the buckets that its keys fall into."""
    root = scratch_path(spark, "bucket-store")
    d = _docs(spark, sf_dir).select(
        F.lit("doi").alias("key_type"), F.concat(F.lit("10.1/"), (F.col("doc_id") % 400).cast("string")).alias("key"), "doc_id",
        F.array("lang").alias("tags"), F.col("doc_id").alias("_seq"))
    for batch in range(3):
        st.upsert_into(spark, root, d.where(F.col("doc_id") % 3 == batch), ["doc_id"])
    return st.read_buckets(spark, root).select(*st.KEY, "doc_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))
