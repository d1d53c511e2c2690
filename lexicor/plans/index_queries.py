"""Substring search by trigram lists (F5) and the tagged scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import GENERAL_TAG
from ..operators import store as st
from ..operators import trigrams
from ..session import load, scratch_path
from .registry import register
from .store_queries import _ART_SQL, _two_batch_store


@register("search_by_index", """
WITH k AS (SELECT DISTINCT substr(text, 15, 9) AS keyword FROM benchmark WHERE length(substr(text, 15, 9)) > 0
           UNION SELECT DISTINCT substr(text, 20, 2) FROM benchmark WHERE length(substr(text, 20, 2)) > 0)
SELECT k.keyword, d.doc_id FROM k JOIN documents d ON contains(lower(d.text), lower(k.keyword))""")
def search_by_index(spark, sf_dir):
    """a stretch of every benchmark passage, and two of its characters,
    looked up in the trigram index of all documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    text = load(spark, sf_dir, "benchmark").select("text")
    words = [text.select(F.substring("text", a, n).alias("keyword")) for a, n in ((15, 9), (20, 2))]
    index = trigrams.build(docs, scratch_path(spark, "trigrams"))
    return trigrams.search(index, words[0].unionByName(words[1])).withColumnRenamed("id", "doc_id")


@register("tagged_scan", "WITH " + _ART_SQL.strip() + f""",
s AS (SELECT key_type, key, list_distinct(flatten(list(tags))) AS tags FROM tagged GROUP BY ALL)
SELECT w.tag, key_type, key, array_to_string(list_sort(tags), ',') AS tags
FROM s, (SELECT unnest(['quality', 'clean', '{GENERAL_TAG}', 'src3']) AS tag) w WHERE list_contains(tags, w.tag)""")
def tagged_scan(spark, sf_dir):
    """The stored articles of four tags, read from the table partitioned by
    tag signature; partitions without a tag's bit are not read."""
    store, _, _ = _two_batch_store(spark, sf_dir)
    path = scratch_path(spark, "tagged")
    st.write_tagged(store, path)
    out = None
    for tag in ("quality", "clean", GENERAL_TAG, "src3"):
        part = st.scan_tagged(spark, path, tag, store.schema).select(
            F.lit(tag).alias("tag"), "key_type", "key", F.array_join(F.array_sort("tags"), ",").alias("tags"))
        out = part if out is None else out.unionByName(part)
    return out
