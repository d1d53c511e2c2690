"""Learned sentence borders (T1) over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import borders
from ..session import cut_lineage, load
from .registry import register

_EDGES = borders.EDGES_RE.replace("'", "''")


def _type(chunk: str) -> str:
    return f"lower(regexp_replace(regexp_replace({chunk}, '{_EDGES}', '', 'g'), '\\.$', ''))"


_COUNTS = f"""
WITH ln AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
ch AS (SELECT generate_subscripts(c, 1) AS i, unnest(c) AS chunk, unnest(list_concat([NULL], c[:-2])) AS prev
       FROM (SELECT list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> '') AS c FROM ln)),
ty AS (SELECT {_type('chunk')} AS word, regexp_replace(chunk, '{_EDGES}', '', 'g') AS bare,
              coalesce(NOT regexp_matches(prev, '[.!?]$'), false) AS inside FROM ch),
n AS (SELECT word, count(*) FILTER (ends_with(bare, '.')) AS stopped, count(*) FILTER (NOT ends_with(bare, '.')) AS plain,
             count(*) FILTER (regexp_matches(bare, '^\\p{{Ll}}')) AS lower,
             count(*) FILTER (regexp_matches(bare, '^\\p{{Lu}}') AND inside) AS inner_
      FROM ty WHERE regexp_matches(word, '\\p{{L}}') GROUP BY word),
p AS (SELECT sum(stopped)::DOUBLE / sum(stopped + plain)::DOUBLE AS p FROM n),
s AS (SELECT word, stopped, plain, len(word) - len(replace(word, '.', '')) AS dots, len(replace(word, '.', '')) AS size,
             2 * ((stopped * ln({borders.SURE}) + plain * ln(1 - {borders.SURE}::DOUBLE)) - (stopped * ln(p) + plain * ln(1 - p))) AS ratio
      FROM n, p WHERE stopped > 0),
ab AS (SELECT word, stopped, plain, ratio * exp(-size) * (dots + 1) * pow(size::DOUBLE, -plain) AS score FROM s
       WHERE ratio * exp(-size) * (dots + 1) * pow(size::DOUBLE, -plain) >= {borders.THRESHOLD})"""


def _learn(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    counts = cut_lineage(borders.type_counts(docs), "types")
    return docs, borders.abbreviations(counts), borders.starters(counts)


@register("abbreviations", _COUNTS + " SELECT word, stopped, plain, round(score, 6) AS score FROM ab")
def abbreviations(spark, sf_dir):
    """Types that the corpus shows to be abbreviations."""
    return _learn(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@register("learned_sentences", _COUNTS + f""",
pc AS (SELECT doc_id, line_no, generate_subscripts(s, 1) AS i, unnest(s) AS piece, unnest(list_concat(s[2:], [NULL])) AS nxt
       FROM (SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?])([ \\t]+)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(2)) AS s
             FROM ln)),
bd AS (SELECT doc_id, line_no, i, piece, string_split(piece, chr(1))[1] AS core, regexp_extract(nxt, '^[^ \\t\\r\\x01]*') AS after FROM pc),
kd AS (SELECT *, {_type("regexp_extract(core, '[^ \\t\\r]*$')")} AS kind, regexp_replace(after, '{_EDGES}', '', 'g') AS bare FROM bd),
fl AS (SELECT kd.*, CASE WHEN ends_with(core, '.') AND ab.word IS NOT NULL
                              AND NOT (regexp_matches(bare, '^\\p{{Lu}}') AND st.word IS NOT NULL) THEN 0 ELSE 1 END AS cut
       FROM kd LEFT JOIN ab ON ab.word = kd.kind
       LEFT JOIN (SELECT word FROM n WHERE lower > 0 AND inner_ = 0) st ON st.word = {_type('kd.bare')}),
gr AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM fl),
se AS (SELECT doc_id, line_no, g, trim(string_agg(replace(piece, chr(1), ''), '' ORDER BY i), ' ' || chr(9) || chr(13)) AS sentence
       FROM gr GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, g) - 1 AS sent_no, sentence FROM se WHERE sentence <> ''""")
def learned_sentences(spark, sf_dir):
    """Sentences of every document, abbreviations learned from all of them."""
    docs, abbr, begins = _learn(spark, sf_dir)
    found = borders.split_sentences(docs, abbr, begins)
    return found.select("doc_id", F.posexplode("sentences").alias("sent_no", "sentence"))
