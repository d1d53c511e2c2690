"""Vector queries (V4-V9, F8, P10-P12) over the ``embeddings`` table.

Vocabulary: ``embeddings`` keyed by ``vec_id`` (or, for the string-term
queries, by a term built from the matching ``part`` name). Every query uses
every embedding row as a query; label anchors (smallest ``vec_id`` per
``label``) supply the extra terms of signed and analogy queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.terms import display_term, normalise_query_term, query_label
from ..operators import similarity as sim
from ..session import load
from .registry import register


def _vocab(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("word"), F.col("embedding").alias("vector"), "label")


def _anchors(vocab):
    """Smallest vec_id per label (a tiny table: one row per label)."""
    return vocab.groupBy("label").agg(F.min("word").alias("anchor"))


def display_word(word: str) -> str:
    return word.replace("_", " ")


def _round(df, col="similarity"):
    return df.withColumn(col, F.round(F.col(col), 4))


@register("vec_most_similar", """
WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
         list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM s)
SELECT query_id, rank, neighbour_id, round(sim, 4) AS similarity FROM r WHERE rank <= 5
""")
def vec_most_similar(spark, sf_dir):
    """V4+V5: top-5 cosine neighbours of every embedding, itself excluded."""
    vocab = _vocab(spark, sf_dir)
    queries = vocab.select(F.col("word").alias("query_id"), F.col("vector").alias("qvec"),
                           F.array("word").alias("exclude"), F.lit(5).alias("topn"))
    out = sim.most_similar(vocab, queries)
    return _round(out.withColumnRenamed("word", "neighbour_id"))


_SIGNED_SQL = """
WITH a AS (SELECT label, min(vec_id) AS anchor FROM embeddings GROUP BY label),
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
q AS (
  SELECT e.vec_id AS query_id, c.vec_id AS cid, f.vec_id AS fid,
         list_transform(range(1, len(e.v) + 1), lambda i: ({P1} e.v[i] / e.n + {P2} c.v[i] / c.n - {N1} f.v[i] / f.n) / 3.0) AS qv
  FROM e JOIN a ca ON ca.label = e.label JOIN e c ON c.vec_id = ca.anchor
         JOIN a fa ON fa.label = (e.label + {OFF}) % 10 JOIN e f ON f.vec_id = fa.anchor),
s AS (
  SELECT q.query_id, v.vec_id AS neighbour_id, list_cosine_similarity(q.qv, v.v) AS sim
  FROM q JOIN e v ON v.vec_id NOT IN (q.query_id, q.cid, q.fid)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM s)
SELECT query_id, rank, neighbour_id, round(sim, 4) AS similarity FROM r WHERE rank <= {TOPN}
"""


def _signed_query_terms(vocab, offset):
    """Per query row: +itself, +anchor of its label, -anchor of label+offset."""
    a = _anchors(vocab)
    q = (vocab.select(F.col("word").alias("query_id"), "label")
         .join(a.withColumnRenamed("anchor", "closer"), "label")
         .join(a.select(((F.col("label") - offset + 10) % 10).alias("label"),
                        F.col("anchor").alias("farther")), "label"))
    return q


@register("vec_signed", _SIGNED_SQL.format(P1="", P2="", N1="", OFF=1, TOPN=5))
def vec_signed(spark, sf_dir):
    """V6: top-5 for (itself + closer - farther), all three inputs excluded."""
    vocab = _vocab(spark, sf_dir)
    q = _signed_query_terms(vocab, 1)
    terms = q.select("query_id", F.explode(F.array(
        F.struct(F.col("query_id").alias("term"), F.lit(True).alias("positive")),
        F.struct(F.col("closer").alias("term"), F.lit(True).alias("positive")),
        F.struct(F.col("farther").alias("term"), F.lit(False).alias("positive")))).alias("t")
    ).select("query_id", "t.term", "t.positive")
    resolved, _ = sim.signed_terms_to_vectors(vocab, terms)
    out = sim.most_similar(vocab, resolved.withColumn("topn", F.lit(5)))
    return _round(out.withColumnRenamed("word", "neighbour_id"))


@register("vec_analogy", _SIGNED_SQL.format(P1="", P2="", N1="", OFF=5, TOPN=3))
def vec_analogy(spark, sf_dir):
    """V7: ``same : opp :: term : ?`` = opp + term - same, top-3.

    For every row: term = itself, opp = anchor of its label, same = anchor of
    label + 5.
    """
    vocab = _vocab(spark, sf_dir)
    q = _signed_query_terms(vocab, 5).select(
        "query_id", F.col("query_id").alias("term"), F.col("closer").alias("opp"),
        F.col("farther").alias("same"))
    resolved, _ = sim.signed_terms_to_vectors(vocab, sim.analogy_terms(q))
    out = sim.most_similar(vocab, resolved.withColumn("topn", F.lit(3)))
    return _round(out.withColumnRenamed("word", "neighbour_id"))


@register("vec_comparison_filter", """
WITH a AS (SELECT label, min(vec_id) AS anchor FROM embeddings GROUP BY label),
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, q.label, v.vec_id AS neighbour_id, v.v AS nv, list_cosine_similarity(q.v, v.v) AS sim
  FROM e q JOIN e v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM s),
t AS (SELECT * FROM r WHERE rank <= 10)
SELECT t.query_id, t.rank, t.neighbour_id, round(t.sim, 4) AS similarity
FROM t JOIN a ca ON ca.label = t.label JOIN e c ON c.vec_id = ca.anchor
       JOIN a fa ON fa.label = (t.label + 1) % 10 JOIN e f ON f.vec_id = fa.anchor
WHERE list_cosine_similarity(t.nv, c.v) > list_cosine_similarity(t.nv, f.v)
""")
def vec_comparison_filter(spark, sf_dir):
    """V5 then F8: top-10 neighbours kept only when closer to the anchor of the
    query's label than to the anchor of the next label."""
    vocab = _vocab(spark, sf_dir)
    queries = vocab.select(F.col("word").alias("query_id"), F.col("vector").alias("qvec"),
                           F.array("word").alias("exclude"), F.lit(10).alias("topn"))
    top = sim.most_similar(vocab, queries)
    anchors = _signed_query_terms(vocab, 1).select("query_id", "closer", "farther")
    kept = sim.comparison_filter(top, vocab, anchors)
    return _round(kept.withColumnRenamed("word", "neighbour_id"))


def _term_vocab(spark, sf_dir):
    """String-keyed vocabulary: ``<part name>_<partkey>`` in stored form."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return (emb.join(part, emb.vec_id == part.p_partkey)
            .select(normalise_query_term(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
                    .alias("word"), F.col("embedding").alias("vector"), "label", "vec_id"))


def _query_table(spark, sf_dir):
    """One query per part: its own term, + anchor of label p_size % 10,
    - anchor of label (p_size + 3) % 10, top 3. Parts without a vector are
    out-of-vocabulary queries."""
    vocab = _term_vocab(spark, sf_dir)
    first = vocab.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    anchor = (first.join(vocab.select("vec_id", "word"), "vec_id")
              .select("label", display_term(F.col("word")).alias("anchor_term")))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return (part
            .join(anchor.select(F.col("label").alias("pl"), F.col("anchor_term").alias("pos")),
                  (F.col("p_size") % 10) == F.col("pl"))
            .join(anchor.select(F.col("label").alias("nl"), F.col("anchor_term").alias("neg")),
                  ((F.col("p_size") + 3) % 10) == F.col("nl"))
            .select(F.col("p_partkey").alias("query_id"),
                    F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"),
                    F.lit(3).alias("topn"),
                    F.array(F.struct(F.col("pos").alias("term"), F.lit(True).alias("positive")),
                            F.struct(F.col("neg").alias("term"), F.lit(False).alias("positive")))
                    .alias("vectors")))


_QT_SQL = """
WITH vocab AS (
  SELECT replace(lower(p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR)), ' ', '_') AS word,
         e.embedding::DOUBLE[] AS v, e.label, e.vec_id
  FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey),
anchor AS (
  SELECT v.label, replace(replace(v.word, '_-_', '-'), '_', ' ') AS anchor_term
  FROM vocab v JOIN (SELECT label, min(vec_id) AS vec_id FROM vocab GROUP BY label) m ON m.vec_id = v.vec_id),
qt AS (
  SELECT p.p_partkey AS query_id, p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR) AS term,
         pa.anchor_term AS pos, na.anchor_term AS neg
  FROM part p JOIN anchor pa ON pa.label = p.p_size % 10 JOIN anchor na ON na.label = (p.p_size + 3) % 10),
terms AS (
  SELECT query_id, replace(lower(term), ' ', '_') AS t, 1.0 AS sgn FROM qt
  UNION ALL SELECT query_id, replace(lower(pos), ' ', '_'), 1.0 FROM qt
  UNION ALL SELECT query_id, replace(lower(neg), ' ', '_'), -1.0 FROM qt),
resolved AS (
  SELECT t.query_id, t.t, t.sgn, v.v, sqrt(list_sum(list_transform(v.v, lambda x: x * x))) AS n
  FROM terms t LEFT JOIN vocab v ON v.word = t.t)
{TAIL}
"""

_QT_ANSWERS = _QT_SQL.replace("{TAIL}", """,
ok AS (SELECT query_id FROM resolved GROUP BY query_id HAVING count(v) = count(*)),
agg AS (
  SELECT r.query_id, list(r.sgn) AS sg, list(r.v) AS vs, list(r.n) AS ns, list(r.t) AS ex
  FROM resolved r JOIN ok USING (query_id) GROUP BY r.query_id),
qvec AS (
  SELECT query_id, ex, list_transform(range(1, len(vs[1]) + 1),
           lambda i: list_sum(list_transform(range(1, len(vs) + 1), lambda j: sg[j] * vs[j][i] / ns[j])) / len(vs)) AS qv
  FROM agg),
s AS (
  SELECT q.query_id, v.word, list_cosine_similarity(q.qv, v.v) AS sim
  FROM qvec q JOIN vocab v ON NOT list_contains(q.ex, v.word)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, word) AS rank FROM s)
SELECT r.query_id, qt.term || ' + ' || qt.pos || ' - ' || qt.neg AS query, r.rank,
       replace(replace(r.word, '_-_', '-'), '_', ' ') AS term, round(r.sim, 4) AS similarity
FROM r JOIN qt USING (query_id) WHERE r.rank <= 3
""")

_QT_UNKNOWN = _QT_SQL.replace("{TAIL}", """
SELECT query_id, t AS term FROM resolved WHERE v IS NULL
""")


@register("vec_query_table", _QT_ANSWERS)
def vec_query_table(spark, sf_dir):
    """V8 + P10-P12: a table of signed multi-term queries, answered as ranked
    rows with the display form of each term and the query label."""
    answers, _ = sim.answer_query_table(_term_vocab(spark, sf_dir), _query_table(spark, sf_dir))
    return _round(answers)


@register("vec_unknown_terms", _QT_UNKNOWN)
def vec_unknown_terms(spark, sf_dir):
    """V9: the out-of-vocabulary terms of the query table (those queries
    return no rows)."""
    return sim.unknown_terms(_term_vocab(spark, sf_dir), sim.query_table_terms(_query_table(spark, sf_dir)))


@register("term_display", """
SELECT p_partkey, replace(lower(p_name), ' ', '_') AS stored,
       replace(replace(replace(lower(p_name), ' ', '_'), '_-_', '-'), '_', ' ') AS display,
       p_name || ' + ' || p_type || ' - ' || p_brand AS label
FROM part
""")
def term_display(spark, sf_dir):
    """P10-P12 over ``part``: stored term form, its display form, and the label
    of the query (name + type - brand)."""
    part = load(spark, sf_dir, "part")
    stored = normalise_query_term(F.col("p_name"))
    vectors = F.array(F.struct(F.col("p_type").alias("term"), F.lit(True).alias("positive")),
                      F.struct(F.col("p_brand").alias("term"), F.lit(False).alias("positive")))
    return part.select("p_partkey", stored.alias("stored"), display_term(stored).alias("display"),
                       query_label(F.col("p_name"), vectors).alias("label"))


# Anchors 1-4 are asked about; 5 and 6 are the nearer and the farther term, 7
# and 8 the analogies' same and opposite; the user term is anchor 1.
_EXPLORATION_SQL = """
WITH vocab AS (
  SELECT replace(lower(p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR)), ' ', '_') AS word, e.label, e.vec_id,
         e.embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))) AS n
  FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey),
a AS (SELECT word, v, n, row_number() OVER (ORDER BY label) AS i
      FROM vocab WHERE vec_id IN (SELECT min(vec_id) FROM vocab GROUP BY label)),
t AS (
  SELECT i AS query_id, 'similar' AS variant, 10 AS topn, i, 1.0 AS sgn FROM range(1, 5) r(i)
  UNION ALL SELECT 4 + i, 'vector_math', 10, unnest([i, 5, 6]), unnest([1.0, 1.0, -1.0]) FROM range(1, 5) r(i)
  UNION ALL SELECT 8 + i, 'analogy', 1, unnest([8, i, 7]), unnest([1.0, 1.0, -1.0]) FROM range(1, 5) r(i)
  UNION ALL SELECT 13, 'user', 5, 1, 1.0),
q AS (
  SELECT t.query_id, any_value(t.variant) AS variant, any_value(t.topn) AS topn, list(t.sgn ORDER BY t.i) AS sg,
         list(a.v ORDER BY t.i) AS vs, list(a.n ORDER BY t.i) AS ns, list(a.word) AS used
  FROM t JOIN a USING (i) GROUP BY t.query_id),
qv AS (
  SELECT query_id, variant, topn, used, list_transform(range(1, len(vs[1]) + 1),
           lambda k: list_sum(list_transform(range(1, len(vs) + 1), lambda j: sg[j] * vs[j][k] / ns[j])) / len(vs)) AS x
  FROM q),
s AS (
  SELECT qv.query_id, qv.variant, qv.topn, w.word, w.v, list_cosine_similarity(qv.x, w.v) AS sim
  FROM qv JOIN vocab w ON NOT list_contains(qv.used, w.word)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, word) AS rank FROM s),
top AS (SELECT * FROM r WHERE rank <= topn)
SELECT query_id, variant, rank, word, round(sim, 4) AS similarity FROM top
UNION ALL
SELECT query_id, 'comparison_filter', rank, word, round(sim, 4) FROM top
WHERE variant = 'similar' AND list_cosine_similarity(v, (SELECT v FROM a WHERE i = 5))
                            > list_cosine_similarity(v, (SELECT v FROM a WHERE i = 6))
"""


@register("exploration", _EXPLORATION_SQL)
def exploration(spark, sf_dir):
    """The exploration batch over the term vocabulary: most-similar,
    comparison filter, signed vectors, analogies and a user term, all built
    from the label anchors."""
    vocab = _term_vocab(spark, sf_dir)
    first = vocab.groupBy("label").agg(F.min_by("word", "vec_id").alias("word")).orderBy("label").limit(8)
    a = [display_word(r["word"]) for r in first.collect()]  # eight anchors
    from ..operators.embeddings import exploration_batch

    answers, _ = exploration_batch(vocab.select("word", "vector"), a[:4], a[4].replace(" ", "_"), a[5].replace(" ", "_"),
                                   [(x.replace(" ", "_"), a[6].replace(" ", "_"), a[7].replace(" ", "_")) for x in a[:4]],
                                   user_term=a[0])
    return _round(answers)
