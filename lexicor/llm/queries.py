"""Registered queries of the training-data operators over the driver tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import cut_lineage, load, scratch_path
from . import decontam, dialogue, langid, lexical, licenses, mixing, quality, spm, tokencount, topk, toxicity, warc
from .jaccard import jaccard_components

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _fold(id_col, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def _training(table, parts: int, held: int):
    return table.where(F.col("doc_id").isNotNull() & (_fold(F.col("doc_id"), parts) != held))


@register("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Toxicity score of every document; learned from the labels of four of
    the five folds of the id's crc32."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _training(load(spark, sf_dir, "labels"), 5, 0))
    return toxicity.score(docs, model).select(
        "doc_id", (_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_model(spark, docs, sf_dir):
    """Positive-unlabelled model: good labels and web text outside the held fold."""
    good = _training(load(spark, sf_dir, "labels"), 5, 0).where("quality = 1")
    return quality.fit(_training(docs.select("doc_id", "text"), 5, 0), good)


#: Scores from here on count as good.
QUALITY_AT = 0.3


@register("op5_quality_pu")
def op5_quality_pu(spark, sf_dir):
    """Quality score of every document by positive-unlabelled learning."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, docs, sf_dir)).select(
        "doc_id", (_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


#: Vocabulary of the token counts, among the installed public tokenizers.
COUNT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Model of the SentencePiece stages, among the installed public tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"


@register("op2_sentencepiece_wfst")
def op2_sentencepiece_wfst(spark, sf_dir):
    """Piece ids of every document, and whether they decode to its text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode(docs, tokenizer_path(PIECE_MODEL), decoded_col="round_trip", remember=500_000).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


@register("op3_license_sentences", f"""
WITH known(id, s) AS (VALUES {', '.join(f"('{i}', '{s}')" for i, s in licenses.SENTENCES.items())}),
rules(name, ids) AS (VALUES {', '.join(f"('{n}', ',{','.join(i)},')" for n, i in licenses.RULES)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT r, 1 AS kind, string_split_regex(t, '[.!?;:]+[ \\t\\r\\n]+|[\\r\\n]+') AS parts FROM d
      UNION ALL
      SELECT r, 2, string_split_regex(regexp_replace(t, '[\\r\\n]+', ' ', 'g'), '[.!?;:]+[ \\t]+') FROM d),
e AS (SELECT r, kind, generate_subscripts(parts, 1) AS pos, unnest(parts) AS s FROM p),
m AS (SELECT r, kind, string_agg(known.id, ',' ORDER BY pos) AS ids, count(*) AS n
      FROM e JOIN known ON trim(regexp_replace(lower(e.s), '[^a-z0-9]+', ' ', 'g')) = known.s GROUP BY 1, 2),
b AS (SELECT r, arg_max(ids, n * 10 - kind) AS ids FROM m GROUP BY 1),
h AS (SELECT b.r, string_agg(DISTINCT rules.name, ',' ORDER BY rules.name) AS names
      FROM b JOIN rules ON contains(',' || b.ids || ',', rules.ids) GROUP BY 1)
SELECT d.doc_id, coalesce(b.ids, '') AS sentence_ids, coalesce(h.names, '') AS licenses
FROM d LEFT JOIN b USING (r) LEFT JOIN h USING (r)""")
def op3_license_sentences(spark, sf_dir):
    """Known licence sentences and the licences their sequences stand for."""
    found = licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))


@register("op6_ngram_jaccard", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
                                                              for i in range(1, len(w) - 1)])
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS n, any_value(b.n) AS m
      FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * i >= 90 * (n + m - i)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, least(g.doc_id, coalesce(min(r.y), g.doc_id)) AS component_id
FROM g LEFT JOIN r ON r.x = g.doc_id GROUP BY g.doc_id, g.s""")
def op6_ngram_jaccard(spark, sf_dir):
    """Components of the 3-word-shingle Jaccard join at 0.9."""
    return jaccard_components(load(spark, sf_dir, "documents"))


def _write_arc(pages, path: str) -> None:
    """Stand-in input: the pages as ARC archives, files of version 1 and 2 in
    turn. A record's block is an HTTP response that names the page."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
                       F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")))
    block = F.concat(head, F.lit("\r\n\r\n"), html)
    url = F.regexp_replace(F.coalesce("url", F.lit("unknown:")), r"\s", "%20")
    size = F.octet_length("block").cast("string")
    rows = pages.select(url.alias("url"), block.alias("block")).select(
        F.concat_ws(" ", "url", F.lit("192.0.2.1 20240131120000 text/html"), size).alias("one"),
        F.concat_ws(" ", "url", F.lit("192.0.2.1 20240131120000 text/html 200 - - 0 pages.arc"), size).alias("two"), "block")

    def run(batches):
        from pyspark import TaskContext
        import pyarrow.compute as pc

        new = TaskContext.get().partitionId() % 2
        fields = ("2 0 Example\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset "
                  "Filename Archive-length\n" if new else
                  "1 0 Example\nURL IP-address Archive-date Content-type Archive-length\n")
        length = f"200 - - 0 pages.arc {len(fields)}" if new else str(len(fields))
        yield pa.RecordBatch.from_arrays([pa.array([f"filedesc://pages.arc 0.0.0.0 20240131120000 text/plain {length}\n{fields}"])],
                                         ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(batch.column(new), batch.column(2), "\n")], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


_PAGE_ID = "(?i)x-page-id: *(-?[0-9]+)"


@register("op4_arc_to_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
m AS (SELECT t, min(page_id) AS first FROM p GROUP BY 1)
SELECT p.page_id, strlen(p.t)::BIGINT AS payload_bytes, sha256(p.t) AS payload_digest,
       CASE WHEN strlen(p.t) >= 100 AND p.page_id > m.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.t) >= 100 AND p.page_id > m.first THEN m.first END AS refers_to
FROM p JOIN m USING (t)""")
def op4_arc_to_warc(spark, sf_dir):
    """Pages as ARC archives, converted to WARC and read back."""
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    _write_arc(load(spark, sf_dir, "pages"), arc)
    page = F.regexp_extract("http", _PAGE_ID, 1)
    warc.convert(warc.read_arc(spark, arc), out, order=F.when(page != "", page.cast("long")))
    got = warc.resolve(cut_lineage(warc.read_warc(spark, out, with_payload=False), "records"))
    of = F.regexp_extract("target.http", _PAGE_ID, 1)
    return got.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.coalesce("target.payload_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("target.payload_digest", "payload_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.when(of != "", of.cast("long")).alias("refers_to"))


@register("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    """Bytes and tokens of every document; over 2,048 tokens or not."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer_path(COUNT_TOKENIZER)).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@register("op8_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_LOWER.format('text')}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_WORDS}') AS w FROM benchmark
      WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
              unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') for i in range(1, len(w) - least(10, len(w)) + 2)]) AS s
       FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i,
              unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS s
       FROM d, ns WHERE len(w) >= n),
h AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""")
def op8_decontamination(spark, sf_dir):
    """Words of every document inside a 10-word window of a benchmark item."""
    found = decontam.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def language_model(docs):
    """Dictionaries from the documents outside the held fold."""
    return langid.fit(_training(docs.select("doc_id", "text", "lang"), 3, 1))


@register("op9_language_zstd")
def op9_language_zstd(spark, sf_dir):
    """Language of every document by per-language zstandard dictionaries."""
    docs = load(spark, sf_dir, "documents")
    return langid.classify(docs.select("doc_id", "text"), language_model(docs)).select(
        "doc_id", (_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "lang_accepted")


@register("op10_block_topk", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op10_block_topk(spark, sf_dir):
    """Five best rows of every 50th vector by integer inner product."""
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


@register("op11_conversation_repair", f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS tbl),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
                                  lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM o, crc),
a AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS again FROM h WHERE how <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM a),
x AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
             count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM x GROUP BY 1),
ins(q, p, cost, letters, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
  (3, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:'])),
mv(q, c, p, letter, cost, own) AS (VALUES
  (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL),
  (0, NULL, 2, 'R', 3, 'user'), (1, NULL, 2, 'R', 3, 'user'), (3, NULL, 2, 'R', 3, 'user'), (2, NULL, 3, 'R', 3, 'assistant'),
  (0, NULL, 0, 'D', 4, NULL), (1, NULL, 1, 'D', 4, NULL), (2, NULL, 2, 'D', 4, NULL), (3, NULL, 3, 'D', 4, NULL)),
dp(conv_id, i, q, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM s
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.lines FROM (
    SELECT dp.conv_id, x.i, mv.p AS q, arg_min(
             {{'cost': dp.cost + ins.cost + mv.cost + CASE WHEN letter <> 'D' AND fault = 3 THEN 3 ELSE 0 END,
              'audit': dp.audit || ins.letters || letter,
              'lines': list_concat(dp.lines, ins.lines, CASE WHEN letter = 'D' THEN [] ELSE [coalesce(own, role) || ':' || text] END)}},
             lpad((dp.cost + ins.cost + mv.cost + CASE WHEN letter <> 'D' AND fault = 3 THEN 3 ELSE 0 END)::VARCHAR, 9, '0')
             || dp.audit || ins.letters || letter) AS b
    FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.i = dp.i + 1 JOIN ins ON ins.q = dp.q
         JOIN mv ON mv.q = ins.p AND (letter = 'D' OR fault IN (0, 3)) AND (mv.c IS NULL OR mv.c = x.c)
    GROUP BY 1, 2, 3)),
e AS (SELECT dp.conv_id, arg_min({{'cost': dp.cost + ins.cost, 'audit': dp.audit || ins.letters, 'lines': list_concat(dp.lines, ins.lines)}},
                                 lpad((dp.cost + ins.cost)::VARCHAR, 9, '0') || dp.audit || ins.letters) AS b
      FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.i JOIN ins ON ins.q = dp.q AND ins.p IN (0, 3) GROUP BY 1)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(e.b.cost, 0)::BIGINT AS cost,
       coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op11_conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and its audit of every conversation, after damage by crc32."""
    rows = load(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damage(rows), conversations=rows)


_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@register("op12_bag_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERMS}') AS w FROM documents),
st AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERMS}')) AS t FROM benchmark) GROUP BY 1, 2),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, st GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 75 + (25 * len(d.w)::BIGINT * n_docs) // n_terms AS m FROM d, st),
s AS (SELECT item_id, r, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY 1, 2),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20""")
def op12_bag_search(spark, sf_dir):
    """The 20 documents that fit each benchmark item best by its terms."""
    return lexical.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@register("op13_source_mix", """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                            md5('13:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
t AS (SELECT 1.5::DOUBLE * sum(source_size)::BIGINT AS total FROM s),
r(lam) AS (SELECT total / sum(w) FROM s, t GROUP BY total
           UNION
           SELECT (total - sum(CASE WHEN source_size * 2.0::DOUBLE <= lam * w THEN source_size * 2.0::DOUBLE ELSE 0 END))
                  / sum(CASE WHEN source_size * 2.0::DOUBLE > lam * w THEN w ELSE 0 END)
           FROM r, s, t GROUP BY lam, total),
f AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, lam * w) AS target FROM s, (SELECT max(lam) AS lam FROM r)),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::BIGINT AS copies FROM f),
g AS (SELECT *, floor(target - copies * source_size + 0.5)::BIGINT AS rest FROM c),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT o.doc_id, o.size, g.source_size, g.target,
       (g.copies * o.size + greatest(0, least(o.size, g.rest - o.before)))::BIGINT AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source""")
def op13_source_mix(spark, sf_dir):
    """Words that a 150 % mix takes of every document, sources weighing 3, 1, 2 in turn."""
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
