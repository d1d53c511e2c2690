"""Text-normalisation queries (T1-T19, P4) over ``documents`` and ``pages``.

Token-level operators whose inputs would be vacuous on the prose of
``documents`` (units, oxidation states, element names, formulas) also run on
tokens built from ``lineitem`` keys; the builders only shape strings, the
operators do the work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import materials as mat
from ..functions import text as tx
from ..functions.fixed_values import ELEMENT_NAMES, ELEMENTS, ELEMENTS_AND_NAMES
from ..operators import corpus
from ..functions.markup import strip_markup
from ..session import cut_lineage, load
from . import sql_text as S
from .registry import register

SENTENCES_CTE = f"WITH s AS ({S.unnest_sentences('documents', 'doc_id', 'text')})"
TOKENS_CTE = SENTENCES_CTE + f", k AS (SELECT doc_id, sent_no, {S.tokens('sentence')} AS toks FROM s)"


def _sentences(spark, sf_dir):
    return corpus.sentence_rows(load(spark, sf_dir, "documents").select("doc_id", "text"))


def _sentence_tokens(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "sent_no", tx.tokens(F.col("sentence")).alias("toks"))


@register("doc_sentences", SENTENCES_CTE + " SELECT doc_id, sent_no, sentence FROM s")
def doc_sentences(spark, sf_dir):
    """Every document split into ordered, trimmed, non-empty sentences."""
    return _sentences(spark, sf_dir)


@register("doc_tokens", TOKENS_CTE + """
SELECT doc_id, sent_no, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM k""")
def doc_tokens(spark, sf_dir):
    """T2 (with T3/T4 splits) and T18: tokens of every sentence, joined by a space."""
    return _sentence_tokens(spark, sf_dir).select(
        "doc_id", "sent_no", F.size("toks").cast("long").alias("n_tokens"),
        F.array_join("toks", " ").alias("tokens"))


@register("number_mask", TOKENS_CTE + f"""
SELECT doc_id, sent_no, array_to_string({S.mask_numbers('toks')}, ' ') AS masked FROM k""")
def number_mask(spark, sf_dir):
    """Numbers become <nUm> unless they sit between brackets."""
    toks = F.col("toks")
    masked = F.transform(toks, lambda t, i: F.when(tx.is_number(t) & ~tx._bracketed(toks, i),
                                                   F.lit("<nUm>")).otherwise(t))
    return _sentence_tokens(spark, sf_dir).select("doc_id", "sent_no", F.array_join(masked, " ").alias("masked"))


_t = S.v("t")


@register("selective_lower", TOKENS_CTE + f"""
SELECT doc_id, sent_no, array_to_string(list_transform(toks, lambda {_t}: CASE WHEN {S.lower_candidate(_t)}
       THEN lower({_t}) ELSE {_t} END), ' ') AS lowered FROM k""")
def selective_lower(spark, sf_dir):
    """Single characters and Capitalised words lower-cased unless they are
    element symbols, units or elements with a crystal direction."""
    low = F.transform("toks", lambda t: F.when(tx.lower_candidate(t), F.lower(t)).otherwise(t))
    return _sentence_tokens(spark, sf_dir).select("doc_id", "sent_no", F.array_join(low, " ").alias("lowered"))


@register("punct_stop_filter", TOKENS_CTE + f"""
SELECT doc_id, sent_no, array_to_string({S.stop_filter(S.punct_filter('toks'), tx.default_stop_words())}, ' ')
       AS kept FROM k""")
def punct_stop_filter(spark, sf_dir):
    """T5 + T16: punctuation and stop words removed, order and repeats kept."""
    kept = tx.remove_stop_words(tx.remove_punct(F.col("toks")))
    return _sentence_tokens(spark, sf_dir).select("doc_id", "sent_no", F.array_join(kept, " ").alias("kept"))


_a = S.v("t")


@register("accent_fold", TOKENS_CTE + f"""
SELECT doc_id, sent_no, array_to_string(list_transform(toks, lambda {_a}: {S.remove_accents(_a)}), ' ')
       AS folded FROM k""")
def accent_fold(spark, sf_dir):
    """Tokens longer than one character transliterated to ASCII."""
    folded = F.transform("toks", tx.remove_accents)
    return _sentence_tokens(spark, sf_dir).select("doc_id", "sent_no", F.array_join(folded, " ").alias("folded"))


@register("process_sentences", TOKENS_CTE + f"""
SELECT doc_id, sent_no, array_to_string({S.process('toks')}, ' ') AS processed FROM k""")
def process_sentences(spark, sf_dir):
    """The full token pipeline (number mask, element names, formulas,
    selective lower-case, accents) on every sentence."""
    steps = tx.process_tokens(F.col("toks"))
    return _sentence_tokens(spark, sf_dir).select(
        "doc_id", "sent_no", F.array_join(tx.processed(steps), " ").alias("processed"))


@register("process_no_punct", TOKENS_CTE + f"""
SELECT doc_id, sent_no, array_to_string({S.process('toks', exclude_punct=True)}, ' ') AS processed FROM k""")
def process_no_punct(spark, sf_dir):
    """T14 with punctuation exclusion (T5) switched on; brackets still count
    as neighbours of a number."""
    steps = tx.process_tokens(F.col("toks"), exclude_punct=True)
    return _sentence_tokens(spark, sf_dir).select(
        "doc_id", "sent_no", F.array_join(tx.processed(steps), " ").alias("processed"))


# ------------------------------------------------- tokens built from lineitem
_TAILS = ["V", "mA", "GHz", "K", "Q", "kDa", "wt.", "xyz", "eV", "Å", "h", "mol"]
_NUMERALS = ["I", "II", "III", "IV", "V", "VI", "iv", "ii", "X", "", "111", "|"]
_AMOUNTS = ["", "0.5", "1.5", "2", "0.25", "3", "1", "4"]


def _pick(values, key):
    """Spark: element of a fixed list chosen by a key (1-based)."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values, key):
    return f"{S.sql_list(values)}[(({key}) % {len(values)}) + 1]"


def _lineitem(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  "l_quantity")


_UNIT_TOKEN_SQL = f"CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || {_pick_sql(_TAILS, 'l_partkey')}"
_S1 = S.v("t")


@register("unit_split", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, {_UNIT_TOKEN_SQL} AS token FROM lineitem)
SELECT l_orderkey, l_linenumber, token, array_to_string({S.split_token('token')}, '|') AS parts FROM k""")
def unit_split(spark, sf_dir):
    """Number-unit tokens split when the tail is a listed unit."""
    li = _lineitem(spark, sf_dir)
    token = F.concat(F.col("l_quantity").cast("long").cast("string"), _pick(_TAILS, F.col("l_partkey")))
    return li.select("l_orderkey", "l_linenumber", token.alias("token")).select(
        "l_orderkey", "l_linenumber", "token", F.array_join(mat.split_token(F.col("token")), "|").alias("parts"))


_OX_TOKEN_SQL = (f"{_pick_sql(ELEMENTS_AND_NAMES, 'l_partkey')} || '(' || "
                 f"{_pick_sql(_NUMERALS, 'l_linenumber + l_suppkey')} || ')'")


@register("oxidation_split", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, {_OX_TOKEN_SQL} AS token FROM lineitem)
SELECT l_orderkey, l_linenumber, token, array_to_string({S.split_token('token')}, '|') AS parts FROM k""")
def oxidation_split(spark, sf_dir):
    """T4: element (symbol or name) with an oxidation state in parentheses
    split in two; other parentheses left alone."""
    li = _lineitem(spark, sf_dir)
    token = F.concat(_pick(ELEMENTS_AND_NAMES, F.col("l_partkey")), F.lit("("),
                     _pick(_NUMERALS, F.col("l_linenumber") + F.col("l_suppkey")), F.lit(")"))
    return li.select("l_orderkey", "l_linenumber", token.alias("token")).select(
        "l_orderkey", "l_linenumber", "token", F.array_join(mat.split_token(F.col("token")), "|").alias("parts"))


_F_TOKEN_SQL = (f"{_pick_sql(ELEMENTS, 'l_partkey')} || {_pick_sql(_AMOUNTS, 'l_linenumber')} || "
                f"{_pick_sql(ELEMENTS, 'l_suppkey')} || {_pick_sql(_AMOUNTS, 'CAST(l_quantity AS BIGINT)')}")


@register("formula_normalise", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, {_F_TOKEN_SQL} AS token FROM lineitem)
SELECT l_orderkey, l_linenumber, token, {S.is_formula('token')} AS is_formula,
       CASE WHEN {S.is_formula('token')} THEN {S.normalized_formula('token')} END AS normalized FROM k""")
def formula_normalise(spark, sf_dir):
    """Simple-formula test and normalisation (gcd, sorted symbols)."""
    li = _lineitem(spark, sf_dir)
    token = F.concat(_pick(ELEMENTS, F.col("l_partkey")), _pick(_AMOUNTS, F.col("l_linenumber")),
                     _pick(ELEMENTS, F.col("l_suppkey")), _pick(_AMOUNTS, F.col("l_quantity").cast("long")))
    info = mat.formula_info(F.col("token"))
    return li.select("l_orderkey", "l_linenumber", token.alias("token")).withColumn("_f", info).select(
        "l_orderkey", "l_linenumber", "token", F.col("_f.simple").alias("is_formula"),
        F.col("_f.normalized").alias("normalized"))


_E_TOKEN_SQL = (f"CASE l_linenumber % 3 WHEN 0 THEN {_pick_sql(ELEMENT_NAMES, 'l_partkey')} "
                f"WHEN 1 THEN upper(substr({_pick_sql(ELEMENT_NAMES, 'l_partkey')}, 1, 1)) || "
                f"substr({_pick_sql(ELEMENT_NAMES, 'l_partkey')}, 2) "
                f"ELSE upper({_pick_sql(ELEMENT_NAMES, 'l_partkey')}) END")


@register("element_mentions", f"""
WITH k AS (SELECT [{_E_TOKEN_SQL}, {_F_TOKEN_SQL}] AS toks FROM lineitem),
m AS (SELECT unnest({S.mention_list('toks')}) AS mm FROM k)
SELECT mm.original AS original, mm.normalized AS normalized, count(*) AS n FROM m GROUP BY ALL""")
def element_mentions(spark, sf_dir):
    """T8 + T13: material mentions (element names and formulas) with counts;
    names count only lower-case or Capitalised."""
    li = _lineitem(spark, sf_dir)
    name = _pick(ELEMENT_NAMES, F.col("l_partkey"))
    cased = (F.when(F.col("l_linenumber") % 3 == 0, name)
             .when(F.col("l_linenumber") % 3 == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))
             .otherwise(F.upper(name)))
    formula = F.concat(_pick(ELEMENTS, F.col("l_partkey")), _pick(_AMOUNTS, F.col("l_linenumber")),
                       _pick(ELEMENTS, F.col("l_suppkey")), _pick(_AMOUNTS, F.col("l_quantity").cast("long")))
    steps = tx.process_tokens(F.array(cased, formula))
    return (li.select(F.explode(tx.mentions(steps)).alias("m"))
            .groupBy(F.col("m.original").alias("original"), F.col("m.normalized").alias("normalized"))
            .agg(F.count("*").alias("n")))


# Abstracts made from keys: a formula (every fiftieth with an amount that no
# double holds) and an element name in a sentence.
_A_TOKEN_SQL = f"CASE WHEN l_partkey % 50 = 0 THEN 'Fe' || repeat('9', 400) || 'O2' ELSE {_F_TOKEN_SQL} END"
_A_SENTENCES = (f"WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, 'Sample of ' || {_A_TOKEN_SQL} || ' and ' || "
                f"{_pick_sql(ELEMENT_NAMES, 'l_partkey')} || ' (5 K). It was Iron.' AS text FROM lineitem), "
                f"s AS ({S.unnest_sentences('a', 'doc_id', 'text')}), "
                f"k AS (SELECT doc_id, sent_no, {S.tokens('sentence')} AS toks FROM s)")


def _abstracts(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    formula = F.concat(_pick(ELEMENTS, F.col("l_partkey")), _pick(_AMOUNTS, F.col("l_linenumber")),
                       _pick(ELEMENTS, F.col("l_suppkey")), _pick(_AMOUNTS, F.col("l_quantity").cast("long")))
    token = F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("Fe"), F.repeat(F.lit("9"), 400), F.lit("O2"))).otherwise(formula)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.concat(
        F.lit("Sample of "), token, F.lit(" and "), _pick(ELEMENT_NAMES, F.col("l_partkey")), F.lit(" (5 K). It was Iron."))
        .alias("text"))


@register("material_mentions", _A_SENTENCES + f"""
, m AS (SELECT unnest({S.mention_list('toks')}) AS mm FROM k)
SELECT mm.original AS original, mm.normalized AS normalized, count(*) AS n FROM m GROUP BY ALL""")
def material_mentions(spark, sf_dir):
    """T13 from text to counts: sentences, tokens, mentions by material."""
    out = corpus.normalise(_abstracts(spark, sf_dir), "api").select(F.explode("materials").alias("m"))
    return (out.groupBy(F.col("m.original").alias("original"), F.col("m.normalized").alias("normalized"))
            .agg(F.count("*").alias("n")))


@register("formula_overflow", _A_SENTENCES + f"""
SELECT doc_id, bool_or({S.process_overflow('toks')}) AS unprocessable FROM k GROUP BY doc_id""")
def formula_overflow(spark, sf_dir):
    """abstracts with an amount that overflows are unprocessable."""
    out = corpus.normalise(_abstracts(spark, sf_dir), "api")
    return out.groupBy("doc_id").agg(F.bool_or("unprocessable").alias("unprocessable"))


# ------------------------------------------------------------ markup strip
@register("strip_markup", f"""
SELECT page_id, regexp_replace(html, '<[A-Za-z/!?][^>]*>', '', 'g') AS text,
       regexp_replace(html, {S.q(chr(92) + 's*' + chr(92) + '<[^)]*' + chr(92) + '>')}, '', 'g') AS text_compat
FROM pages""")
def strip_markup_query(spark, sf_dir):
    """Tags removed from every page (text kept), plus the compatibility
    mode that reproduces the original pattern."""
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", strip_markup(F.col("html")).alias("text"),
                        strip_markup(F.col("html"), compat=True).alias("text_compat"))


# ------------------------------------------------- dictionaries and recipes
from ..functions.fixed_values import SPELLING_GB_US  # noqa: E402
from ..operators.lemmas import plural_lemmas, spelling_table  # noqa: E402


def _documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _with_dictionaries(spark, docs):
    """Spelling list attached as one value, and the lemma table derived from
    the corpus vocabulary."""
    lemmas = cut_lineage(plural_lemmas(corpus.token_rows(docs.select("doc_id", "text"))), "lemmas")
    return tx.attach_spelling(docs, spelling_table(spark, SPELLING_GB_US)), lemmas


def _spell_sql(x: str) -> str:
    for gb, us in SPELLING_GB_US:
        x = f"replace({x}, {S.q(gb)}, {S.q(us)})"
    return x


_STOP = tx.default_stop_words()
_LEMMA_CTE = TOKENS_CTE + """
, vocab AS (SELECT DISTINCT unnest(toks) AS form FROM k),
lem AS (SELECT v.form, substr(v.form, 1, length(v.form) - 1) AS lemma FROM vocab v
        JOIN vocab w ON w.form = substr(v.form, 1, length(v.form) - 1)
        WHERE length(v.form) >= 4 AND suffix(v.form, 's')),
lm AS (SELECT coalesce(map_from_entries(list({'key': form, 'value': lemma})), MAP {}) AS m FROM lem)"""


def _lemma_sql(toks: str) -> str:
    t = S.v("t")
    return f"list_transform({toks}, lambda {t}: coalesce(map_extract_value(lm.m, {t}), {t}))"


@register("lemma_lookup", _LEMMA_CTE + f"""
SELECT k.doc_id, k.sent_no, array_to_string({_lemma_sql(S.stop_filter('k.toks', _STOP))}, ' ') AS lemmatized
FROM k, lm""")
def lemma_lookup(spark, sf_dir):
    """T16 + T15: stop words dropped, then every token replaced by its lemma
    (lemma table derived from the corpus vocabulary, a broadcast lookup)."""
    docs = _documents(spark, sf_dir)
    lemmas = plural_lemmas(corpus.token_rows(docs.select("doc_id", "text")))
    s = _sentence_tokens(spark, sf_dir).withColumn("toks", tx.remove_stop_words(F.col("toks")))
    out = tx.lemmatize_column(s, "toks", lemmas)
    return out.select("doc_id", "sent_no", F.array_join("toks", " ").alias("lemmatized"))


@register("spelling_fold", f"""
SELECT doc_id, {_spell_sql('text')} AS text FROM documents""")
def spelling_fold(spark, sf_dir):
    """Ordered British -> American substring replacement over every text."""
    docs = tx.attach_spelling(_documents(spark, sf_dir), spelling_table(spark, SPELLING_GB_US))
    return docs.select("doc_id", tx.fold_spelling(F.col("text"), F.col("_spelling")).alias("text"))


_DOC_TOKENS = f"flatten(list_transform({S.sentences('d.text')}, lambda x_s: {S.tokens('x_s')}))"


@register("normalise_api", TOKENS_CTE + f"""
, p AS (SELECT doc_id, sent_no, array_to_string({S.process('toks')}, ' ') AS processed,
               {S.process_overflow('toks')} AS overflow FROM k)
SELECT d.doc_id, coalesce(string_agg(p.processed, chr(10) ORDER BY p.sent_no), '') AS processed_abstract,
       coalesce(bool_or(p.overflow), false) AS unprocessable
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def normalise_api(spark, sf_dir):
    """API recipe (T1 -> T14 per sentence -> T18) on every document, with the
    unprocessable flag (F3)."""
    out = corpus.normalise(_documents(spark, sf_dir), "api")
    return out.select("doc_id", "processed_abstract", "unprocessable")


@register("normalise_loader", _LEMMA_CTE + f"""
, d1 AS (SELECT d.doc_id, {_DOC_TOKENS} AS toks FROM documents d),
d2 AS (SELECT doc_id, {_spell_sql(f"array_to_string({_lemma_sql(S.stop_filter('d1.toks', _STOP))}, ' ')")} AS base
       FROM d1, lm),
d3 AS (SELECT doc_id, flatten(list_transform({S.sentences('base')}, lambda x_b: {S.tokens('x_b')})) AS toks FROM d2)
SELECT doc_id, array_to_string({S.process('toks')}, ' ') AS processed_abstract FROM d3""")
def normalise_loader(spark, sf_dir):
    """Loader recipe: stop words + lemmas over the whole text -> spelling ->
    the token pipeline on one flat token list."""
    docs, lemmas = _with_dictionaries(spark, _documents(spark, sf_dir))
    out = corpus.normalise(docs, "loader", lemma_table=lemmas, spelling=F.col("_spelling"))
    return out.select("doc_id", "processed_abstract")


@register("normalise_s2orc", _LEMMA_CTE + f"""
, p AS (SELECT k.doc_id, k.sent_no,
              {_spell_sql(f"array_to_string({_lemma_sql(S.stop_filter('k.toks', _STOP))}, ' ')")} AS sent,
              {S.process_overflow('k.toks')} AS overflow FROM k, lm)
SELECT d.doc_id, coalesce(string_agg(p.sent, chr(10) ORDER BY p.sent_no), '') AS processed_abstract,
       coalesce(bool_or(p.overflow), false) AS unprocessable
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def normalise_s2orc(spark, sf_dir):
    """S2ORC recipe: per sentence stop words + lemmas -> spelling; the token
    pipeline only decides whether the article is unprocessable."""
    docs, lemmas = _with_dictionaries(spark, _documents(spark, sf_dir))
    out = corpus.normalise(docs, "s2orc", lemma_table=lemmas, spelling=F.col("_spelling"))
    return out.select("doc_id", "processed_abstract", "unprocessable")


@register("clean_corpus", _LEMMA_CTE + f"""
, c AS (SELECT d.doc_id, flatten(list_transform(string_split(d.text, chr(10)), lambda x_c: {S.tokens('x_c')})) AS toks
        FROM documents d WHERE d.lang = 'en')
SELECT c.doc_id, {_spell_sql(f"array_to_string({_lemma_sql(S.stop_filter('c.toks', _STOP))}, ' ')")} AS cleaned
FROM c, lm""")
def clean_corpus_query(spark, sf_dir):
    """Articles carrying the tag ``en`` (tags = language and source)
    cleaned with stop words, lemmas and spelling, one record each."""
    docs = _documents(spark, sf_dir)
    articles = docs.select("doc_id", F.col("text").alias("processed_abstract"),
                           F.array("lang", "source").alias("tags"))
    lemmas = plural_lemmas(corpus.token_rows(docs.select("doc_id", "text")))
    articles = tx.attach_spelling(articles, spelling_table(spark, SPELLING_GB_US))
    return corpus.clean_corpus(articles, "en", lemma_table=lemmas, spelling=F.col("_spelling"))


@register("corpus_text_roundtrip", _LEMMA_CTE + f"""
, c AS (SELECT d.doc_id, flatten(list_transform(string_split(d.text, chr(10)), lambda x_c: {S.tokens('x_c')})) AS toks
        FROM documents d WHERE d.lang = 'en')
SELECT {_spell_sql(f"array_to_string({_lemma_sql(S.stop_filter('c.toks', _STOP))}, ' ')")} AS cleaned
FROM c, lm""")
def corpus_text_roundtrip(spark, sf_dir):
    """T19 + S11: the cleaned corpus written as text records separated by
    ``\\n+++\\n`` under the checkpoint folder and read back record by record."""
    from ..functions.fixed_values import CORPUS_RECORD_SEP
    from ..session import scratch_path

    path = scratch_path(spark, "clean-corpus")
    corpus.write_corpus_text(clean_corpus_query(spark, sf_dir), path)
    return spark.read.option("lineSep", CORPUS_RECORD_SEP).text(path).select(F.col("value").alias("cleaned"))


_G_TOKEN_SQL = (f"{_pick_sql(ELEMENTS, 'l_suppkey')} || '(' || {_pick_sql(ELEMENTS, 'l_partkey')} || "
                f"{_pick_sql(_AMOUNTS, 'l_linenumber')} || {_pick_sql(ELEMENTS, 'l_partkey + 7')} || ')' || "
                f"{_pick_sql(_AMOUNTS, 'CAST(l_quantity AS BIGINT)')}")


@register("formula_groups", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, {_G_TOKEN_SQL} AS token FROM lineitem)
SELECT l_orderkey, l_linenumber, token, {S.is_formula('token')} AS is_formula,
       CASE WHEN {S.is_formula('token')} THEN {S.normalized_formula('token')} END AS normalized FROM k""")
def formula_groups(spark, sf_dir):
    """T9/T10 with a parenthesised group: members multiplied by the group
    factor, then the gcd normalisation (``Ca(OH)2`` -> ``CaH2O2``)."""
    li = _lineitem(spark, sf_dir)
    token = F.concat(_pick(ELEMENTS, F.col("l_suppkey")), F.lit("("), _pick(ELEMENTS, F.col("l_partkey")),
                     _pick(_AMOUNTS, F.col("l_linenumber")), _pick(ELEMENTS, F.col("l_partkey") + 7), F.lit(")"),
                     _pick(_AMOUNTS, F.col("l_quantity").cast("long")))
    info = mat.formula_info(F.col("token"))
    return li.select("l_orderkey", "l_linenumber", token.alias("token")).withColumn("_f", info).select(
        "l_orderkey", "l_linenumber", "token", F.col("_f.simple").alias("is_formula"),
        F.col("_f.normalized").alias("normalized"))
