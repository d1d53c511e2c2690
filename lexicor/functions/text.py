"""Text normalisation as Column expressions.

A document is split into sentences (array of strings), each sentence into
tokens (array of strings); every stage is a ``transform``/``filter`` over those
arrays, so a whole corpus job is one narrow (shuffle-free) projection.
The lemma table is a size-checked broadcast dict read by an Arrow-batched
UDF (with an equi-join path beyond the bound); the ordered spelling list is
one small array value attached by a scalar subquery.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import materials as mat
from .fixed_values import ELEMENT_NAMES, ELEMENTS, NUM_TOKEN, NUMBER_RE, PARAGRAPH_MARKER, PUNCT, SPLIT_UNITS, STOP_WORDS

# Sentence boundary: ., ! or ? followed by blanks, or a line break.
SENTENCE_END_RE = r"([.!?])[ \t]+"
EDGE_BLANKS_RE = r"^[ \t\r]+|[ \t\r]+$"
_EL = r"[A-Z][a-z]?(?:[0-9]+(?:\.[0-9]+)?)?"
# A token: a chemical formula with parenthesised groups, which may hold groups
# themselves (Ca(OH)2, Mg(Fe(CN)6)2), kept whole;
# letters/digits (with inner decimal points or commas followed by a digit,
# and an optional parenthesised numeral or number such as Fe(II), Si(111) or
# 1.2(3)); or any single other visible character.
_NUM = r"(?:[0-9]+(?:\.[0-9]+)?)?"
_GROUP = r"\((?:" + _EL + r")+\)" + _NUM
_GROUPS = r"\((?:" + _EL + "|" + _GROUP + r")+\)" + _NUM
TOKEN_RE = (r"(?:" + _EL + r")*(?:" + _GROUPS + r")+(?:" + _EL + r")*"
            r"|[\p{L}\p{M}\p{N}]+(?:[.,]\p{N}[\p{L}\p{M}\p{N}]*)*(?:\((?:\p{N}+|[IVXivx]+)\))?"
            r"|[^\p{Z}\t\n\x0B\f\r\p{L}\p{M}\p{N}]")


# The same tokens, found faster: a look at the first character before the
# formula, ASCII letters tested first, runs never given back (nothing that
# follows one needs its last character).
FAST_TOKEN_RE = (r"(?=[A-Z(])(?:" + _EL + r")*(?:" + _GROUPS + r")+(?:" + _EL + r")*"
                 r"|[a-zA-Z0-9\p{L}\p{M}\p{N}]++(?:[.,]\p{N}[\p{L}\p{M}\p{N}]*+)*+(?:\((?:\p{N}+|[IVXivx]+)\))?"
                 r"|[^\p{Z}\t\n\x0B\f\r\p{L}\p{M}\p{N}]")
# The tokens of a text without ASCII digits and opening parentheses: no
# formula, no numeral in parentheses.
PLAIN_TOKEN_RE = (r"[a-zA-Z\p{L}\p{M}\p{N}]++(?:[.,]\p{N}[\p{L}\p{M}\p{N}]*+)*+"
                  r"|[^\p{Z}\t\n\x0B\f\r\p{L}\p{M}\p{N}]")
RARE_LINE_END_RE = "[\u0085\u2028\u2029]"

_PUNCT_SET = sorted(set(PUNCT))
_SYMBOLS_OR_UNITS = sorted(set(ELEMENTS) | set(SPLIT_UNITS))


def is_punct(t: Column) -> Column:
    """Membership as ``IN`` over literals: the optimizer turns it into a hash
    set lookup (a literal array would be scanned linearly per token)."""
    return t.isin(*_PUNCT_SET)


def is_symbol_or_unit(t: Column) -> Column:
    return t.isin(*_SYMBOLS_OR_UNITS)


# ------------------------------------------------------------------ T1, T18
def mark_paragraphs(text: Column) -> Column:
    """S2ORC paragraph marker ``'::: '`` becomes a line break."""
    return F.replace(text, F.lit(PARAGRAPH_MARKER), F.lit("\n"))


def sentences(text: Column) -> Column:
    """Ordered, non-empty, trimmed sentences of a text."""
    parts = F.split(F.regexp_replace(text, SENTENCE_END_RE, "$1\n"), "\n")
    # To the pattern's ``$`` a rare line end at the end of a line is not there:
    # blanks before it go too. Without one, plain trimming does the same.
    trimmed = F.when(text.rlike(RARE_LINE_END_RE), F.transform(parts, lambda s: F.regexp_replace(s, EDGE_BLANKS_RE, ""))) \
        .otherwise(F.transform(parts, lambda s: F.trim(s, F.lit(" \t\r"))))
    return F.filter(trimmed, lambda s: s != "")


def join_sentences(sents: Column) -> Column:
    """Tokens joined by one space, sentences by a line break."""
    return F.array_join(F.transform(sents, lambda s: F.array_join(s, " ")), "\n")


def split_processed(text: Column) -> Column:
    """T18 reverse: ``processed_abstract`` -> sentences of tokens (an empty
    string gives one sentence with one empty token, as ``str.split``)."""
    return F.transform(F.split(text, "\n", -1), lambda s: F.split(s, " ", -1))


# ---------------------------------------------------------------------- T2
def tokens(text: Column, split_oxidation: bool = True) -> Column:
    """T2 (+T3/T4): tokens of one sentence, numbers split from units and
    oxidation states from elements."""
    found = F.regexp_extract_all(text, F.lit(FAST_TOKEN_RE), 0)
    # Only a token with a digit or a parenthesis can be split.
    return F.when(text.rlike("[0-9(]"), mat.split_tokens(found, split_oxidation)) \
        .otherwise(F.regexp_extract_all(text, F.lit(PLAIN_TOKEN_RE), 0))


# ----------------------------------------------------------------- T5-T14
def is_number(t: Column) -> Column:
    """Commas removed, then a plain or bracketed-uncertainty number."""
    return F.replace(t, F.lit(","), F.lit("")).rlike(NUMBER_RE)


def _bracketed(toks: Column, i: Column) -> Column:
    prev, nxt = F.get(toks, i - 1), F.get(toks, i + 1)
    return F.coalesce(((prev == "(") & (nxt == ")")) | ((prev == "〈") & (nxt == "〉")), F.lit(False))


def _is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def _is_lower(s: Column) -> Column:
    return (F.lower(s) == s) & (F.upper(s) != s)


def lower_candidate(t: Column) -> Column:
    """Single character, or Capitalised word, that is not an element
    symbol, a unit, or an element with a crystal direction."""
    shape = (F.length(t) == 1) | ((F.length(t) > 1) & _is_upper(F.substring(t, 1, 1))
                                  & _is_lower(F.substring(t, 2, 1 << 30)))
    return shape & ~is_symbol_or_unit(t) & ~mat.has_direction(t)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str, list[tuple[str, str]]]:
    """T12 transliteration built by rule: every letter of the Latin blocks and
    every full-width form whose compatibility decomposition is an ASCII
    character plus combining marks maps to that character, and Greek letters
    with marks to those without; letters without a decomposition that have a
    conventional ASCII spelling are listed as replacements."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        ch = chr(cp)
        dec = unicodedata.normalize("NFKD", ch)
        if dec != ch and dec[0].isascii() and dec[0].isalpha() and all(unicodedata.combining(c) for c in dec[1:]):
            src.append(ch)
            dst.append(dec[0])
    # Letters that do not decompose.
    specials = [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"),
                ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("þ", "th"),
                ("Þ", "Th"), ("ð", "d"), ("Ð", "D"), ("ı", "i"), ("ħ", "h"), ("Ħ", "H")]
    greek = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω",
                     "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
    for cp in range(0x386, 0x3CF):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        low = greek.get(base.lower())
        if low:
            specials.append((chr(cp), low if base == base.lower() else low.capitalize()))
    return "".join(src), "".join(dst), specials


def remove_accents(t: Column) -> Column:
    """ASCII transliteration of Latin letters, for tokens longer than 1."""
    src, dst, specials = accent_table()
    out = F.translate(t, src, dst)
    for a, b in specials:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when((F.length(t) > 1) & t.rlike(r"[^\x00-\x7F]"), out).otherwise(t)


def process_tokens(toks: Column, exclude_punct: bool = False, convert_num: bool = True,
                   normalize_materials: bool = True, accents: bool = True,
                   formulas: Column | None = None) -> Column:
    """Per token, in order: punctuation drop (T5), number mask (T6/T7),
    element name (T8), simple formula (T9/T10), selective lower-case (T11),
    then accent removal (T12). Returns ``ARRAY<STRUCT<tok, orig, norm>>``:
    ``tok`` is null for a dropped token; ``norm`` is set for a material
    mention (T13) whose original text is ``orig``. ``formulas``: the
    ``formula_table`` of the tokens as a column, needed inside a lambda.
    The table has an entry for every token, so a long array costs no search.
    """
    def one_of(toks, table):
        def one(t, i):
            info = F.struct(mat.element_name_symbol(t).alias("sym"), F.get(table, i).alias("f"),
                            (is_number(t) if convert_num else F.lit(False)).alias("num"))

            def body(x):
                symbol, norm_formula = x["sym"], x["f"]["normalized"]
                formula = F.coalesce(x["f"]["simple"], F.lit(False))
                out = F.when(F.lit(exclude_punct) & is_punct(t), F.lit(None))
                if convert_num:
                    out = out.when(x["num"], F.when(_bracketed(toks, i), t).otherwise(F.lit(NUM_TOKEN)))
                out = (out.when(symbol.isNotNull(), F.lower(t))
                       .when(formula, norm_formula if normalize_materials else t)
                       .when(lower_candidate(t), F.lower(t))
                       .otherwise(t))
                if accents:
                    out = remove_accents(out)
                dropped = F.lit(exclude_punct) & is_punct(t)
                numeric = x["num"]
                mention = (F.when(dropped | numeric, F.lit(None).cast("string"))
                           .when(symbol.isNotNull(), symbol)
                           .when(formula, norm_formula))
                return F.struct(out.cast("string").alias("tok"), t.alias("orig"), mention.alias("norm"),
                                F.coalesce(x["f"]["overflow"], F.lit(False)).alias("overflow"))

            # Fast path: a plain lower-case ASCII word is not punctuation, a
            # number, a formula (those start upper-case) or accented, and
            # lower-casing leaves it unchanged; only the element-name test
            # applies. Most tokens take this branch.
            plain = F.struct(t.alias("tok"), t.alias("orig"),
                             F.when(t.isin(*ELEMENT_NAMES), mat.element_name_symbol(t)).alias("norm"),
                             F.lit(False).alias("overflow"))
            return F.when(t.rlike("^[a-z]+$"), plain).otherwise(mat.let(info, body))
        return one

    table = mat.formula_table(toks) if formulas is None else formulas
    return mat.let(F.struct(toks.alias("t"), table.alias("f")), lambda x: F.transform(x["t"], one_of(x["t"], x["f"])))


def processed(steps: Column) -> Column:
    """Tokens kept by ``process_tokens``."""
    return F.filter(F.transform(steps, lambda s: s["tok"]), lambda t: t.isNotNull())


def mentions(steps: Column) -> Column:
    """``(original, normalized)`` material mentions of ``process_tokens``."""
    return F.transform(F.filter(steps, lambda s: s["norm"].isNotNull()),
                       lambda s: F.struct(s["orig"].alias("original"), s["norm"].alias("normalized")))


# ---------------------------------------------------------------- T15-T17
def default_stop_words() -> tuple[str, ...]:
    """The default English stop-word list."""
    return STOP_WORDS


def remove_stop_words(toks: Column, stop_words=None) -> Column:
    """Drop tokens whose lower-case form is a stop word (order and
    repeats of the other tokens are kept)."""
    stop = sorted(set(stop_words or default_stop_words()))
    return F.filter(toks, lambda t: ~F.lower(t).isin(*stop))


def remove_punct(toks: Column) -> Column:
    """T5: drop punctuation tokens."""
    return F.filter(toks, lambda t: ~is_punct(t))


MAX_DICTIONARY_ROWS = 2_000_000


def broadcast_dictionary(table: DataFrame, key_col: str, value_col: str | None = None,
                         max_rows: int = MAX_DICTIONARY_ROWS):
    """A lookup table as a broadcast Python dict (or set when ``value_col`` is
    None); None if it has more than ``max_rows`` rows: callers take their join
    path then. Spark's own map lookups scan keys linearly, so a large
    dictionary must not be a map value."""
    spark = table.sparkSession
    cols = [key_col] if value_col is None else [key_col, value_col]
    # one bounded pass: the size check and the rows come from the same job
    rows = table.select(*cols).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    if value_col is None:
        value = {r[0] for r in rows}
    else:
        value = {}
        for k, val in rows:
            if k is not None and (k not in value or val < value[k]):
                value[k] = val
    return spark.sparkContext.broadcast(value)


def lemmatize(toks: Column, lemmas, nested: bool = False) -> Column:
    """Every token replaced by its lemma (``lemmas``: broadcast dict from
    ``broadcast_dictionary``). Arrow-batched: one dict lookup per token.
    ``nested=True`` takes an array of token arrays (one per sentence)."""
    rtype = "array<array<string>>" if nested else "array<string>"

    @F.pandas_udf(rtype)
    def lookup(col: pd.Series) -> pd.Series:
        d = lemmas.value
        if nested:
            return pd.Series([None if row is None else [[d.get(t, t) for t in s] for s in row] for row in col])
        return pd.Series([None if row is None else [d.get(t, t) for t in row] for row in col])

    # Nondeterministic only as an optimizer barrier: the UDF must stay in its
    # own projection, never be inlined into a consumer's lambda.
    return lookup.asNondeterministic()(toks)


def lemmatize_column(df: DataFrame, col: str, lemmas: DataFrame, max_rows: int = MAX_DICTIONARY_ROWS,
                     nested: bool = False) -> DataFrame:
    """T15 on a token-array column (``nested``: an array of token arrays):
    broadcast lookup when the lemma table is within ``max_rows``, otherwise an
    equi-join of the tokens of every distinct array, found again by the
    array's digest (a group is one array's tokens)."""
    lookup = broadcast_dictionary(lemmas, "form", "lemma", max_rows)
    if lookup is not None:
        return df.withColumn(col, lemmatize(F.col(col), lookup, nested))
    flat = F.flatten(col) if nested else F.col(col)
    keyed = df.withColumn("_key", F.sha2(F.array_join(flat, "\x1f"), 256))
    arrays = keyed.where(F.size(flat) > 0).select("_key", flat.alias("_flat")).dropDuplicates(["_key"])
    joined = lemmatize_by_join(arrays.select("_key", F.posexplode("_flat").alias("_p", "token")), lemmas, "token")
    back = (joined.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_p", "token"))).alias("_a"))
            .select("_key", F.transform("_a", lambda x: x["token"]).alias("_lem")))
    found = F.coalesce("_lem", F.array().cast("array<string>"))
    if nested:
        before = lambda i: F.aggregate(F.slice(col, 1, i), F.lit(0), lambda n, s: n + F.size(s))
        found = F.transform(col, lambda s, i: F.slice(found, before(i) + 1, F.size(s)))
    return (keyed.join(back, "_key", "left").withColumn(col, F.when(F.col(col).isNotNull(), found))
            .select(*df.columns))


def lemmatize_by_join(tok_rows: DataFrame, lemmas: DataFrame, token_col: str = "token") -> DataFrame:
    """T15 for dictionaries too large for one value: an equi-join of a token
    table (one row per token) to the lemma table."""
    lem = lemmas.groupBy("form").agg(F.min("lemma").alias("_lemma"))
    return (tok_rows.join(lem, tok_rows[token_col] == lem["form"], "left")
            .withColumn(token_col, F.coalesce("_lemma", token_col)).drop("form", "_lemma"))


def attach_spelling(df: DataFrame, spelling: DataFrame, column: str = "_spelling") -> DataFrame:
    """Attach the ordered GB->US list (``pos, gb, us``) as one array value: its
    replacements follow one another by definition, so it is never split."""
    value = spelling.select(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "gb", "us"))),
        lambda x: F.struct(x["gb"].alias("gb"), x["us"].alias("us")))).scalar()
    return df.withColumn(column, value)


def fold_spelling_tokens(toks: Column, spelling: Column) -> Column:
    """T17 token by token: replacements never span two tokens."""
    return F.transform(toks, lambda t: fold_spelling(t, spelling))


def fold_spelling(text: Column, spelling: Column) -> Column:
    """Ordered substring replacement gb -> us over the whole text (also
    inside words)."""
    return F.aggregate(spelling, text, lambda acc, x: F.replace(acc, x["gb"], x["us"]))
