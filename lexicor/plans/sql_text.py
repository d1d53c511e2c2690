"""DuckDB SQL fragments for the text queries' oracle statements.

Each function returns SQL text for one token or sentence expression, built
from the same fixed values as the Spark functions. Regex dialect notes: RE2
has no possessive quantifiers and spells the Latin script ``\\p{Latin}``.
"""

from __future__ import annotations

import itertools

from ..functions import materials as mat
from ..functions import text as tx
from ..functions.fixed_values import (
    DIATOMIC, ELEMENT_NAME_TO_SYMBOL, ELEMENTS, NUM_TOKEN, NUMBER_RE, PUNCT, REAL_ELEMENTS,
    SPLIT_UNITS, UNIT_SET, VALENCE_INFO_RE,
)

_ids = itertools.count()
# The statement's own patterns and step count: a one-level formula grammar
# (the test tables have no deeper groups) and more Euclid steps than any of
# their amounts needs.
_AMT = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)?"
SHAPE_RE = r"^(?:[A-Z][a-z]?" + _AMT + r"|\((?:[A-Z][a-z]?" + _AMT + r")+\)" + _AMT + r")+$"
PAIR_RE = r"([A-Z][a-z]?)([0-9]+\.?[0-9]*|\.[0-9]+)?"
UNIT_RE = r"\(((?:[A-Z][a-z]?" + _AMT + r")+)\)([0-9]+\.?[0-9]*|\.[0-9]+)?|" + PAIR_RE
EUCLID_STEPS = 48


def v(prefix: str = "x") -> str:
    """A fresh lambda variable name (nested lambdas must not shadow)."""
    return f"{prefix}{next(_ids)}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


NUMBER_UNIT_RE = r"(?s)^([+-]?\d*\.?\d+\(?\d*\)?)([\p{Latin}Ωμ]+.*)"
UNITS = sql_list(UNIT_SET)
PUNCTS = sql_list(sorted(set(PUNCT)))
SYM_UNITS = sql_list(sorted(set(ELEMENTS) | set(SPLIT_UNITS)))
REAL = sql_list(REAL_ELEMENTS)
NAME_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(s)}" for k, s in ELEMENT_NAME_TO_SYMBOL.items()) + "}"


def split_token(t: str) -> str:
    n = q(NUMBER_UNIT_RE)
    val = q(mat.VALENCE_SPLIT_RE)
    return (f"CASE WHEN regexp_matches({t}, {n}) AND list_contains({UNITS}, regexp_extract({t}, {n}, 2)) "
            f"THEN [regexp_extract({t}, {n}, 1), regexp_extract({t}, {n}, 2)] "
            f"WHEN contains({t}, '(') AND regexp_matches({t}, {val}) "
            f"THEN [regexp_extract({t}, {val}, 1), regexp_extract({t}, {val}, 2)] ELSE [{t}] END")


def tokens(s: str) -> str:
    t = v("t")
    return (f"flatten(list_transform(regexp_extract_all({s}, {q(tx.TOKEN_RE)}, 0), "
            f"lambda {t}: {split_token(t)}))")


def sentences(text: str) -> str:
    s, u = v("s"), v("s")
    marked = f"regexp_replace({text}, {q(tx.SENTENCE_END_RE)}, '\\1' || chr(10), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(10)), "
            f"lambda {s}: regexp_replace({s}, {q(tx.EDGE_BLANKS_RE)}, '', 'g')), lambda {u}: {u} <> '')")


def is_number(t: str) -> str:
    return f"regexp_matches(replace({t}, ',', ''), {q(NUMBER_RE)})"


def element_symbol(t: str) -> str:
    low = f"lower({t})"
    allowed = f"({t} = {low} OR {t} = upper(substr({low}, 1, 1)) || substr({low}, 2))"
    return f"(CASE WHEN {allowed} THEN map_extract_value({NAME_MAP}, {low}) END)"


def _amt(x: str, default: str = "1.0::DOUBLE") -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN {default} ELSE ({x})::DOUBLE END)"


def composition(t: str) -> str:
    unit = q(UNIT_RE)
    pair = q(PAIR_RE)
    inner, factor = f"regexp_extract_all({t}, {unit}, 1)", f"regexp_extract_all({t}, {unit}, 2)"
    sym, amt = f"regexp_extract_all({t}, {unit}, 3)", f"regexp_extract_all({t}, {unit}, 4)"
    g, i, e, j = v("g"), v("i"), v("e"), v("j")
    members = (f"list_transform(regexp_extract_all({g}, {pair}, 1), lambda {e}, {j}: {{'el': {e}, "
               f"'amt': {_amt(f'regexp_extract_all({g}, {pair}, 2)[{j}]')} * {_amt(f'{factor}[{i}]')}}})")
    single = f"[{{'el': {sym}[{i}], 'amt': {_amt(f'{amt}[{i}]')}}}]"
    parsed = (f"flatten(list_transform({inner}, lambda {g}, {i}: CASE WHEN coalesce({g}, '') <> '' "
              f"THEN {members} ELSE {single} END))")
    p, x, n, k, z, p2, p3, w = v("p"), v("x"), v("n"), v("k"), v("z"), v("p"), v("p"), v("w")
    names = f"list_transform({parsed}, lambda {p}: {p}.el)"
    distinct = f"list_filter({names}, lambda {n}, {k}: list_position({names}, {n}) = {k})"
    summed = (f"list_transform({distinct}, lambda {z}: {{'el': {z}, 'amt': list_sum(list_transform("
              f"list_filter({parsed}, lambda {p2}: {p2}.el = {z}), lambda {p3}: {p3}.amt))}})")
    return (f"(CASE WHEN regexp_matches({t}, {q(SHAPE_RE)}) THEN "
            f"list_filter({summed}, lambda {w}: {w}.amt > 1e-8) END)")


def is_formula(t: str) -> str:
    c = composition(t)
    p = v("p")
    real = f"len(list_filter({c}, lambda {p}: NOT list_contains({REAL}, {p}.el))) = 0"
    return (f"(NOT regexp_matches({t}, {q(VALENCE_INFO_RE)}) AND regexp_matches({t}, '[0-9a-z]') "
            f"AND ({t} IN ({', '.join(q(d) for d in DIATOMIC)}) OR ({c} IS NOT NULL AND len({c}) >= 2 AND {real})))")


def _pair_gcd(a: str, b: str) -> str:
    s, k = v("s"), v("k")
    return (f"(list_reduce(range({EUCLID_STEPS}), lambda {s}, {k}: CASE WHEN {s}.b > 0.001::DOUBLE "
            f"THEN {{'a': {s}.b, 'b': {s}.a % {s}.b}} ELSE {s} END, {{'a': ({a})::DOUBLE, 'b': ({b})::DOUBLE}})).a")


def normalized_formula(t: str) -> str:
    c = composition(t)
    p, n, x, p2, p3, p4 = v("p"), v("n"), v("x"), v("p"), v("p"), v("p")
    amts = f"list_transform({c}, lambda {p}: {p}.amt)"
    g = f"list_reduce({amts}, lambda {n}, {x}: {_pair_gcd(n, x)}, ({amts})[1])"
    ints = (f"list_transform({c}, lambda {p2}: {{'el': {p2}.el, "
            f"'n': TRY_CAST(round_even({p2}.amt / ({g}), 0) AS DECIMAL(38,0))}})")
    text = (f"array_to_string(list_transform(list_filter(list_sort({ints}), lambda {p3}: {p3}.n <> 0), "
            f"lambda {p4}: CASE WHEN {p4}.n > 1 THEN {p4}.el || CAST({p4}.n AS VARCHAR) ELSE {p4}.el END), '')")
    p5 = v("p")
    ok = f"({c} IS NOT NULL AND len({c}) > 0 AND len(list_filter({ints}, lambda {p5}: {p5}.n IS NULL)) = 0)"
    return f"(CASE WHEN {ok} THEN {text} ELSE {t} END)"


def lower_candidate(t: str) -> str:
    first, rest = f"substr({t}, 1, 1)", f"substr({t}, 2)"
    shape = (f"(length({t}) = 1 OR (length({t}) > 1 AND upper({first}) = {first} AND lower({first}) <> {first} "
             f"AND lower({rest}) = {rest} AND upper({rest}) <> {rest}))")
    direction = f"(contains({t}, '(') AND regexp_matches({t}, {q(mat.DIRECTION_RE)}))"
    return f"({shape} AND NOT list_contains({SYM_UNITS}, {t}) AND NOT {direction})"


def remove_accents(t: str) -> str:
    src, dst, specials = tx.accent_table()
    out = f"translate({t}, {q(src)}, {q(dst)})"
    for a, b in specials:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"(CASE WHEN length({t}) > 1 THEN {out} ELSE {t} END)"


def bracketed(toks: str, i: str) -> str:
    prev, nxt = f"{toks}[{i} - 1]", f"{toks}[{i} + 1]"
    return f"coalesce(({prev} = '(' AND {nxt} = ')') OR ({prev} = '〈' AND {nxt} = '〉'), false)"


def mask_numbers(toks: str) -> str:
    t, i = v("t"), v("i")
    return (f"list_transform({toks}, lambda {t}, {i}: CASE WHEN {is_number(t)} AND NOT {bracketed(toks, i)} "
            f"THEN {q(NUM_TOKEN)} ELSE {t} END)")


def process_token(t: str, i: str, toks: str, exclude_punct: bool = False) -> tuple[str, str]:
    """(output token SQL, mention SQL) for token ``t`` at 1-based ``i``."""
    sym, formula, normf = element_symbol(t), is_formula(t), normalized_formula(t)
    dropped = f"list_contains({PUNCTS}, {t})" if exclude_punct else "false"
    out = (f"CASE WHEN {dropped} THEN NULL "
           f"WHEN {is_number(t)} THEN CASE WHEN {bracketed(toks, i)} THEN {t} ELSE {q(NUM_TOKEN)} END "
           f"WHEN {sym} IS NOT NULL THEN lower({t}) WHEN {formula} THEN {normf} "
           f"WHEN {lower_candidate(t)} THEN lower({t}) ELSE {t} END")
    mention = (f"CASE WHEN {dropped} OR {is_number(t)} THEN NULL WHEN {sym} IS NOT NULL THEN {sym} "
               f"WHEN {formula} THEN {normf} END")
    return remove_accents(f"({out})"), mention


def process(toks: str, exclude_punct: bool = False) -> str:
    """Processed token list (dropped tokens removed)."""
    t, i, y = v("t"), v("i"), v("y")
    out, _ = process_token(t, i, toks, exclude_punct)
    return f"list_filter(list_transform({toks}, lambda {t}, {i}: {out}), lambda {y}: {y} IS NOT NULL)"


def mention_list(toks: str) -> str:
    t, i, y = v("t"), v("i"), v("y")
    _, men = process_token(t, i, toks)
    return (f"list_filter(list_transform({toks}, lambda {t}, {i}: {{'original': {t}, 'normalized': {men}}}), "
            f"lambda {y}: {y}.normalized IS NOT NULL)")


def stop_filter(toks: str, stop_words) -> str:
    t = v("t")
    return f"list_filter({toks}, lambda {t}: NOT list_contains({sql_list(sorted(set(stop_words)))}, lower({t})))"


def punct_filter(toks: str) -> str:
    t = v("t")
    return f"list_filter({toks}, lambda {t}: NOT list_contains({PUNCTS}, {t}))"


def unnest_sentences(table: str, id_col: str, text_col: str, where: str = "") -> str:
    """SELECT id, sent_no (0-based), sentence FROM table."""
    return (f"SELECT {id_col}, CAST(i - 1 AS INTEGER) AS sent_no, ss[i] AS sentence FROM ("
            f"SELECT {id_col}, ss, unnest(generate_series(1, len(ss))) AS i FROM ("
            f"SELECT {id_col}, {sentences(text_col)} AS ss FROM {table} {where}) WHERE len(ss) > 0)")


def process_overflow(toks: str) -> str:
    """F3 per sentence: a simple formula with an infinite amount."""
    t, p = v("t"), v("p")
    c = composition(t)
    return (f"coalesce(list_bool_or(list_transform({toks}, lambda {t}: coalesce({is_formula(t)} AND "
            f"len(list_filter({c}, lambda {p}: isinf({p}.amt))) > 0, false))), false)")
