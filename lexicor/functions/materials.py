"""Chemistry-aware token functions as Column expressions.

Most work on one token (a string Column, usually a lambda variable inside
``transform``): regexes with literal patterns, literal lists and maps. Formulas
need a parser and a division loop; they are described in an Arrow function
that sees only the tokens that may be formulas.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    DIATOMIC, DIRECTION_SUFFIX_RE, ELEMENT_NAME_TO_SYMBOL, ELEMENT_NAMES, ELEMENTS, ELEMENTS_AND_NAMES,
    NUMBER_UNIT_RE, REAL_ELEMENTS, UNIT_SET, VALENCE_INFO_RE, VALENCE_SUFFIX_COMPAT_RE,
    VALENCE_SUFFIX_RE,
)

_ALT = "|".join(ELEMENTS_AND_NAMES)
VALENCE_SPLIT_RE = r"^(" + _ALT + r")" + VALENCE_SUFFIX_RE + r"$"
VALENCE_SPLIT_COMPAT_RE = r"^(" + _ALT + r")" + VALENCE_SUFFIX_COMPAT_RE + r"$"
DIRECTION_RE = r"^(" + _ALT + r")" + DIRECTION_SUFFIX_RE
# One piece of a formula: a symbol or a closing parenthesis with an optional
# amount, or an opening parenthesis.
FORMULA_PIECE_RE = r"([A-Z][a-z]?|\))([0-9]+\.?[0-9]*|\.[0-9]+)?|(\()"
# What may be a formula of two or more elements, or a diatomic gas.
CANDIDATE_RE = r"^[A-Z(][A-Za-z0-9.()]*$"
_FORMULA_PIECE, _VALENCE_INFO, _DIGIT_OR_LOWER = re.compile(FORMULA_PIECE_RE), re.compile(VALENCE_INFO_RE), re.compile("[0-9a-z]")
_REAL = frozenset(REAL_ELEMENTS)
GCD_TOLERANCE = 1.0 / 1000
AMOUNT_TOLERANCE = 1e-8
#: A token of so many characters has no infinite amount (200 sums of 1e200).
MOST_FINITE = 200


def NAME_TO_SYMBOL() -> Column:
    return F.create_map(*[F.lit(x) for kv in ELEMENT_NAME_TO_SYMBOL.items() for x in kv])


def split_token(t: Column, split_oxidation: bool = True, compat: bool = False) -> Column:
    """One token -> array of 1 or 2 tokens.

    ``5V`` -> ``[5, V]`` when the tail is a listed unit (tested first);
    ``Fe(II)`` -> ``[Fe, (II)]`` when ``split_oxidation``; otherwise ``[t]``.
    """
    num = F.regexp_extract(t, NUMBER_UNIT_RE, 1)
    unit = F.regexp_extract(t, NUMBER_UNIT_RE, 2)
    is_unit = t.rlike(NUMBER_UNIT_RE) & unit.isin(*UNIT_SET)
    out = F.when(is_unit, F.array(num, unit))
    if split_oxidation:
        pat = VALENCE_SPLIT_COMPAT_RE if compat else VALENCE_SPLIT_RE
        is_val = t.contains("(") & t.rlike(pat)
        out = out.when(is_val, F.array(F.regexp_extract(t, pat, 1),
                                       F.regexp_extract(t, pat, 2)))
    return out.otherwise(F.array(t))


def split_tokens(tokens: Column, split_oxidation: bool = True, compat: bool = False) -> Column:
    return F.flatten(F.transform(tokens, lambda t: split_token(t, split_oxidation, compat)))


def element_name_symbol(t: Column) -> Column:
    """Symbol for an element name written lower-case or Capitalised, else null."""
    low = F.lower(t)
    allowed = (t == low) | (t == F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30)))
    # hash-set test first: the map lookup itself scans its keys
    return F.when(low.isin(*ELEMENT_NAMES) & allowed, F.try_element_at(NAME_TO_SYMBOL(), low))


def composition(token: str) -> dict[str, float] | None:
    """Amount per element of a formula (groups in parentheses, nested ones
    too, multiplied by their factor; amounts of nothing left out), in order of
    first appearance; None if the token is no formula."""
    found = _FORMULA_PIECE.findall(token)
    if sum([len(head) + len(amount) + len(opening) for head, amount, opening in found]) != len(token):
        return None
    levels: list[list[tuple[str, float]]] = [[]]
    for head, amount, opening in found:
        times = float(amount) if amount else 1.0
        if opening:
            levels.append([])
        elif head != ")":
            levels[-1].append((head, times))
        else:
            group = levels.pop()
            if not levels or not group:
                return None
            levels[-1] += [(el, n * times) for el, n in group]
    if len(levels) != 1 or not levels[0]:
        return None
    total: dict[str, float] = {}
    for el, n in levels[0]:
        total[el] = total.get(el, 0.0) + n
    return {el: n for el, n in total.items() if n > AMOUNT_TOLERANCE}


def integer_formula(amounts: dict[str, float]) -> str | None:
    """Amounts over their greatest common divisor (Euclid until the rest is
    within the tolerance), rounded half to even, symbols sorted, 1 left out, 0
    dropped; None if an amount is infinite."""
    if not amounts or not all(map(math.isfinite, amounts.values())):
        return None
    values = list(amounts.values())
    g = values[0]
    for n in values:
        while n > GCD_TOLERANCE:
            g, n = n, math.fmod(g, n)
    whole = {el: round(n / g) for el, n in amounts.items()}
    return "".join(el if whole[el] == 1 else f"{el}{whole[el]}" for el in sorted(whole) if whole[el])


def description(token: str) -> tuple[bool, str, bool]:
    """``(simple, normalized, overflow)`` of a token."""
    amounts = composition(token)
    simple = (not _VALENCE_INFO.search(token) and _DIGIT_OR_LOWER.search(token) is not None
              and (token in DIATOMIC or amounts is not None and len(amounts) >= 2
                   and _REAL.issuperset(amounts)))
    text = integer_formula(amounts) if amounts else None
    return simple, token if text is None else text, simple and bool(amounts) and math.inf in amounts.values()


@lru_cache(maxsize=200_000)
def _describe(token: str) -> tuple[bool, str, bool]:
    return description(token)


def _described(tokens: pa.Array) -> pa.Array:
    """Each distinct token of a batch is described once; null for null."""
    flat = tokens.dictionary_encode()
    rows = [_describe(t) for t in flat.dictionary.to_pylist()]
    known = pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()),
         pa.array([r[2] for r in rows], pa.bool_())], ["simple", "normalized", "overflow"])
    return known.take(flat.indices)


def _describe_lists(lists: pa.Array) -> pa.Array:
    """``_described`` on the innermost lists of a batch."""
    if not pa.types.is_list(lists.type):
        return _described(lists)
    if not len(lists):  # has no offsets that can be trusted
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), _describe_lists(pa.array([], lists.type.value_type)))
    ends = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _describe_lists(lists.flatten()))


def _is_candidate(t: Column) -> Column:
    return t.rlike(CANDIDATE_RE) & t.rlike("[0-9]|[A-Z].*[A-Z]")


def _candidates(toks: Column) -> Column:
    return F.transform(F.coalesce(toks, F.array().cast("array<string>")), lambda t: F.when(_is_candidate(t), t))


def formula_table(toks: Column, nested: bool = False) -> Column:
    """``ARRAY<STRUCT<simple, normalized, overflow>>`` beside the tokens of an
    array (T9, T10, F3): null where a token cannot be a formula. Those, most of
    all tokens, never leave the JVM. ``nested``: arrays of arrays of tokens.
    Not for use inside a lambda."""
    entry = "array<struct<simple:boolean,normalized:string,overflow:boolean>>"
    some = F.transform(F.coalesce(toks, F.array().cast("array<array<string>>")), _candidates) if nested else _candidates(toks)
    # Nondeterministic only as an optimizer barrier: its projection is never
    # inlined into that of another Python function.
    return F.arrow_udf(_describe_lists, f"array<{entry}>" if nested else entry).asNondeterministic()(some)


def any_overflow(toks: Column) -> Column:
    """Whether a token in an array of arrays is a formula that overflows.
    An amount is below ten to the number of its digits, groups included, so
    only long tokens meet Python. Not for use inside a lambda."""
    long = F.flatten(F.transform(toks, lambda s: F.filter(s, lambda t: F.octet_length(t) > MOST_FINITE)))
    return F.exists(formula_table(long), lambda x: F.coalesce(x["overflow"], F.lit(False)))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element
    ``transform``): Spark does not share repeated sub-expressions inside
    lambdas, so heavy values are bound this way."""
    return F.transform(F.array(value), fn)[0]


def formula_info(t: Column) -> Column:
    """T9 + T10 + F3 in one pass: ``STRUCT<simple, normalized, overflow>``
    (``normalized`` only for a simple formula)."""
    def body(x):
        simple = F.coalesce(x["simple"], F.lit(False))
        return F.struct(simple.alias("simple"), F.when(simple, x["normalized"]).alias("normalized"),
                        F.coalesce(x["overflow"], F.lit(False)).alias("overflow"))
    return let(F.get(formula_table(F.array(t)), F.lit(0)), body)


def is_simple_formula(t: Column) -> Column:
    """No valence information; has a digit or a lower-case letter; a
    diatomic gas, or at least two distinct real elements."""
    return formula_info(t)["simple"]


def normalized_formula(t: Column) -> Column:
    """Amounts divided by their float gcd (tolerance 1/1000), rounded half
    to even, symbols sorted, 1 omitted, 0 dropped. Unparsable -> unchanged."""
    return F.coalesce(F.get(formula_table(F.array(t)), F.lit(0))["normalized"], t)


def formula_overflows(t: Column) -> Column:
    """a simple formula with an amount too large for a double (the
    original's integer rounding overflows on it)."""
    return formula_info(t)["overflow"]


def has_direction(t: Column) -> Column:
    """``Si(111)``: element followed by a crystal direction."""
    return t.contains("(") & t.rlike(DIRECTION_RE)
