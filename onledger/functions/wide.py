"""Exact signed integers of any token amount as ordered structs of limbs.

DECIMAL ends at 38 digits, 256-bit amounts have 78. A wide value is a struct of five BIGINT limbs to the base 10**18, highest
first: all but the highest are from 0 to 10**18 - 1, the highest carries the sign. Structs compare field by field, so ``<``,
``least``, ``min``, sorting and joins work on wide values as they are. Sums add the halves of the limbs as BIGINT (exact for 9 * 10**9
rows, beyond that they may raise) and settle the carries once. Any NULL operand gives NULL.

Operations are built-in functions only, put together as SQL text (small functions with a leading underscore), because building
them call by call takes longer than running them. Each names its operands by a lambda variable first (``_named``): otherwise
every limb would carry a copy of the whole operand, and nested operations would grow without bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

LIMBS = 5
BASE = 10 ** 18
HALF = 10 ** 9
FIELDS = tuple(f"w{i}" for i in reversed(range(LIMBS)))
TYPE = StructType([StructField(f, LongType()) for f in FIELDS])
_DEC = "DECIMAL(38,0)"
_NONE = "CAST(array() AS ARRAY<BIGINT>)"
_BITS = 48
_names = itertools.count()


def is_wide(kind: DataType) -> bool:
    return isinstance(kind, StructType) and tuple(kind.fieldNames()) == FIELDS


# --- SQL text ----------------------------------------------------------------------------------------------------------
def _fresh(n: int = 1) -> list[str]:
    return [f"wide_{next(_names)}" for _ in range(n)]


def _named(body: Callable[..., str], *values: str) -> str:
    """``body`` of values that are computed once."""
    name, = _fresh()
    fields = ", ".join(f"'v{i}', {v}" for i, v in enumerate(values))
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body(*[f'{name}.v{i}' for i in range(len(values))])}), 1)"


def _limbs(x: str) -> list[str]:
    """Lowest first."""
    return [f"{x}.w{i}" for i in range(LIMBS)]


def _struct(low_first: list[str]) -> str:
    fields = ", ".join(f"'w{i}', CAST({low_first[i]} AS BIGINT)" for i in reversed(range(LIMBS)))
    return f"CASE WHEN {low_first[-1]} IS NOT NULL THEN named_struct({fields}) END"


def _number(value: int) -> str:
    parts = [value // BASE ** i if i == LIMBS - 1 else value // BASE ** i % BASE for i in range(LIMBS)]
    return "named_struct(" + ", ".join(f"'w{i}', {parts[i]}L" for i in reversed(range(LIMBS))) + ")"


def _settled(parts: list[str]) -> str:
    """Value of BIGINT limbs, lowest first, that lie between -3 and 4 times the base. Without carries they are taken as they are;
    else a carry runs into the highest limb, and with it any NULL."""
    out, carry = [], None
    for p in parts[:-1]:
        now = p if carry is None else f"({p} + {carry})"
        out.append(f"pmod({now}, {BASE}L)")
        carry = f"(({now} + {4 * BASE}L) div {BASE}L - 4L)"
    plain = " AND ".join(f"{p} >= 0 AND {p} < {BASE}L" for p in parts[:-1])
    whole = ", ".join(f"'w{i}', CAST({parts[i]} AS BIGINT)" for i in reversed(range(LIMBS)))
    return f"CASE WHEN {plain} AND {parts[-1]} IS NOT NULL THEN named_struct({whole}) ELSE {_struct([*out, f'({parts[-1]} + {carry})'])} END"


def _digits(parts: str) -> str:
    """Digits to the base and last carry of an array of decimal limbs that are not negative."""
    a, x = _fresh(2)
    now = f"CAST({x} + {a}.c AS {_DEC})"
    step = f"named_struct('c', {now} div {BASE}BD, 'd', concat({a}.d, array(CAST(pmod({now}, {BASE}BD) AS BIGINT))))"
    return f"aggregate({parts}, named_struct('c', 0L, 'd', {_NONE}), ({a}, {x}) -> {step})"


def _settled_sums(array: str) -> str:
    """Value of an array of decimal limbs. The highest, which has the sign, is left out of the division."""
    out, carry = [], None
    for i in range(LIMBS - 1):
        p = f"element_at({array}, {i + 1})"
        now = p if carry is None else f"CAST({p} + {carry} AS {_DEC})"
        out.append(f"CAST(pmod({now}, {BASE}BD) AS BIGINT)")
        carry = f"({now} div {BASE}BD)"
    return _struct([*out, f"(CAST(element_at({array}, {LIMBS}) AS BIGINT) + {carry})"])


def _settled_halves(*sums: str) -> str:
    """Value of BIGINT sums of half limbs, lowest first; all but the highest are not negative."""
    parts, carry = [], None
    for low, high in zip(sums[::2], sums[1::2]):
        if len(parts) == LIMBS - 1:
            parts.append(f"({high} * {HALF}L + {low} + {carry})")
        else:
            whole = f"({high} + {low} div {HALF}L)"
            rest = f"({whole} % {HALF}L * {HALF}L + {low} % {HALF}L)"
            parts.append(rest if carry is None else f"({rest} + {carry})")
            carry = f"{whole} div {HALF}L"
    return _named(lambda *p: _settled(list(p)), *parts)


def _plus(x: str, y: str) -> str:
    return _settled([f"({p} + {q})" for p, q in zip(_limbs(x), _limbs(y))])


def _minus(x: str, y: str) -> str:
    return _settled([f"({p} - {q})" for p, q in zip(_limbs(x), _limbs(y))])


def _negate(x: str) -> str:
    return _settled([f"(-{p})" for p in _limbs(x)])


def _negative(x: str) -> str:
    return f"({x}.w{LIMBS - 1} < 0)"


def _magnitude(x: str) -> str:
    return f"CASE WHEN {_negative(x)} THEN {_negate(x)} ELSE {x} END"


def _word(word: str, two: bool) -> str:
    """Value of 64 hex digits: the lowest 60 bits alone, or the lowest 120 as one decimal, where the rest is zero or all ones, else
    six chunks times their weights."""
    starts = [65 - 12 * (i + 1) for i in range(5)]
    chunks = "array(" + ", ".join([f"CAST(conv(substring({word}, {at}, 12), 16, 10) AS DECIMAL(15,0))" for at in starts]
                                  + [f"CAST(conv(substring({word}, 1, 4), 16, 10) AS DECIMAL(15,0))"]) + ")"
    weights = "array(" + ", ".join("array(" + ", ".join(f"CAST({(1 << (_BITS * i)) // BASE ** j % BASE} AS DECIMAL(18,0))" for i in range(6)) + ")"
                                   for j in range(LIMBS)) + ")"

    def added(chunks):
        w, c, x, a, y = _fresh(5)
        terms = f"zip_with({chunks}, {w}, ({c}, {x}) -> CAST({c} * {x} AS {_DEC}))"
        return f"transform({weights}, {w} -> aggregate({terms}, CAST(0 AS {_DEC}), ({a}, {y}) -> CAST({a} + {y} AS {_DEC})))"

    def piece(at):
        return f"CAST(conv(substring({word}, {at}, 15), 16, 10) AS BIGINT)"

    def split(v):
        return f"CASE WHEN {v} < {BASE}L THEN {_struct([v, '0L', '0L', '0L', '0L'])} ELSE {_struct([f'({v} - {BASE}L)', '1L', '0L', '0L', '0L'])} END"

    long_way = _named(_settled_sums, _named(added, chunks))
    both = f"CAST(CAST({piece(35)} AS DECIMAL(19,0)) * {1 << 60}BD + {piece(50)} AS {_DEC})"
    out = f"CASE WHEN startswith({word}, '{'0' * 49}') THEN {_named(split, piece(50))} WHEN startswith({word}, '{'0' * 34}') THEN {_decimal(both)}"
    if two:
        out += f" WHEN startswith(lower({word}), '{'f' * 49}') THEN {_named(lambda v: _settled([v] + ['0L'] * (LIMBS - 1)), f'{piece(50)} - {1 << 60}L')}"
        out += f" WHEN startswith(lower({word}), '{'f' * 34}') THEN {_decimal(f'CAST({both} - {1 << 120}BD AS {_DEC})')}"
        out += f" WHEN {word} >= '8' THEN {_named(lambda v: _minus(v, _number(1 << 256)), long_way)}"
    return f"CASE WHEN {word} RLIKE '^[0-9a-fA-F]{{64}}$' THEN {out} ELSE {long_way} END END"


def _decimal(value: str) -> str:
    """Value of a DECIMAL(38,0): its digits are cut as text, which is cheaper than dividing decimals."""
    def cut(text, digits):
        parts = [f"CAST(substring({digits}, {at}, {size}) AS BIGINT)" for at, size in ((21, 18), (3, 18), (1, 2))]
        return (f"CASE WHEN startswith({text}, '-') THEN {_named(lambda *p: _settled([*p, '0L', '0L']), *[f'(-{p})' for p in parts])} "
                f"ELSE {_struct([*parts[:2], parts[2], '0L', '0L'])} END")

    return _named(lambda text: _named(cut, text, f"lpad(ltrim('-', {text}), 38, '0')"), f"CAST({value} AS STRING)")


def _from_text(text: str) -> str:
    def read(text, digits):
        parts = [f"CAST(substring({digits}, {18 * (LIMBS - 1 - i) + 1}, 18) AS BIGINT)" for i in range(LIMBS)]
        return (f"CASE WHEN NOT {text} RLIKE '^-?0*[0-9]{{1,90}}$' THEN NULL WHEN startswith({text}, '-') THEN {_settled([f'(-{p})' for p in parts])} "
                f"ELSE {_struct(parts)} END")

    return _named(read, text, f"lpad(regexp_replace({text}, '^-?0*', ''), {18 * LIMBS}, '0')")


def _to_text(x: str) -> str:
    def write(x, size):
        low, more, *rest = _limbs(size)
        digits = ", ".join(f"lpad(CAST({p} AS STRING), {19 if i == 0 else 18}, '0')" for i, p in enumerate(reversed(_limbs(size))))
        high = " AND ".join(f"{p} = 0" for p in rest)
        plain = (f"CASE WHEN {high} AND {more} = 0 THEN CAST({low} AS STRING) WHEN {high} THEN concat(CAST({more} AS STRING), lpad(CAST({low} AS STRING), 18, '0')) "
                 f"ELSE regexp_replace(concat({digits}), '^0+(?=.)', '') END")
        return f"concat(CASE WHEN {_negative(x)} THEN '-' ELSE '' END, {plain})"

    return _named(write, x, _magnitude(x))


def _to_double(x: str) -> str:
    def read(x, size):
        terms = " + ".join(f"CAST({p} AS DOUBLE) * {BASE ** i:.1e}D" for i, p in reversed(list(enumerate(_limbs(size)))))
        return f"(CASE WHEN {_negative(x)} THEN -1.0D ELSE 1.0D END) * ({terms})"

    return _named(read, x, _magnitude(x))


def _product(v: str, w: str) -> str:
    x, y = ([f"CAST({p} AS DECIMAL(18,0))" for p in _limbs(c)] for c in (v, w))
    parts = []
    for k in range(2 * LIMBS - 1):
        term = None
        for i in range(max(0, k - LIMBS + 1), min(LIMBS, k + 1)):
            one = f"CAST({x[i]} * {y[k - i]} AS {_DEC})"
            term = one if term is None else f"CAST({term} + {one} AS {_DEC})"
        parts.append(term)
    return f"({_digits('array(' + ', '.join(parts) + f', CAST(0 AS {_DEC}))')}).d"


def _floor_divide(numerator: str, denominator: str) -> str:
    size = 2 * LIMBS + 1

    def halves(array):
        x, = _fresh()
        return f"flatten(transform({array}, {x} -> array({x} % {HALF}L, {x} div {HALF}L)))"

    def significant(digits):
        d, = _fresh()
        at = f"array_position(transform({digits}, {d} -> {d} > 0), true)"
        return f"CASE WHEN {at} > 0 THEN slice({digits}, CAST({at} AS INT), size({digits})) ELSE array(0L) END"

    def double(number):
        a, d = _fresh(2)
        return f"aggregate(reverse({number}), 0.0D, ({a}, {d}) -> {a} * {float(HALF)}D + {d})"

    def settle(raw):
        a, x = _fresh(2)
        now = f"({x} + {a}.c)"
        step = f"named_struct('c', ({now} - pmod({now}, {HALF}L)) div {HALF}L, 'd', concat({a}.d, array(pmod({now}, {HALF}L))))"
        return f"aggregate({raw}, named_struct('c', 0L, 'd', {_NONE}), ({a}, {x}) -> {step})"

    def divide(digits, by):
        state, digit = _fresh(2)

        def taken(rest):
            def finished(rest, guess):
                r, d, p, q = _fresh(4)
                left = settle(f"zip_with({rest}, {by}.digits, ({r}, {d}) -> {r} - {guess} * {d})")

                def result(s):
                    back = settle(f"zip_with({s}.d, {by}.digits, ({p}, {q}) -> {p} + {q})")
                    return (f"named_struct('rest', CASE WHEN {s}.c < 0 THEN ({back}).d ELSE {s}.d END, "
                            f"'found', concat({state}.found, array(CASE WHEN {s}.c < 0 THEN {guess} - 1L ELSE {guess} END)))")

                return _named(result, left)

            return _named(finished, rest, f"CAST(floor({double(rest)} / {by}.whole + 0.00001D) AS BIGINT)")

        shifted = f"concat(array({digit}), slice({state}.rest, 1, {size - 1}))"
        start = f"named_struct('rest', array_repeat(0L, {size}), 'found', {_NONE})"
        found = f"aggregate({digits}, {start}, ({state}, {digit}) -> {_named(taken, shifted)}).found"

        def gathered(low):
            return _struct([f"(element_at({low}, {2 * i + 1}) + element_at({low}, {2 * i + 2}) * {HALF}L)" for i in range(LIMBS)])

        return _named(gathered, f"concat(reverse({found}), array_repeat(0L, {2 * LIMBS}))")

    digits = _named(significant, f"reverse({halves(numerator)})")
    divisor = _named(lambda d: f"named_struct('digits', {d}, 'whole', {double(d)})", f"concat({halves('array(' + ', '.join(_limbs(denominator)) + ')')}, array(0L))")
    return f"CASE WHEN {denominator} > {_number(0)} THEN {_named(divide, digits, divisor)} END"


# --- columns -----------------------------------------------------------------------------------------------------------
def apply(body: Callable[..., str], *values: Column) -> Column:
    """SQL text over columns, each computed once."""
    name, = _fresh()
    text = body(*[f"{name}.v{i}" for i in range(len(values))])
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.call_function("transform", F.array(named), F.expr(f"{name} -> {text}")), 1)


def constant(value: int) -> Column:
    return F.expr(_number(value))


def zero() -> Column:
    return constant(0)


def plus(a: Column, b: Column) -> Column:
    return apply(_plus, a, b)


def minus(a: Column, b: Column) -> Column:
    return apply(_minus, a, b)


def negate(a: Column) -> Column:
    return apply(_negate, a)


def negative(a: Column) -> Column:
    return a.getField(f"w{LIMBS - 1}") < 0


def magnitude(a: Column) -> Column:
    return apply(_magnitude, a)


def sign(a: Column) -> Column:
    return apply(lambda x: f"CASE WHEN {_negative(x)} THEN -1 WHEN {x} > {_number(0)} THEN 1 WHEN {x} IS NOT NULL THEN 0 END", a)


def total(a: Column, over=None) -> Column:
    """Sum of a wide column, as an aggregate or over a window; NULL if there is no value."""
    half, sums = F.lit(HALF).cast("bigint"), []
    for i in range(LIMBS):
        limb = a.getField(f"w{i}")
        low = F.pmod(limb, half)
        sums += [F.sum(low), F.sum(F.call_function("div", limb - low, half))]
    return apply(_settled_halves, *[s if over is None else s.over(over) for s in sums])


def of(value: Column) -> Column:
    """A BIGINT, INT or DECIMAL(38,0) value."""
    return apply(_decimal, value.cast(_DEC))


def of_word(word: Column) -> Column:
    """An unsigned word of 64 hex digits; anything else is NULL."""
    return apply(lambda w: _word(w, False), word)


def of_signed_word(word: Column) -> Column:
    """A two's-complement word of 64 hex digits."""
    return apply(lambda w: _word(w, True), word)


def of_text(text: Column) -> Column:
    """Decimal digits with an optional minus sign, up to 90 digits; anything else is NULL."""
    return apply(_from_text, text)


def to_text(a: Column) -> Column:
    """Decimal digits, with a minus sign for negative values."""
    return apply(_to_text, a)


def to_decimal(a: Column) -> Column:
    """DECIMAL(38,0), NULL beyond 38 digits."""
    return to_text(a).try_cast("decimal(38,0)")


def to_double(a: Column) -> Column:
    """The nearest double but for the last bit."""
    return apply(_to_double, a)


def product(a: Column, b: Column) -> Column:
    """Array of the limbs, lowest first, of the product of two values that are not negative: twice as many as of a value."""
    return apply(_product, a, b)


def floor_divide(numerator: Column, denominator: Column) -> Column:
    """Floor of an array of limbs (see ``product``) over a positive wide value; the result must be wide.

    Long division to the base 10**9. A digit is estimated from doubles, never too small and at most one too large, and the step
    is taken back where the rest would be negative.
    """
    return apply(_floor_divide, numerator, denominator)


def fee_quote(amount: Column, reserve_in: Column, reserve_out: Column, kept: int, per: int) -> Column:
    """Floor of amount * kept * reserve_out / (reserve_in * per + amount * kept), without any intermediate being cut."""

    def value(array):
        return _struct([f"element_at({array}, {i + 1})" for i in range(LIMBS)])

    def divide(o, paid, fed):
        return _named(lambda o, paid, whole: _floor_divide(_product(paid, o), whole), o, paid, _plus(fed, paid))

    def quote(a, i, o):
        return _named(lambda o, paid, fed: _named(divide, o, value(paid), value(fed)), o, _product(a, _number(kept)), _product(i, _number(per)))

    return apply(quote, amount, reserve_in, reserve_out)
