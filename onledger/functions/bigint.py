"""Exact 256-bit integers as arrays of eight 32-bit limbs, least significant first.

Decimals stop at 38 digits. Limbs are BIGINT, so a plain ``sum`` per limb is exact for 2**31 rows; carries are settled
once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 8
BASE = 1 << 32


def from_hex(word: Column) -> Column:
    """Limbs of a 64-digit hex word without prefix."""
    return F.array(*[
        F.conv(F.substring(word, 57 - 8 * i, 8), 16, 10).cast("bigint") for i in range(LIMBS)])


def from_int(value: Column) -> Column:
    """Limbs of a non-negative BIGINT."""
    base = F.lit(BASE)
    return F.array(value.cast("bigint") % base, F.floor(value / base).cast("bigint"),
                   *[F.lit(0).cast("bigint") for _ in range(LIMBS - 2)])


def limb(array: Column, i: int) -> Column:
    return F.element_at(array, i + 1)


def settle(raw: Column) -> Column:
    """Carry-normalise limb sums (limbs may be negative). Result: struct(negative, limbs of the absolute value)."""

    def carry(array: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("c"), F.array().cast("array<bigint>").alias("d"))

        def step(acc, x):
            total = x + acc["c"]
            digit = F.pmod(total, F.lit(BASE))
            return F.struct(F.shiftright(total - digit, 32).alias("c"), F.concat(acc["d"], F.array(digit)).alias("d"))

        return F.aggregate(array, start, step)

    up, down = carry(raw), carry(F.transform(raw, lambda x: -x))
    negative = up["c"] < 0
    return F.struct(negative.alias("negative"), F.when(negative, down["d"]).otherwise(up["d"]).alias("limbs"),
                    F.when(negative, down["c"]).otherwise(up["c"]).alias("overflow"))


def to_hex(settled: Column) -> Column:
    """Hex text of the absolute value with a sign."""
    digits = F.array_join(F.transform(F.reverse(settled["limbs"]), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(F.when(settled["negative"], "-").otherwise(""), F.lit("0x"), digits)


def to_decimal(settled: Column) -> Column:
    """DECIMAL(38,0) when the value fits, else NULL."""
    high = F.exists(F.slice(settled["limbs"], 5, 4), lambda x: x != 0) | (settled["overflow"] != 0)
    dec = "decimal(38,0)"
    base = F.lit(BASE).cast("decimal(10,0)")
    top = limb(settled["limbs"], 3)
    # below 2**126 the sum of limbs cannot overflow; between that and 10**38 the last step is checked
    total = top.cast(dec)
    for i in range(2, -1, -1):
        total = F.try_add(F.try_multiply(total, base), limb(settled["limbs"], i).cast("decimal(10,0)"))
    zero = F.lit(0).cast("decimal(1,0)")
    # a subtraction, because unary minus rounds to 34 digits
    return F.when(~high, F.when(settled["negative"], zero - total).otherwise(total)).cast(dec)


def limb_sums(array: Column, prefix: str) -> list[Column]:
    """One aggregate per limb, to be put into ``groupBy().agg``."""
    return [F.sum(limb(array, i)).alias(f"{prefix}{i}") for i in range(LIMBS)]


def gather(prefix: str) -> Column:
    return F.array(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0).cast("bigint")) for i in range(LIMBS)])
