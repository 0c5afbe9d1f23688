"""Arithmetic on amounts of whichever type a column has: plain numbers, or wide values (see ``wide``).

Scans and lot matching are written once against these operations. A BIGINT column keeps BIGINT arithmetic, which raises on
overflow; jobs over token amounts turn their inputs into wide values first (``exact``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from onledger.functions import wide
from onledger.session import materialize

NARROW = DecimalType(38, 0)
# --- fixed value: absolute amounts of a key must add up to less, so that no running sum or difference leaves 38 digits ------
NARROW_TOTAL = 10 ** 37
# --- fixed values: columns of token quantities that scans and lot matching add --------------------------------------------
QUANTITIES = ("quantity", "remaining", "lot_start", "bought", "held_before", "taken", "short", "head_final", "sold", "unknown_quantity")


class Plain:
    """BIGINT, DOUBLE or DECIMAL columns."""

    def __init__(self, kind: DataType):
        self.kind = kind

    def zero(self) -> Column:
        return F.lit(0).cast(self.kind)

    def plus(self, a: Column, b: Column) -> Column:
        return a + b

    def minus(self, a: Column, b: Column) -> Column:
        return a - b

    def negate(self, a: Column) -> Column:
        return self.zero() - a  # unary minus would round a decimal to 34 digits

    def total(self, a: Column, over=None) -> Column:
        return F.sum(a) if over is None else F.sum(a).over(over)

    def double(self, a: Column) -> Column:
        return a.cast("double")

    def bucket(self, a: Column, width: int) -> Column:
        if self.kind == NARROW:  # as wide values: by multiples of ``width`` times the base, so no position is too large for a bucket
            return F.call_function("div", a, F.lit(str(width * wide.BASE)).cast(NARROW))
        if isinstance(self.kind, DecimalType):
            return F.floor((a - F.pmod(a, F.lit(width).cast("decimal(19,0)"))) / F.lit(width).cast("decimal(19,0)")).try_cast("bigint")
        return F.floor(a / F.lit(width)).cast("bigint")


class Wide(Plain):
    """Wide values."""

    def zero(self) -> Column:
        return wide.zero()

    def plus(self, a: Column, b: Column) -> Column:
        return wide.plus(a, b)

    def minus(self, a: Column, b: Column) -> Column:
        return wide.minus(a, b)

    def negate(self, a: Column) -> Column:
        return wide.negate(a)

    def total(self, a: Column, over=None) -> Column:
        return wide.total(a, over)

    def double(self, a: Column) -> Column:
        return wide.to_double(a)

    def bucket(self, a: Column, width: int) -> Column:
        """Grows with the value, by multiples of ``width`` times the base; from 9 * 10**36 on all are in one."""

        def place(x):
            whole = f"({x}.w1 + least({x}.w2, 8L) * {wide.BASE}L)"
            return (f"CASE WHEN {x}.w4 < 0 THEN -1L WHEN {x}.w4 > 0 OR {x}.w3 > 0 OR {x}.w2 > 8 THEN {9 * wide.BASE // width + 1}L "
                    f"ELSE {whole} div {width}L END")

        return wide.apply(place, a)


def of_type(kind: DataType) -> Plain:
    return Wide(kind) if wide.is_wide(kind) else Plain(kind)


def of_column(rows: DataFrame, name: str) -> Plain:
    return of_type(rows.schema[name].dataType)


def exact(rows: DataFrame, quantities: Sequence[str] = ("quantity",), money: Sequence[str] = ("quote", "gas")) -> DataFrame:
    """Token quantities as wide values, money as DECIMAL(38,0) where it came as an integer."""
    out = {}
    for name in quantities:
        if not wide.is_wide(rows.schema[name].dataType):
            out[name] = wide.of(F.col(name))
    for name in money:
        if name in rows.columns and rows.schema[name].dataType.typeName() in ("long", "integer"):
            out[name] = F.col(name).cast("decimal(38,0)")
    return rows.withColumns(out) if out else rows


def by_width(rows: DataFrame, key: str, job: Callable[[DataFrame], Sequence[DataFrame]], quantity: str = "quantity",
             money: Sequence[str] = ("quote", "gas")) -> list[DataFrame]:
    """The results of ``job``, which treats every key on its own, with amounts in the narrowest exact type.

    DECIMAL(38,0) is several times cheaper than wide values. It serves the keys whose absolute amounts add up to less than 10**37,
    as then no sum of some of them is cut; the others, usually none, run on wide values. ``rows`` are read several times, so
    costly ones should be written down. Results hold DECIMAL(38,0) if there are no such keys, else wide values.
    """
    if is_wide_column(rows, quantity):
        return list(job(exact(rows, (quantity,), money)))
    rows = exact(rows.withColumn(quantity, F.col(quantity).cast(NARROW)), (), money)
    size = F.try_sum(F.abs(quantity))
    large = rows.groupBy(key).agg(size.alias("_size"), F.count(quantity).alias("_n")).filter(
        (F.col("_n") > 0) & ~F.coalesce(F.col("_size") < F.lit(str(NARROW_TOTAL)).cast(NARROW), F.lit(False))).select(F.col(key).alias("_key"))
    large = materialize(large, "wide-keys")  # read to see whether there are any, and by both joins
    if large.isEmpty():
        return list(job(rows))
    same = F.col(key).eqNullSafe(F.col("_key"))
    narrow, broad = rows.join(large, same, "left_anti"), exact(rows.join(large, same, "left_semi"), (quantity,), money)
    out = []
    for a, b in zip(job(narrow), job(broad)):
        wide_names = [f.name for f in b.schema if wide.is_wide(f.dataType)]
        out.append(exact(a, wide_names, ()).unionByName(b))
    return out


def is_wide_column(rows: DataFrame, name: str) -> bool:
    return wide.is_wide(rows.schema[name].dataType)


def text(rows: DataFrame, name: str) -> Column:
    """Decimal digits of an amount of whichever type."""
    return wide.to_text(F.col(name)) if is_wide_column(rows, name) else F.col(name).cast("string")


def widened(rows: DataFrame) -> DataFrame:
    """Every DECIMAL(38,0) quantity of a result of ``by_width`` as a wide value."""
    return exact(rows, [f.name for f in rows.schema if f.dataType == NARROW and f.name in QUANTITIES], ())
