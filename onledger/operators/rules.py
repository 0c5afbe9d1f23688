"""Rules as data: every failed rule adds its reason code, and unknown inputs fail."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from onledger.functions.guards import holds

Rule = tuple[str, Column]
Screen = Callable[..., DataFrame]

SCREENS: dict[str, Screen] = {}


def screen(name: str) -> Callable[[Screen], Screen]:
    """Register a screen: a function that adds ``score`` and ``reasons`` to a DataFrame."""

    def wrap(fn: Screen) -> Screen:
        SCREENS[name] = fn
        return fn

    return wrap


def apply_screen(name: str, rows: DataFrame, rules) -> DataFrame:
    return SCREENS[name](rows, rules)


def failed(rules: Sequence[Rule]) -> Column:
    """Reason codes of the rules that do not hold, in rule order. A rule is (code, condition that must hold).

    Short lists are joined instead of taking NULLs out of one array, which goes through a lambda and is not compiled.
    """
    none = F.array().cast(ArrayType(StringType(), containsNull=False))
    return F.concat(none, *[F.when(holds(ok), none).otherwise(F.array(F.lit(code))) for code, ok in rules])


def merged(*lists: Column) -> Column:
    """Sorted distinct union of reason lists."""
    out = lists[0]
    for other in lists[1:]:
        out = F.array_union(out, other)
    return F.array_sort(F.array_distinct(out))


def settle_reasons(reasons: Column, disproved: Column, established: Column) -> Column:
    """Drop the reasons stronger evidence disproves, then add those it establishes."""
    return F.array_union(F.array_except(reasons, disproved), established)


def classify(text: Column, prefixes: Mapping[str, Sequence[str]], default: str) -> Column:
    """Label of the first group with a prefix the text starts with."""
    out = None
    for label, group in prefixes.items():
        hit = F.lit(False)
        for prefix in group:
            hit = hit | text.startswith(prefix)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)
