"""Join shapes Spark has no single operator for. None of them multiplies rows beyond its result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.operators.scan import running, width_bucket
from onledger.params import ScanRules


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner. NULL keys have no partner, so they stay (NOT EXISTS)."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def not_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """SQL ``NOT IN``: nothing qualifies once the list holds a NULL, and NULL never qualifies against a non-empty list."""
    total = right.select(F.count("*")).scalar()
    nulls = right.select(F.count_if(F.col(column).isNull())).scalar()
    kept = left.join(right.filter(F.col(column).isNotNull()).select(column).distinct(), [column], "left_anti")
    return kept.filter((total == 0) | ((nulls == 0) & F.col(column).isNotNull()))


def or_key(left: DataFrame, right: DataFrame, key: str, right_keys: Sequence[str]) -> DataFrame:
    """``left.key = right.a OR left.key = right.b`` as an equi-join: each right row is listed once per distinct key."""
    bridge = right.withColumn(key, F.explode(F.array_distinct(F.array(*right_keys))))
    return left.join(bridge, [key])


def range_totals(
    anchors: DataFrame, facts: DataFrame, keys: Sequence[str], anchor_id: Sequence[str], at: str, fact_at: str,
    window: int, values: Mapping[str, Column], scan: ScanRules = ScanRules(),
) -> DataFrame:
    """Totals of ``facts`` with ``at - window <= fact_at <= at`` for every anchor.

    A window total is the running total at its end minus the running total before its start, so the cost is one sort of
    facts and anchors together whatever the number of facts per window.
    """
    zero = F.lit(0).cast("bigint")
    lists = {name: F.coalesce(col, zero) for name, col in values.items()}
    marks = facts.select(*keys, F.col(fact_at).alias("_pos"), F.lit(1).alias("_kind"),
                         *[c.alias(f"_v_{n}") for n, c in lists.items()])
    marks = marks.groupBy(*keys, "_pos", "_kind").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in lists])
    ends = F.array(F.struct((F.col(at) - window).alias("_pos"), F.lit(0).alias("_kind")),
                   F.struct(F.col(at).alias("_pos"), F.lit(2).alias("_kind")))
    looks = anchors.select(*dict.fromkeys([*keys, *anchor_id, at])).withColumn("_e", F.explode(ends))
    looks = looks.select("*", "_e._pos", "_e._kind").drop("_e")
    both = marks.unionByName(looks, allowMissingColumns=True)
    order = ["_pos", "_kind", *[c for c in anchor_id if c not in keys]]
    got = running(both, keys, order, width_bucket("_pos", scan.bucket_seconds), max_rows=scan.max_rows,
                  sums={f"_r_{n}": (F.coalesce(F.col(f"_v_{n}"), zero), True) for n in lists}).filter("_kind <> 1")
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    group = list(dict.fromkeys([*keys, *anchor_id, at]))
    return got.groupBy(*group).agg(*[F.sum(F.col(f"_r_{n}") * sign).alias(n) for n in lists])


def trailing_distinct(
    anchors: DataFrame, facts: DataFrame, keys: Sequence[str], anchor_id: Sequence[str], at: str, member: str,
    fact_id: str, window: int, name: str, scan: ScanRules = ScanRules(),
) -> DataFrame:
    """Distinct members among ``facts`` with ``at - window <= fact.at <= at`` for every anchor, exactly.

    A member is present from a fact until ``window`` later; overlapping presences of one member merge. The answer at a
    time is presences begun minus presences ended, a running sum.
    """
    one = F.lit(1).cast("bigint")
    ordered = running(
        facts.select(*keys, member, F.col(at).alias("_at"), fact_id), [*keys, member], ["_at", fact_id],
        width_bucket("_at", scan.bucket_seconds), max_rows=scan.max_rows,
        lasts={"_prev": (F.col("_at"), False)}, nexts={"_next": (F.col("_at"), False)})
    begins = F.when(F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") > window),
                    F.struct(F.col("_at").alias("_pos"), F.lit(0).alias("_kind"), one.alias("_d")))
    finishes = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_at") > window),
                      F.struct((F.col("_at") + window).alias("_pos"), F.lit(2).alias("_kind"), (-one).alias("_d")))
    marks = ordered.withColumn("_e", F.explode(F.array_compact(F.array(begins, finishes)))).select(*keys, "_e.*")
    marks = marks.groupBy(*keys, "_pos", "_kind").agg(F.sum("_d").alias("_d"))
    looks = anchors.select(*dict.fromkeys([*keys, *anchor_id, at])).withColumns({"_pos": F.col(at), "_kind": F.lit(1)})
    both = marks.unionByName(looks, allowMissingColumns=True)
    order = ["_pos", "_kind", *[c for c in anchor_id if c not in keys]]
    got = running(both, keys, order, width_bucket("_pos", scan.bucket_seconds), max_rows=scan.max_rows,
                  sums={name: (F.coalesce(F.col("_d"), F.lit(0).cast("bigint")), True)})
    return got.filter("_kind = 1").drop("_pos", "_kind", "_d")


def asof_backward(
    lookups: DataFrame, facts: DataFrame, keys: Sequence[str], lookup_id: Sequence[str], at: str, available_at: str,
    payload: Sequence[str], fact_id: Sequence[str], max_age: int, scan: ScanRules = ScanRules(),
) -> DataFrame:
    """Newest fact with ``available_at <= at`` and ``at - available_at <= max_age``; NULL payload when there is none."""
    marks = facts.select(*keys, F.col(available_at).alias("_pos"), F.lit(0).alias("_kind"),
                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(fact_id)],
                         F.struct(F.col(available_at).alias("_at"), *payload).alias("_m"))
    looks = lookups.withColumns({"_pos": F.col(at), "_kind": F.lit(1)})
    both = marks.unionByName(looks, allowMissingColumns=True)
    order = ["_pos", "_kind", *[f"_o{i}" for i in range(len(fact_id))], *lookup_id]
    got = running(both, keys, order, width_bucket("_pos", scan.bucket_seconds), max_rows=scan.max_rows, lasts={"_f": (F.col("_m"), True)})
    got = got.filter("_kind = 1")
    fresh = F.col(at) - F.col("_f._at") <= max_age
    return got.select(*lookups.columns, F.when(fresh, F.col("_f._at")).alias("found_at"),
                      *[F.when(fresh, F.col(f"_f.{c}")).alias(c) for c in payload])


def asof_forward(
    lookups: DataFrame, facts: DataFrame, keys: Sequence[str], lookup_id: Sequence[str], at: str, fact_at: str,
    payload: Sequence[str], fact_id: Sequence[str], max_gap: int | None = None, scan: ScanRules = ScanRules(),
) -> DataFrame:
    """Earliest fact with ``fact_at >= at`` and, when a cap is given, ``fact_at - at <= max_gap``."""
    marks = facts.select(*keys, F.col(fact_at).alias("_pos"), F.lit(1).alias("_kind"),
                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(fact_id)],
                         F.struct(F.col(fact_at).alias("_at"), *payload).alias("_m"))
    looks = lookups.withColumns({"_pos": F.col(at), "_kind": F.lit(0)})
    both = marks.unionByName(looks, allowMissingColumns=True)
    order = ["_pos", "_kind", *[f"_o{i}" for i in range(len(fact_id))], *lookup_id]
    got = running(both, keys, order, width_bucket("_pos", scan.bucket_seconds), max_rows=scan.max_rows, nexts={"_f": (F.col("_m"), True)})
    got = got.filter("_kind = 0")
    near = F.col("_f").isNotNull() if max_gap is None else F.col("_f._at") - F.col(at) <= max_gap
    return got.select(*lookups.columns, F.when(near, F.col("_f._at")).alias("found_at"),
                      *[F.when(near, F.col(f"_f.{c}")).alias(c) for c in payload])


def last_closed(lookups: DataFrame, candles: DataFrame, at: str, width: int, max_age: int,
                payload: Sequence[str]) -> DataFrame:
    """Last *closed* candle: a pure equi-join, because the candle before the one holding ``at`` is known by arithmetic."""
    start = F.floor(F.col(at) / width) * width - width
    keyed = lookups.withColumn("_start", start.cast("bigint"))
    side = candles.select(F.col("start").alias("_start"), *payload)
    age = F.col(at) - (F.col("_start") + width)
    ok = (age >= 0) & (age <= max_age)
    out = keyed.join(side, "_start", "left")
    return out.select(*lookups.columns, *[F.when(ok, F.col(c)).alias(c) for c in payload])


def resolve_one(candidates: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The value of a key if all its candidates agree; least = greatest decides it without a distinct count."""
    low, high = F.min(value), F.max(value)
    return candidates.groupBy(*keys).agg(F.when(low == high, low).alias(name))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer comparison: matched, mismatched (with the fields that differ, NULL-safe), or present on one side."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in fields], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in fields], F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    differs = F.array_compact(F.array(*[
        F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in fields]))
    status = (F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
              .when(F.size(differs) > 0, "mismatched").otherwise("matched"))
    return both.withColumns({
        "status": status,
        "differing": F.when(status == "mismatched", F.array_join(differs, ",")),
    }).drop("_l", "_r")
