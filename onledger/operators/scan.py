"""Running values over groups of any size.

A window partitioned by a key puts the whole key into one task. That is fine for ordinary keys and wrong for a key that
holds a third of all rows. So the keys with more than ``max_rows`` rows are found first, by a count that is combined before
its shuffle and reads key columns only. If there are none, a plain window does the work. Otherwise their groups are cut
into buckets along the sort order: rows are shuffled by (key, bucket) and scanned locally, one summary row per bucket is
scanned per key, and the two are joined on (key, bucket). No task holds more than one bucket of rows or one summary row per
bucket. Which keys are cut never changes a result: NULL keys form groups of their own, rows without a bucket (a NULL sort
value) stand first, as they do in the sort order, and everything is stitched together null-safely.

Rules for callers: the bucket grows with the sort order, and sort columns ascend (negate a column to sort it downwards) and
make the order total. A scan without keys is always cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onledger.functions import amounts
from onledger.params import ScanRules
from onledger.session import materialize

BUCKET = "_bucket"
_FIRST = Window.unboundedPreceding


def width_bucket(col, width: int) -> Column:
    """Bucket number of a numeric column cut into equal widths."""
    return F.floor(F.col(col) / F.lit(width)).cast("bigint") if isinstance(col, str) else F.floor(col / F.lit(width)).cast(
        "bigint")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns that may be NULL; the key columns come from the left."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(named[f"_k_{k}"])
    return left.join(named, condition, how).drop(*[f"_k_{k}" for k in keys])


def cut(rows: DataFrame, keys: Sequence[str], bucket: Column, max_rows: int) -> tuple[DataFrame, bool]:
    """Add the bucket column; it is constant for keys of at most ``max_rows`` rows. False if no key had to be cut."""
    bucket = F.coalesce(bucket.cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    if not keys:
        return rows.withColumn(BUCKET, bucket), True
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max_rows).select(*keys)
    # at most (all rows / max_rows) keys are hot. Written down, their list is known to be small when the join is planned; otherwise
    # all rows would be shuffled by the keys alone, which Spark then takes as partitioned by (key, bucket) as well
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return rows.withColumn(BUCKET, F.lit(0).cast("bigint")), False
    marked = same_keys(rows, hot.withColumn("_hot", F.lit(True)), keys, "left")
    return marked.withColumn(BUCKET, F.when(F.col("_hot"), bucket).otherwise(F.lit(0).cast("bigint"))).drop("_hot"), True


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    max_rows: int = ScanRules().max_rows,
    sums: Mapping[str, tuple[Column, bool]] | None = None,
    lasts: Mapping[str, tuple[Column, bool]] | None = None,
    nexts: Mapping[str, tuple[Column, bool]] | None = None,
) -> DataFrame:
    """Add running columns to ``rows``.

    ``sums`` — running sum; ``lasts`` — most recent non-null value; ``nexts`` — nearest following non-null value.
    Each entry is ``name: (value, include_current_row)``. Sums take numbers and wide values.
    """
    sums, lasts, nexts = dict(sums or {}), dict(lasts or {}), dict(nexts or {})
    inputs = {**sums, **lasts, **nexts}
    base, split = cut(rows, keys, bucket, max_rows)
    base = base.withColumns({f"_in_{name}": spec[0] for name, spec in inputs.items()})
    kinds = {name: amounts.of_column(base, f"_in_{name}") for name in sums}
    parts = [*keys, BUCKET] if split else list(keys)

    ahead = Window.partitionBy(*parts).orderBy(*order)
    back = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    local = {}
    for name, (_, inclusive) in inputs.items():
        end = 0 if inclusive else -1
        src = F.col(f"_in_{name}")
        if name in sums:
            local[f"_loc_{name}"] = kinds[name].total(src, ahead.rowsBetween(_FIRST, end))
        elif name in lasts:
            local[f"_loc_{name}"] = F.last(src, ignorenulls=True).over(ahead.rowsBetween(_FIRST, end))
        else:
            local[f"_loc_{name}"] = F.last(src, ignorenulls=True).over(back.rowsBetween(_FIRST, end))
    scanned = base.withColumns(local)
    if not split:
        for name in inputs:
            loc = F.col(f"_loc_{name}")
            scanned = scanned.withColumn(name, F.coalesce(loc, kinds[name].zero()) if name in sums else loc)
        return scanned.select(*rows.columns, *inputs)

    place = F.struct(*order)
    summary = []
    for name in inputs:
        src = F.col(f"_in_{name}")
        if name in sums:
            summary.append(kinds[name].total(src).alias(f"_tot_{name}"))
        else:
            pick = F.max_by if name in lasts else F.min_by
            summary.append(pick(src, F.when(src.isNotNull(), place)).alias(f"_tot_{name}"))
    totals = base.groupBy(*parts).agg(*summary)

    up = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(_FIRST, -1)
    down = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(_FIRST, -1)
    offsets = {}
    for name in inputs:
        src = F.col(f"_tot_{name}")
        if name in sums:
            offsets[f"_off_{name}"] = kinds[name].total(src, up)
        else:
            offsets[f"_off_{name}"] = F.last(src, ignorenulls=True).over(up if name in lasts else down)
    # as above: a short list of offsets is joined without a second shuffle of all rows
    carried = materialize(totals.withColumns(offsets).select(*parts, *offsets), "offsets")

    out = same_keys(scanned, carried, parts)
    for name in inputs:
        loc, off = F.col(f"_loc_{name}"), F.col(f"_off_{name}")
        if name in sums:
            zero = kinds[name].zero()
            value = kinds[name].plus(F.coalesce(off, zero), F.coalesce(loc, zero))
        else:
            value = F.coalesce(loc, off)
        out = out.withColumn(name, value)
    return out.select(*rows.columns, *inputs)


def row_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str,
                max_rows: int = ScanRules().max_rows) -> DataFrame:
    """``row_number`` for groups of any size."""
    return running(rows, keys, order, bucket, max_rows=max_rows, sums={name: (F.lit(1).cast("bigint"), True)})


def since_marks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, amount: Column, mark: Column, name: str,
                max_rows: int = ScanRules().max_rows) -> DataFrame:
    """Running sum of ``amount``, the row included, that starts anew after every marked row, in one scan.

    Bucket summaries carry (sum, sum up to the last marked row); the sum before a bucket added, the latter carries on.
    """
    base, split = cut(rows, keys, bucket, max_rows)
    base = base.withColumns({"_in": amount, "_mark": F.coalesce(mark, F.lit(False))})
    of = amounts.of_column(base, "_in")
    zero, c = of.zero(), F.col
    parts = [*keys, BUCKET] if split else list(keys)
    ahead = Window.partitionBy(*parts).orderBy(*order)
    local = base.withColumn("_loc", F.coalesce(of.total(c("_in"), ahead.rowsBetween(_FIRST, 0)), zero))
    local = local.withColumn("_ends", F.when(c("_mark"), c("_loc")))
    scanned = local.withColumn("_end", F.last("_ends", ignorenulls=True).over(ahead.rowsBetween(_FIRST, -1)))
    if not split:
        return scanned.select(*rows.columns, of.minus(c("_loc"), F.coalesce(c("_end"), zero)).alias(name))

    totals = local.groupBy(*parts).agg(of.total(c("_in")).alias("_tot"),
                                       F.max_by("_ends", F.when(c("_mark"), F.struct(*order))).alias("_last"))
    up = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(_FIRST, -1)
    totals = totals.withColumn("_off", F.coalesce(of.total(c("_tot"), up), zero))
    totals = totals.withColumn("_off_end", F.last(of.plus(c("_off"), c("_last")), ignorenulls=True).over(up))
    out = same_keys(scanned, materialize(totals.select(*parts, "_off", "_off_end"), "offsets"), parts)
    end = F.coalesce(of.plus(c("_off"), c("_end")), c("_off_end"), zero)
    return out.select(*rows.columns, of.minus(of.plus(c("_off"), c("_loc")), end).alias(name))


def inventory(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, quantity: Column, is_buy: Column,
    max_rows: int = ScanRules().max_rows,
) -> DataFrame:
    """Running stock that falls back to zero when a sale exceeds it.

    Adds ``bought`` (units bought so far, including this row), ``held_before`` (units on hand before the row),
    ``taken`` (units a sale really consumes), ``short`` (units sold beyond the stock) and, per key, ``head_final``: the
    position, in units bought, of the oldest unit still held at the end.

    With S the running signed sum and m the lower of 0 and the least S seen before the row, stock before the row is
    S_before - m. Bucket summaries carry (sum, least prefix), which combine associatively.
    """
    base, split = cut(rows, keys, bucket, max_rows)
    base = base.withColumns({"_q": quantity, "_b": is_buy})
    of = amounts.of_column(base, "_q")
    zero = of.zero()
    base = base.withColumns({
        "_x": F.when(F.col("_b"), F.col("_q")).otherwise(of.negate(F.col("_q"))),
        "_y": F.when(F.col("_b"), F.col("_q")).otherwise(zero),
    })
    parts = [*keys, BUCKET] if split else list(keys)
    ahead = Window.partitionBy(*parts).orderBy(*order)
    local = base.withColumns({
        "_s": of.total(F.col("_x"), ahead.rowsBetween(_FIRST, 0)),
        "_bt": of.total(F.col("_y"), ahead.rowsBetween(_FIRST, 0)),
    })
    scanned = local.withColumn("_low", F.min("_s").over(ahead.rowsBetween(_FIRST, -1)))

    if not split:
        # one task has the whole group: its least prefix is a whole-group window, its sums are those of its last row
        group = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, Window.unboundedFollowing)
        out = scanned.withColumns({"_fs": F.last("_s").over(group), "_fb": F.last("_bt").over(group), "_fm": F.min("_s").over(group)})
        out = out.withColumns({"_os": zero, "_ob": zero, "_om": zero,
                               "head_final": of.minus(F.col("_fb"), of.minus(F.col("_fs"), F.least(zero, F.col("_fm"))))})
        return _stock(out, rows.columns, of)

    up = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(_FIRST, -1)
    whole = Window.partitionBy(*keys)
    totals = local.groupBy(*parts).agg(of.total(F.col("_x")).alias("_tx"), of.total(F.col("_y")).alias("_ty"), F.min("_s").alias("_tm"))
    totals = totals.withColumns({
        "_os": F.coalesce(of.total(F.col("_tx"), up), zero),
        "_ob": F.coalesce(of.total(F.col("_ty"), up), zero),
        "_fs": of.total(F.col("_tx"), whole),
        "_fb": of.total(F.col("_ty"), whole),
    })
    totals = totals.withColumn("_abs", of.plus(F.col("_os"), F.col("_tm")))
    totals = totals.withColumns({"_om": F.min("_abs").over(up), "_fm": F.min("_abs").over(whole)})
    totals = totals.withColumn("head_final", of.minus(F.col("_fb"), of.minus(F.col("_fs"), F.least(zero, F.col("_fm")))))

    out = same_keys(scanned, materialize(totals.select(*parts, "_os", "_ob", "_om", "head_final"), "offsets"), parts)
    return _stock(out, rows.columns, of)


def _stock(out: DataFrame, columns: Sequence[str], of: amounts.Plain) -> DataFrame:
    """Stock columns from local sums and what came before the bucket."""
    zero, c = of.zero(), F.col
    out = out.withColumns({"bought": of.plus(c("_ob"), c("_bt")), "_now": of.plus(c("_os"), c("_s"))})
    out = out.withColumn("_m", F.least(zero, c("_om"), of.plus(c("_os"), c("_low"))))
    out = out.withColumn("held_before", of.minus(of.minus(c("_now"), c("_x")), c("_m")))
    out = out.withColumn("taken", F.when(c("_b"), zero).otherwise(F.least("_q", "held_before")))
    out = out.withColumn("short", F.when(c("_b"), zero).otherwise(of.minus(c("_q"), c("taken"))))
    return out.select(*columns, "bought", "held_before", "taken", "short", "head_final")
