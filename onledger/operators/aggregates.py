"""Grouped summaries that stay bounded per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onledger.functions import amounts

# --- fixed values: half-width of the rank band kept for the exact median, and the sketch accuracy that guarantees it ---
MEDIAN_BAND = 0.001
SKETCH_ACCURACY = 10_000


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key for groups of any size.

    A mergeable quantile sketch (rank error below n/10000) gives two values that surely enclose the middle ranks. Values
    below are only counted; the few values between are grouped and ranked. Equal values collapse into one row first.
    """
    base = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = base.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(F.lit(0.5 - MEDIAN_BAND), F.lit(0.5 + MEDIAN_BAND)),
                            F.lit(SKETCH_ACCURACY)).alias("_q"),
        F.count("*").alias("_n"))
    counted = base.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).join(sketch, list(keys))
    low, high = F.col("_q")[0], F.col("_q")[1]
    # everything below the band becomes one row, so the window sees the band only
    band = (counted.filter(F.col("_v") <= high)
            .withColumn("_v", F.when(F.col("_v") >= low, F.col("_v")))
            .groupBy(*keys, "_v", "_n").agg(F.sum("_c").alias("_c")))
    w = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = band.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)

    def pick(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") < rank) & (rank <= F.col("_hi")), F.col("_v")))

    return ranked.groupBy(*keys).agg(((pick(first) + pick(second)) / 2).alias(name))


def top_share(rows: DataFrame, keys: Sequence[str], value: str, holder: str, n: int, name: str) -> DataFrame:
    """Share of the total held by the ``n`` largest holders. The rank filter is applied before the shuffle too."""
    of = amounts.of_column(rows, value)
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(holder))
    top = (rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
           .groupBy(*keys).agg(of.total(F.col(value)).alias("_top")))
    total = rows.groupBy(*keys).agg(of.total(F.col(value)).alias("_all"), F.count("*").alias("holders"))
    return total.join(top, list(keys)).withColumn(
        name, F.when(F.col("_all") != of.zero(), of.double(F.col("_top")) / of.double(F.col("_all"))))


def null_profile(rows: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """NULL counts of many columns in one pass, unpivoted to one row per column."""
    one = rows.agg(F.count("*").alias("denominator"),
                   *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot("denominator", list(columns), "column_name", "nulls").withColumn("table_name", F.lit(table))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; only one candidate per key and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def earliest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
