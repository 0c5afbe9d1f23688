"""Data-quality reports over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def time_ranges(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """First and last event time of each table, as seconds and as UTC text."""
    return union_all([
        rows.agg(F.min(col).alias("min_ts"), F.max(col).alias("max_ts")).select(
            F.lit(name).alias("table_name"), "min_ts", "max_ts",
            F.date_format(F.timestamp_seconds("min_ts"), ISO).alias("min_utc"),
            F.date_format(F.timestamp_seconds("max_ts"), ISO).alias("max_utc"))
        for name, rows, col in tables])


def block_histogram(events: DataFrame, width: int, span: int) -> DataFrame:
    """Counts per ``width`` blocks over the last ``span`` blocks, empty bins included, last bin clipped.

    Counting per block comes first (one row per block, partial sums before the shuffle); the bin list hangs off one row.
    """
    per_block = events.groupBy("block").agg(F.count("*").alias("n"))
    end = per_block.agg(F.max("block").alias("finish")).withColumn(
        "begin", F.greatest(F.lit(0), F.col("finish") - (span - 1)))
    bins = end.select("begin", "finish", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("finish") - F.col("begin")) / width))).alias("i"))
    bins = bins.withColumns({
        "block_from": F.col("begin") + F.col("i") * width,
        "block_to": F.least(F.col("finish"), F.col("begin") + (F.col("i") + 1) * width - 1)})
    # each bin lists its own blocks, so counts attach by equality
    listed = bins.select("block_from", "block_to", F.explode(F.sequence("block_from", "block_to")).alias("block"))
    return listed.join(per_block, "block", "left").groupBy("block_from", "block_to").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def entity_counters(swaps: DataFrame, txs: DataFrame, cursor: int) -> DataFrame:
    """Rows and distinct entities, each with the part a consumer at ``cursor`` has not reached yet."""
    late = F.col("block") > cursor

    def distinct(col: str, label: str) -> DataFrame:
        per = swaps.groupBy(col).agg(F.max("block").alias("block"))
        return per.agg(F.count("*").alias("n"), F.count_if(late).alias("pending")).withColumn("entity", F.lit(label))

    def plain(rows: DataFrame, label: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n"), F.count_if(late).alias("pending")).withColumn("entity", F.lit(label))

    return union_all([plain(swaps, "swaps"), distinct("wallet", "wallets"), distinct("pool", "pools"),
                      plain(txs, "transactions")]).select("entity", "n", "pending")


def report(statuses, nulls: Sequence[DataFrame], ranges: DataFrame, orphans: DataFrame, tables) -> DataFrame:
    """One long table (section, name, value) of status counts, NULL counts, time windows, orphans and row counts."""
    c = F.col
    long = lambda rows, section, name, value: rows.select(
        F.lit(section).alias("section"), name.alias("name"), value.cast("bigint").alias("value"))
    parts = [long(rows.groupBy(col).agg(F.count("*").alias("n")), "status", F.concat(F.lit(f"{name}."), c(col)), c("n"))
             for name, rows, col in statuses]
    parts += [long(p, "nulls", F.concat_ws(".", "table_name", "column_name"), c("nulls")) for p in nulls]
    parts += [long(ranges, "first", c("table_name"), c("min_ts")), long(ranges, "last", c("table_name"), c("max_ts")),
              long(orphans, "orphans", c("relation"), c("orphan_rows"))]
    parts += [long(rows.agg(F.count("*").alias("n")), "rows", F.lit(name), c("n")) for name, rows in tables]
    return union_all(parts)
