"""Structured Streaming jobs. Each runs all available input, commits its progress in a checkpoint, and can be restarted."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from onledger.operators.aggregates import earliest
from onledger.params import CLOCK_SKEW_SECONDS
from onledger.sources.sinks import VersionedTable, upsert_known


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream; the checkpoint is the cursor and moves only with a committed batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


@contextmanager
def state_partitions(spark: SparkSession):
    """A stream keeps the number of state partitions it starts with. A cluster uses the session's setting; a local session
    has no use for more partitions than cores."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_files(rows: DataFrame, root: str) -> StreamingQuery:
    """Append to a file sink until the available input is used up. The sink's own log makes every batch count once."""
    with state_partitions(rows.sparkSession):
        query = (rows.writeStream.format("parquet").option("path", f"{root}/out")
                 .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return query


def run_batches(rows: DataFrame, root: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    with state_partitions(rows.sparkSession):
        query = (rows.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return query


def output(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/out")


def confirmed_ingestion(rows: DataFrame, root: str, block: str, confirmations: int) -> None:
    """Rows become visible once ``confirmations`` blocks lie on top of them; others wait in a pending folder.

    Every batch writes to folders that carry its number, so a repeated batch overwrites itself and nothing counts twice.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = batch
        if number > 0:
            waiting = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/pending/batch={number - 1}"))
        here = waiting.agg(F.max(block).alias("head"))
        if number > 0:
            here = here.unionByName(spark.read.parquet(f"{root}/head/batch={number - 1}")).agg(F.max("head").alias("head"))
        here.write.mode("overwrite").parquet(f"{root}/head/batch={number}")
        head = spark.read.parquet(f"{root}/head/batch={number}").select("head").scalar()
        ready = F.coalesce(F.col(block) <= head - confirmations, F.lit(False))
        waiting.filter(ready).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        waiting.filter(~ready).write.mode("overwrite").parquet(f"{root}/pending/batch={number}")

    run_batches(rows, root, handle)


def dedupe_keys(rows: DataFrame, at: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Each key once; a repeat within the delay is dropped, state older than that is forgotten."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


class ReorganisationError(ValueError):
    """A stored block number now has another hash."""


def watch_headers(headers: DataFrame, root: str, stop: bool = True) -> None:
    """Compare new (number, hash) headers with the stored ones. A change is written to ``conflicts`` and, with ``stop``,
    fails the batch so that the cursor stays where it is."""
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = VersionedTable(spark, f"{root}/known")
        old = known.read_all(number + 1)
        seen = batch.select("number", "hash").distinct()
        stored = None if old is None else old.join(seen.select("number").distinct(), "number", "left_semi")
        both = seen if stored is None else seen.unionByName(stored)
        conflicts = both.groupBy("number").agg(F.countDistinct("hash").alias("hashes")).filter("hashes > 1")
        conflicts.write.mode("overwrite").parquet(f"{root}/conflicts/batch={number}")
        if stop and not spark.read.parquet(f"{root}/conflicts/batch={number}").isEmpty():
            raise ReorganisationError(f"stored block hash changed, see {root}/conflicts/batch={number}")
        fresh = seen if stored is None else seen.join(stored.select("number"), "number", "left_anti")
        known.write(earliest(fresh, ["number"], ["hash"]), number + 1)

    run_batches(headers, root, handle)


def sliding_flow(rows: DataFrame, at: str, keys: Sequence[str], amount: Column, width: str, slide: str, delay: str) -> DataFrame:
    """Net amount and row count per sliding window, emitted once the watermark closes the window."""
    return (rows.withWatermark(at, delay).groupBy(F.window(at, width, slide), *keys)
            .agg(F.sum(amount).alias("net"), F.count("*").alias("n"))
            .select(F.unix_seconds("window.start").alias("window_start"), *keys, "net", "n"))


def sliding_members(rows: DataFrame, at: str, keys: Sequence[str], member: str, width: str, slide: str, delay: str) -> DataFrame:
    """Distinct members per sliding window: members are deduplicated per window first, then counted, so no set is kept."""
    spread = rows.withWatermark(at, delay).select(F.window(at, width, slide).alias("window"), *keys, member)
    return (spread.dropDuplicates(["window", *keys, member]).groupBy("window", *keys).agg(F.count("*").alias("members"))
            .select(F.unix_seconds("window.start").alias("window_start"), *keys, "members"))


def activity(rows: DataFrame, at: str, keys: Sequence[str], is_buy: Column, amount: Column, width: str, delay: str) -> DataFrame:
    """Tumbling activity buckets; a bucket appears only after it has closed."""
    zero = F.lit(0).cast("bigint")
    return (rows.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(
        F.count("*").alias("n"), F.count_if(is_buy).alias("buys"), F.sum(F.when(is_buy, amount).otherwise(zero)).alias("bought"),
        F.sum(F.when(is_buy, zero).otherwise(amount)).alias("sold"))
        .select(F.unix_seconds("window.start").alias("bucket_start"), *keys, "n", "buys", "bought", "sold"))


def match_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, bound: str, delay: str) -> DataFrame:
    """Left rows with the right rows that follow within the bound; rows without one come out once that is certain."""
    a = left.withWatermark(left_at, delay).alias("a")
    b = right.withWatermark(right_at, delay).withColumnRenamed(key, f"_r_{key}").alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b._r_{key}")) & (F.col(f"b.{right_at}") >= F.col(f"a.{left_at}")) & (
        F.col(f"b.{right_at}") <= F.col(f"a.{left_at}") + F.expr(f"INTERVAL {bound}"))
    return a.join(b, on, "leftOuter").drop(f"_r_{key}")


def label_lateness(rows: DataFrame, at: Column, seen: Column, now: Column, deadline: int) -> DataFrame:
    """Late and future-dated rows get a label before any watermark could drop them."""
    label = (F.when(at.isNull() | (at - now > CLOCK_SKEW_SECONDS), "invalid_future_time")
             .when(seen - at > deadline, "observed_after_entry_deadline").otherwise("accepted"))
    return rows.withColumn("label", label)


def split_labels(rows: DataFrame, root: str) -> None:
    """Accepted rows to ``out``, all others to ``rejected``; nothing disappears."""
    def handle(batch: DataFrame, number: int) -> None:
        ok = F.col("label") == "accepted"
        batch.filter(ok).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        batch.filter(~ok).write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")

    run_batches(rows, root, handle)


def freshness_gauge(rows: DataFrame, root: str, at: str, block: str) -> None:
    """Newest event time and block seen so far, one small row rewritten per batch."""
    gauge = rows.agg(F.max(at).alias("indexed_through"), F.max(block).alias("head"), F.count("*").alias("rows"))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/gauge/batch={number}")

    run_batches(gauge, root, handle, mode="complete")


def newest_gauge(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/gauge").orderBy(F.desc("batch")).limit(1).drop("batch")


class IdentityConflict(ValueError):
    """A batch contradicts what is stored."""


def normalise_incrementally(rows: DataFrame, root: str, keys: Sequence[str], identity: Sequence[str], columns: Sequence[str],
                            seq: str) -> None:
    """Add batches to a table of observations. A key with two identities fails its batch before anything is written.

    A batch writes its own rows only, and of what is stored only the keys it touches are compared; ``known_values`` merges
    on reading.
    """
    def handle(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, f"{root}/table")
        old = table.read_all(number + 1)
        mine = batch.select(*keys, *identity, *columns, seq)
        facts = mine.select(*keys, *identity)
        if old is not None:
            touched = mine.select(*keys).distinct()
            facts = facts.unionByName(old.select(*keys, *identity).join(touched, list(keys), "left_semi"))
        bad = facts.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in identity]).filter(
            " OR ".join(f"{c} > 1" for c in identity))
        if not bad.isEmpty():
            raise IdentityConflict(f"batch {number} contradicts stored rows; nothing of it was written")
        table.write(mine, number + 1)

    run_batches(rows, root, handle)


def known_values(spark: SparkSession, root: str, keys: Sequence[str], columns: Sequence[str], seq: str) -> DataFrame:
    """Current state of an incrementally normalised table: the earliest known value of every column."""
    return upsert_known(VersionedTable(spark, f"{root}/table").read_all(), keys, columns, seq)
