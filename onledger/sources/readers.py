"""Readers: explicit schemas, validity filters, nothing silently lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onledger.functions import decode as d
from onledger.functions.guards import finite
from onledger.functions.pin import pinned

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW_LOG = struct(address=S, topics=T.ArrayType(S), data=S, transactionHash=S, blockHash=S, blockNumber=S, logIndex=S,
                 transactionIndex=S, blockTimestamp=S, removed=B)
RECEIPT = T.StructType([
    *struct(transactionHash=S, blockHash=S, blockNumber=S, status=S).fields, T.StructField("from", S),
    T.StructField("to", S), *struct(gasUsed=S, effectiveGasPrice=S, logs=T.ArrayType(RAW_LOG)).fields])
SNAPSHOT = struct(token=S, symbol=S, chain=S, price=D, liquidity=D, volume_h24=D, age_seconds=D, top10_share=D,
                  observed_at=D, standard_token=B, mint_authority=S, freeze_authority=S, buys_m5=D, sells_m5=D,
                  change_m5=D)
BATCH = struct(ts=D, snapshots=T.ArrayType(SNAPSHOT))
HISTORY_TX = T.StructType([
    *struct(hash=S, blockNumber=S, blockHash=S).fields, T.StructField("from", S), T.StructField("to", S),
    *struct(gasUsed=S, gasPrice=S, isError=S, txreceipt_status=S).fields])
HISTORY = struct(wallet=S, start_block=L, end_block=L, transactions=T.ArrayType(HISTORY_TX))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines batches, one row per snapshot. Blank lines vanish; batches without a finite time are rejected."""
    rows = spark.read.schema(BATCH).json(path)
    return explode_batches(rows.filter(finite(F.col("ts")).isNotNull()))


def explode_batches(batches: DataFrame) -> DataFrame:
    return batches.select("ts", F.explode("snapshots").alias("s")).select("ts", "s.*")


def after_watermark(rows: DataFrame, watermark: Column) -> DataFrame:
    """Batches newer than the watermark; empty or repeated tokens of a batch are flagged, not dropped."""
    fresh = rows.filter(F.coalesce(F.col("ts") > watermark, F.lit(True)))
    token = F.coalesce("token", F.lit(""))
    counts = fresh.groupBy(F.col("ts").alias("_ts"), token.alias("_token")).agg((F.count("*") > 1).alias("repeated"))
    keyed = fresh.withColumns({"_ts": F.col("ts"), "_token": token})
    return keyed.join(counts, ["_ts", "_token"]).withColumn("empty_token", F.col("_token") == "").drop("_ts", "_token")


def parse_logs(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed columns of raw log JSON, the JSON kept beside them. A time of zero is a missing time."""
    out = pinned(rows, "log", F.from_json(raw, RAW_LOG))
    stamp = d.quantity(F.col("log.blockTimestamp"))
    return out.withColumns({
        "tx_hash": F.lower("log.transactionHash"), "block_hash": F.lower("log.blockHash"),
        "block_number": d.quantity(F.col("log.blockNumber")), "log_number": d.quantity(F.col("log.logIndex")),
        "tx_index": d.quantity(F.col("log.transactionIndex")), "emitter": F.lower("log.address"),
        "log_topics": F.col("log.topics"), "log_data": F.col("log.data"),
        "log_ts": F.when(stamp > 0, stamp), "removed": F.coalesce("log.removed", F.lit(False)),
        "words": d.words(F.col("log.data")),
    }).drop("log")


def parse_receipts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    r = pinned(rows, "r", F.from_json(raw, RECEIPT))
    gas, price = d.quantity(F.col("r.gasUsed")), d.quantity(F.col("r.effectiveGasPrice"))
    return r.withColumns({
        "tx_hash": F.lower("r.transactionHash"), "block_hash": F.lower("r.blockHash"),
        "block_number": d.quantity(F.col("r.blockNumber")), "ok": d.quantity(F.col("r.status")) == 1,
        "origin_address": F.lower("r.from"), "to_address": F.lower("r.to"), "gas_used": gas, "gas_price": price,
        "fee": gas.cast("decimal(20,0)") * price.cast("decimal(20,0)"), "logs": F.col("r.logs"),
    }).drop("r")


def parse_candles(rows: DataFrame, column: str = "candle", width: int = 60, bucket: str | None = None, bucket_width: int = 3600) -> DataFrame:
    """``[start, low, high, open, close, volume]`` arrays: aligned to the width, with a finite positive close.

    ``bucket`` names the start of the interval a row was asked for; candles outside it are dropped, an unknown one drops all.
    """
    at = lambda i: F.try_element_at(F.col(column), F.lit(i))
    start, close = at(1).cast("bigint"), finite(at(5))
    out = rows.withColumns({"start": start, "low": at(2), "high": at(3), "open": at(4), "close": close, "volume": at(6)})
    out = out.filter((F.size(column) >= 5) & (F.col("start") % width == 0) & (F.col("close") > 0))
    if bucket:
        out = out.filter((F.col("start") >= F.col(bucket)) & (F.col("start") < F.col(bucket) + bucket_width))
    return out.withColumn("available_at", F.col("start") + width)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved explorer history: files that each hold one JSON array of wallet documents."""
    return spark.read.schema(HISTORY).option("multiLine", True).json(path)


def history_for_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs (wallet, start_block, end_block) with the transactions of the document saved for exactly that wallet and interval.

    Of several such documents the one with the most transactions counts. Without one the job is unavailable, whatever other
    intervals of the wallet are saved.
    """
    keys = ["wallet", "start_block", "end_block"]
    saved = documents.withColumn("wallet", F.lower("wallet")).groupBy(*keys).agg(F.max_by("transactions", F.size("transactions")).alias("transactions"))
    out = jobs.withColumn("wallet", F.lower("wallet")).join(saved, keys, "left")
    found = F.col("transactions").isNotNull()
    return out.withColumns({"status": F.when(found, "matched").otherwise("unavailable"),
                            "reason": F.when(~found, "saved history does not match wallet and interval")})


def explode_history(documents: DataFrame) -> DataFrame:
    """Saved explorer history: one row per transaction with the violations of its own bounds."""
    rows = documents.select("wallet", "start_block", "end_block", F.explode("transactions").alias("t")).select(
        F.lower("wallet").alias("wallet"), "start_block", "end_block", F.lower("t.hash").alias("hash"),
        F.col("t.blockNumber").try_cast("bigint").alias("block"), F.lower("t.from").alias("sender"),
        F.lower("t.to").alias("recipient"), F.col("t.gasUsed").try_cast("bigint").alias("gas_used"),
        F.col("t.gasPrice").try_cast("bigint").alias("gas_price"), (F.col("t.isError") == "1").alias("failed"),
        F.lower("t.blockHash").alias("block_hash"), F.col("t.txreceipt_status").try_cast("int").alias("status"))
    counts = rows.groupBy("wallet", "hash").agg(F.count("*").alias("copies"))
    inside = F.col("block").between(F.col("start_block"), F.col("end_block"))
    related = (F.col("wallet") == F.col("sender")) | (F.col("wallet") == F.col("recipient"))
    return rows.join(counts, ["wallet", "hash"]).withColumn("violations", F.array_compact(F.array(
        F.when(F.col("copies") > 1, "duplicate_transaction"),
        F.when(~F.coalesce(inside, F.lit(False)), "outside_interval"),
        F.when(~F.coalesce(related, F.lit(False)), "unrelated_transaction"))))
