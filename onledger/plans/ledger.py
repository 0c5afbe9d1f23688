"""Normalised chain tables and their identity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions.decode import event_kind
from onledger.plans.quality import union_all



def accepted_logs(logs: DataFrame) -> DataFrame:
    """Logs whose JSON agrees with the indexed row they came with (tx, block, hash) and that were not removed."""
    return logs.withColumn("identity_ok", F.coalesce(
        (F.col("tx_hash") == F.col("indexed_tx")) & (F.col("block_hash") == F.col("indexed_hash"))
        & (F.col("block_number") == F.col("indexed_block")) & ~F.col("removed"), F.lit(False)))


def blocks(logs: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per block hash. A known value is never overwritten by an unknown one; a header improves the source label."""
    seen = logs.select("block_hash", F.col("block_number").alias("number"), F.lit(None).cast("string").alias("parent_hash"),
                       F.col("log_ts").alias("ts"))
    if headers is not None:
        seen = seen.unionByName(headers.select("block_hash", "number", "parent_hash", "ts"))
    return seen.groupBy("block_hash").agg(
        F.min("number").alias("number"), F.min("parent_hash").alias("parent_hash"), F.min("ts").alias("ts"),
    ).withColumn("source", F.when(F.col("parent_hash").isNotNull(), "rpc_header").otherwise("rpc_log_or_observation"))


def transactions(logs: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """One row per transaction; receipt columns stay NULL until a receipt was seen."""
    out = logs.groupBy("tx_hash").agg(F.min("block_hash").alias("block_hash"), F.min("tx_index").alias("tx_index"))
    if receipts is None:
        return out
    r = receipts.select("tx_hash", F.col("origin_address").alias("sender"), F.col("to_address").alias("recipient"),
                        F.col("ok").alias("succeeded"), "gas_used", "gas_price", "fee", F.lit(True).alias("_has"))
    return out.join(r, "tx_hash", "left").withColumn("receipt_available", F.coalesce("_has", F.lit(False))).drop("_has")


def accounts(logs: DataFrame, receipts: DataFrame | None = None, contracts: DataFrame | None = None) -> DataFrame:
    """Every address seen. Whether it is a contract stays NULL (unclassified) until its code was observed."""
    found = logs.select(F.lower("emitter").alias("address"))
    if receipts is not None:
        found = found.unionByName(receipts.select(F.explode(F.array("origin_address", "to_address")).alias("address")))
    out = found.filter("address IS NOT NULL").distinct()
    if contracts is None:
        return out.withColumn("is_contract", F.lit(None).cast("boolean"))
    flags = contracts.select("address", F.lit(True).alias("is_contract"))
    return out.join(flags, "address", "left")


def log_rows(logs: DataFrame, raw: str = "raw") -> DataFrame:
    return logs.select("tx_hash", "log_number", "emitter", event_kind(F.col("log_topics")).alias("kind"),
                       F.sha2(raw, 256).alias("digest"))


def identity_conflicts(checks: Sequence[tuple[str, DataFrame, Sequence[str], Column]]) -> DataFrame:
    """Keys that stand for more than one thing. Each check is (name, rows, key columns, value that must be unique)."""
    parts = []
    for name, rows, keys, value in checks:
        found = rows.withColumn("_v", value).groupBy(*keys).agg(F.countDistinct("_v").alias("variants")).filter("variants > 1")
        parts.append(found.select(F.lit(name).alias("conflict"),
                                  F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"), "variants"))
    return union_all(parts)


def orphans(relations: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Foreign keys without a parent, reported per relation and never repaired. NULL keys are not orphans."""
    parts = []
    for name, (child, fk, parent, pk) in relations.items():
        lost = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count("*").alias("_n")).join(
            parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
        parts.append(lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys")).select(
            F.lit(name).alias("relation"), "orphan_rows", "orphan_keys"))
    return union_all(parts)
