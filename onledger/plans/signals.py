"""Trade-flow summaries and buying signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions import amounts, bigint

MINT = "0x0"


def activity(swaps: DataFrame, width: int) -> DataFrame:
    """Per (pool, token) and closed time bucket; buckets without swaps do not appear."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    start = (F.floor(F.col("ts") / width) * width).cast("bigint")
    return swaps.groupBy("pool", "token", start.alias("bucket_start")).agg(
        F.count("*").alias("swaps"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"),
        F.sum(F.when(buy, F.col("quote_amount")).otherwise(0)).alias("buy_quote"),
        F.sum(F.when(sell, F.col("quote_amount")).otherwise(0)).alias("sell_quote"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _two_sides(transfers: DataFrame, keep: Sequence[str], plus: Column, minus: Column, name: str) -> DataFrame:
    """Each transfer as two signed rows, made without reading the table twice."""
    sides = F.array(F.struct(F.col("recipient").alias("wallet"), plus.alias(name)),
                    F.struct(F.col("sender").alias("wallet"), minus.alias(name)))
    return transfers.select(*keep, F.inline(sides)).filter(F.col("wallet") != MINT)


def net_deltas(transfers: DataFrame, keys: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Net amount per key and wallet, of numbers or wide values; the mint address is not a wallet.

    Where keys hardly repeat, adding up before the shuffle only fills the memory of a task. With ``pieces`` the moves are dealt by
    key into that many pieces first; let it grow with the input, and a task's memory does not.
    """
    of = amounts.of_column(transfers, "amount")
    moves = _two_sides(transfers, keys, F.col("amount"), of.negate(F.col("amount")), "amount")
    if pieces:
        moves = moves.repartition(pieces, *keys, "wallet")
    return moves.groupBy(*keys, "wallet").agg(of.total(F.col("amount")).alias("delta"))


def signed_word_balances(transfers: DataFrame) -> DataFrame:
    """Exact balances per (token, holder) of 32-byte amounts: limb sums in, minus limb sums out."""
    limbs = bigint.from_hex(F.col("word"))
    minus = F.transform(limbs, lambda x: -x)
    moves = _two_sides(transfers, ["token"], limbs, minus, "limbs").withColumnRenamed("wallet", "holder")
    sums = moves.groupBy("token", "holder").agg(*bigint.limb_sums(F.col("limbs"), "s"))
    return sums.select("token", "holder", bigint.settle(bigint.gather("s")).alias("total"))


def coverage(swaps: DataFrame) -> DataFrame:
    """Observed, reviewed, pending, ambiguous transactions per token; a share of nothing is undefined, not zero.

    One row per (token, tx) comes first, so no distinct count is needed afterwards.
    """
    per_tx = swaps.groupBy("token", "tx").agg(
        F.max("review").alias("review"), F.max(F.when(F.col("side") == "sell", 1)).alias("sold"))
    reviewed, sold = F.col("review").isNotNull(), F.col("sold").isNotNull()
    out = per_tx.groupBy("token").agg(
        F.count("*").alias("observed"), F.count_if(reviewed).alias("reviewed"),
        F.count_if(F.col("review") == "ambiguous").alias("ambiguous"),
        F.count_if(reviewed & sold).alias("_rs"), F.count_if(sold).alias("_s"))
    return out.select("token", "observed", "reviewed", (F.col("observed") - F.col("reviewed")).alias("pending"),
                      "ambiguous", F.try_divide("_rs", "_s").alias("sell_coverage"))


def basic_reasons(assessments: DataFrame) -> DataFrame:
    """The four evidence gaps a report counts most often."""
    found = F.array(
        F.when(F.col("liquidity").isNull(), "liquidity_unknown").when(F.col("liquidity") < 25000, "liquidity_low"),
        F.when(F.col("top10_share").isNull(), "holders_unknown").when(F.col("top10_share") > 0.5, "holders_concentrated"),
        F.when(~F.col("deployment_confirmed"), "deployment_unconfirmed"),
        F.when(F.col("observed_at").isNull() | (F.col("ts") - F.col("observed_at") > 120), "quote_stale"),
    )
    return assessments.withColumn("reasons", F.array_compact(found))


def reason_frequency(rows: DataFrame, top: int | None = None) -> DataFrame:
    """How many assessments and how many distinct tokens each reason stopped."""
    out = rows.select("token", F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count("*").alias("assessments"), F.countDistinct("token").alias("tokens"))
    return out if top is None else out.orderBy(F.desc("assessments"), "reason").limit(top)


def spend(calls: DataFrame, at: str, reserved: str, cost: str) -> DataFrame:
    """Reserved and actual spend by UTC day and month; unknown costs are counted, not taken as zero."""
    when = F.timestamp_seconds(at)
    return calls.groupBy(F.date_format(when, "yyyy-MM-dd").alias("day"), F.date_format(when, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("calls"), F.sum(reserved).alias("reserved_cents"),
        F.coalesce(F.sum(cost), F.lit(0)).alias("actual_cents"),
        F.count_if(F.col(cost).isNull()).alias("unknown_cost_calls"))
