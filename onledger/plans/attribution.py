"""Who traded: call frames, net flows per transaction, attribution and its backlog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions import amounts
from onledger.functions.pin import pinned
from onledger.operators.rules import failed
from onledger.operators.scan import row_numbers, width_bucket
from onledger.params import ScanRules
from onledger.plans.signals import net_deltas
from onledger.session import materialize


# --- fixed values: frame kinds that move native value, and kinds that deploy ------------------------------------------
VALUE_FRAMES = ("CALL", "CREATE", "CREATE2", "SELFDESTRUCT")
DEPLOY_FRAMES = ("CREATE", "CREATE2")
# --- fixed value: what is read of a frame; fields of another kind are NULL ------------------------------------------------
FRAME = "struct<`type`: string, `from`: string, `to`: string, value: string, error: string, calls: array<variant>>"

# --- fixed values: reasons an attribution is not unique ---------------------------------------------------------------
REVERTED = "Transaction reverted"
ORIGIN_MISMATCH = "Trace origin mismatch"
MIXED_LIQUIDITY = "Mixed liquidity and swap transaction"
NOT_ISOLATED = "Cannot isolate one holder with opposing token and ETH/WETH flows"
NOT_INDEXED = "Wallet asset not in indexed swap pools"


def flatten_frames(traces: DataFrame, key: str = "tx", column: str = "trace", value: Column | None = None) -> DataFrame:
    """Live call frames of JSON call trees, one row per frame.

    One pass per level: an errored frame is dropped before its children are read, so its whole subtree goes with it, and
    a tree with an errored root yields nothing. A tree is parsed once; every level is written out with its children as parsed
    values, which keeps the plan flat however deep the trees are.
    """
    def unpack(rows: DataFrame, node: Column) -> DataFrame:
        f = F.col("_f")
        return pinned(rows.withColumn("_node", node), "_f", F.try_variant_get(F.col("_node"), "$", FRAME)).select(
            key, "path", F.coalesce("root_sender", F.lower(f["from"])).alias("root_sender"), F.upper(f["type"]).alias("kind"),
            F.lower(f["from"]).alias("sender"), F.lower(f["to"]).alias("recipient"), f["value"].alias("value"),
            f["error"].alias("error"), f["calls"].alias("calls"),
        ).filter(F.coalesce("error", F.lit("")) == "")

    level = unpack(traces.select(key, F.lit("0").alias("path"), F.lit(None).cast("string").alias("root_sender"), column),
                   F.try_parse_json(column))
    levels = []
    while True:
        level = materialize(level, "frames")
        if level.isEmpty():
            break
        levels.append(level)
        children = level.filter("calls IS NOT NULL").select(key, "path", "root_sender", F.posexplode("calls").alias("_i", "_node"))
        level = unpack(children.withColumn("path", F.concat_ws(".", "path", F.col("_i").cast("string"))), F.col("_node"))
    out = levels[0] if levels else level
    for other in levels[1:]:
        out = out.unionByName(other)
    return out.drop("calls", "error")


def native_deltas(frames: DataFrame, amount: Column, key: str = "tx", narrow: Column | None = None) -> DataFrame:
    """Native value in minus value out per (transaction, wallet).

    A frame without a value moves nothing. A malformed value makes the wallet's delta NULL, never smaller.

    ``narrow`` reads the same amounts as DECIMAL(28,0), NULL where it cannot. Transactions it reads in full are added up as decimals,
    the others, usually none, as ``amount``. If there are none, deltas are DECIMAL(38,0).
    """
    rows = frames.filter(F.col("kind").isin(*VALUE_FRAMES))
    if narrow is None:
        return _deltas(rows, amount, key)
    rows = rows.withColumn("_n", narrow)
    # frames may be written tables, which are read again; the list shows whether there are such transactions at all
    odd = materialize(rows.filter("value IS NOT NULL AND _n IS NULL").select(F.col(key).alias("_key")).distinct(), "wide-transactions")
    if odd.isEmpty():
        return _deltas(rows, F.col("_n").cast(amounts.NARROW), key)
    same = F.col(key).eqNullSafe(F.col("_key"))
    plain = _deltas(rows.join(odd, same, "left_anti"), F.col("_n").cast(amounts.NARROW), key)
    return amounts.exact(plain, ("delta",), ()).unionByName(_deltas(rows.join(odd, same, "left_semi"), amount, key))


def _deltas(rows: DataFrame, amount: Column, key: str) -> DataFrame:
    rows = rows.withColumn("_v", amount)
    of = amounts.of_column(rows, "_v")
    rows = rows.withColumn("_v", F.when(F.col("value").isNull(), of.zero()).otherwise(F.col("_v")))
    sides = F.array(F.struct(F.col("sender").alias("wallet"), of.negate(F.col("_v")).alias("delta")),
                    F.struct(F.col("recipient").alias("wallet"), F.col("_v").alias("delta")))
    return (rows.select(key, F.inline(sides)).filter("wallet IS NOT NULL").groupBy(key, "wallet")
            .agg(F.when(F.count("delta") == F.count("*"), of.total(F.col("delta"))).alias("delta")))


def deployment_origins(frames: DataFrame, key: str = "tx") -> DataFrame:
    """Deployer (who issued the creating frame) and initiator (who sent the transaction) of every created contract."""
    made = frames.filter(F.col("kind").isin(*DEPLOY_FRAMES))
    return made.groupBy(key, F.col("recipient").alias("token")).agg(
        F.min_by(F.struct(F.col("sender").alias("deployer"), F.col("root_sender").alias("initiator")), F.split("path", r"\.").cast("array<int>")).alias("o")
    ).select(key, "token", "o.deployer", "o.initiator")


def attribute_flows(receipts: DataFrame, moves: DataFrame, native: DataFrame, emitters: DataFrame, excluded: DataFrame,
                    wrapped: str) -> DataFrame:
    """One wallet per transaction, or the reason there is none.

    receipts: tx, ok, origin, to_address, trace_origin, mixed. moves: tx, token, sender, recipient, amount.
    native: tx, wallet, delta. emitters: tx, wallet (pools that logged a swap there). excluded: wallet (routers and such).
    A candidate has exactly one token flow and an opposite native-plus-wrapped flow; the origin wins over the recipient.
    """
    checked = receipts.withColumn("failure", (
        F.when(~F.coalesce("ok", F.lit(False)), REVERTED)
        .when(~F.coalesce(F.col("trace_origin") == F.col("origin"), F.lit(False)), ORIGIN_MISMATCH)
        .when(F.col("mixed"), MIXED_LIQUIDITY)))
    who = checked.filter("failure IS NULL").select(
        "tx", "origin", F.explode(F.array_distinct(F.array_compact(F.array("origin", "to_address")))).alias("wallet"))
    who = who.join(excluded.select("wallet"), "wallet", "left_anti").join(
        emitters.select("tx", "wallet"), ["tx", "wallet"], "left_anti")
    net = net_deltas(moves, ["tx", "token"]).withColumnRenamed("delta", "amount")
    parts = net.unionByName(native.select("tx", F.lit(None).cast("string").alias("token"), "wallet",
                                          F.col("delta").alias("amount")))
    is_quote = F.col("token").isNull() | (F.col("token") == wrapped)
    live = ~is_quote & (F.col("amount") != 0)
    legs = who.join(parts, ["tx", "wallet"]).groupBy("tx", "wallet", "origin").agg(
        F.sum(F.when(is_quote, F.col("amount")).otherwise(0)).alias("quote"), F.count_if(live).alias("tokens"),
        F.max(F.when(live, F.col("token"))).alias("token"), F.sum(F.when(live, F.col("amount"))).alias("quantity"))
    matches = legs.filter("tokens = 1 AND sign(quantity) * sign(quote) < 0")
    first = F.col("wallet") == F.col("origin")
    leg = F.struct("wallet", "token", "quantity", "quote")
    best = matches.groupBy("tx").agg(F.max(F.when(first, leg)).alias("own"), F.count("*").alias("n"), F.max(leg).alias("other"))
    best = best.select("tx", F.coalesce("own", F.when(F.col("n") == 1, F.col("other"))).alias("m"))
    out = checked.select("tx", "failure").join(best, "tx", "left")
    reason = F.coalesce("failure", F.when(F.col("m").isNull(), NOT_ISOLATED))
    return out.withColumn("reason", reason).select(
        "tx", F.when(F.col("reason").isNull(), "complete").otherwise("ambiguous").alias("status"), "reason", "m.wallet",
        "m.token", "m.quantity", "m.quote", F.when(F.col("m.quantity") > 0, "buy").when(F.col("m.quantity") < 0, "sell"
                                                                                       ).alias("side"))


def attribution_status(flows: DataFrame, indexed: DataFrame) -> DataFrame:
    """An attribution counts only if its asset was swapped in an indexed pool of the same transaction."""
    known = indexed.select("tx", "token").distinct().withColumn("_known", F.lit(True))
    joined = flows.join(known, ["tx", "token"], "left")
    lost = (F.col("status") == "complete") & F.col("_known").isNull()
    keep = lambda c: F.when(~lost, F.col(c)).alias(c)
    return joined.select(
        "tx", F.when(lost, "ambiguous").otherwise(F.col("status")).alias("status"),
        F.when(lost, NOT_INDEXED).otherwise(F.col("reason")).alias("reason"), keep("wallet"), keep("token"),
        keep("quantity"), keep("quote"), keep("side"))


def capture_live_flows(observations: DataFrame, attributions: DataFrame, captured: DataFrame, now: Column,
                       window: int) -> DataFrame:
    """Verified recent attributions that are not captured yet, stamped with the time they became known."""
    recent = observations.filter((F.col("status") == "complete") & (F.col("ts") >= now - window))
    fresh = recent.join(captured.select("tx"), "tx", "left_anti").select("tx", "ts", "wallet", "token")
    agreed = attributions.filter("status = 'complete'").select(
        "tx", F.col("wallet").alias("_w"), F.col("token").alias("_t"), "side", "quote")
    return fresh.join(agreed, "tx").filter("wallet = _w AND token = _t").select(
        "tx", "wallet", "token", "ts", now.alias("seen_at"), "side", F.abs("quote").alias("quote"))


def recent_buyers(swaps: DataFrame, reviews: DataFrame, anchors: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(verified buyers, coverage) per token up to its anchor.

    swaps: tx, token, ts, block, wallet, side, attributed. reviews: tx, status, wallet, side. anchors: token, at, height —
    one row per token, so a swap meets at most one of them.
    """
    near = swaps.join(anchors, "token").filter(
        (F.col("ts") >= F.col("at") - window) & (F.col("ts") <= F.col("at")) & (F.col("block") <= F.col("height")))
    judged = near.join(reviews.select("tx", F.col("status").alias("review"), F.col("wallet").alias("reviewer_wallet"),
                                      F.col("side").alias("reviewed_side")), "tx", "left")
    verified = F.when((F.col("review") == "complete") & (F.col("reviewed_side") == "buy"), F.col("reviewer_wallet"))
    direct = F.when(F.col("attributed") & (F.col("side") == "buy"), F.col("wallet"))
    buyers = judged.select("token", F.explode(F.array_compact(F.array(verified, direct))).alias("buyer")).distinct()
    per_tx = judged.groupBy("token", "tx").agg(F.max("review").alias("review"))
    counts = per_tx.groupBy("token").agg(
        F.count("*").alias("transactions"), F.count("review").alias("reviewed"),
        F.count_if(F.col("review") == "ambiguous").alias("ambiguous")).withColumn(
        "pending", F.col("transactions") - F.col("reviewed"))
    return buyers, counts


def backlog(swaps: DataFrame, reviewed: DataFrame, observed_buyers: DataFrame, assessed: DataFrame, now: Column,
            window: int, limit: int, scan: ScanRules = ScanRules()) -> DataFrame:
    """Transactions to review next: tokens with fewer than two verified buyers first, then buys, then newest."""
    recent = swaps.filter((F.col("ts") >= now - window) & (F.col("ts") <= now)).join(
        reviewed.select("tx"), "tx", "left_anti")
    per_tx = recent.groupBy("tx").agg(
        F.min("ts").alias("ts"), F.min("block").alias("block"), F.min("token").alias("token"),
        F.min(F.when(F.col("side") == "buy", 0).otherwise(1)).alias("sell")).withColumn("newest", -F.col("ts"))
    bucket = width_bucket("newest", scan.bucket_seconds) + F.col("sell") * 1_000_000_000
    ranked = row_numbers(per_tx, ["token"], ["sell", "newest", "tx"], bucket, "token_rank", scan.max_rows)
    enriched = (ranked.join(observed_buyers, "token", "left").join(
        assessed.select("token").distinct().withColumn("assessed", F.lit(True)), "token", "left"))
    enriched = enriched.withColumns({"buyers": F.coalesce("buyers", F.lit(0)),
                                     "assessed": F.coalesce("assessed", F.lit(False))})
    return enriched.orderBy((F.col("buyers") >= 2).asc(), "sell", F.desc("assessed"), "token_rank", F.desc("ts"), "tx"
                            ).limit(limit).select("tx", "token", "ts", "block", "sell", "token_rank", "buyers", "assessed")


def creator_history(creators: DataFrame) -> DataFrame:
    """How many deployments each initiator has in the observed window."""
    counts = creators.groupBy("initiator").agg(F.count("*").alias("observed_deployments"))
    return creators.join(counts, "initiator")


def pool_keys(pools: DataFrame, creation: DataFrame, tick_word: Column) -> DataFrame:
    """Tick spacing of singleton pools, recovered from the pool's own creation log; unmatched pools are flagged."""
    found = creation.select("tx", "pool", tick_word.alias("tick_spacing"))
    out = pools.join(found, ["tx", "pool"], "left")
    return out.withColumn("state", F.when(F.col("tick_spacing").isNull(), "pool_key_unavailable").otherwise("resolved"))


def judged_rows(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return rows.withColumn("problems", failed(rules))
