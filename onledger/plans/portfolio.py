"""Audits, holder ledgers, pool prices and paper-portfolio accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions import amounts, wide
from onledger.functions.guards import holds
from onledger.operators import joins, lots
from onledger.operators.aggregates import latest, top_share
from onledger.operators.scan import running, since_marks, width_bucket
from onledger.params import MAX_AGE_SECONDS, ScanRules
from onledger.plans.signals import net_deltas
from onledger.session import materialize

_COUNT = lambda: F.count("*")
EVENT_ORDER = ("ts", "tx", "log_index", "pool", "origin", "quantity", "side")


def place_audit_events(events: DataFrame, opening: DataFrame, scan: ScanRules = ScanRules()) -> DataFrame:
    """Events after the opening stock, which counts as a first purchase of unknown cost. Quantities come in the narrowest exact
    type (see ``amounts.by_width``).

    events: wallet, token, ts, tx, log_index, pool, origin, side, quantity, cost (buys), proceeds (sales), gas. opening: wallet, token, quantity.
    """
    zero = F.lit(0).cast("bigint")
    money = "decimal(38,0)"
    none = F.lit(None).cast(money)
    kind = opening.schema["quantity"].dataType
    stock = opening.filter(F.col("quantity") > amounts.of_type(kind).zero()).select(
        "wallet", "token", F.lit(-1).cast("bigint").alias("ts"), zero.alias("tx"), zero.alias("log_index"), zero.alias("pool"),
        zero.alias("origin"), F.lit("buy").alias("side"), "quantity", none.alias("cost"), none.alias("proceeds"), zero.cast(money).alias("gas"))
    if amounts.is_wide_column(events, "quantity") != wide.is_wide(kind):
        events, stock = amounts.exact(events, money=()), amounts.exact(stock, money=())
    rows = events.select(*stock.columns).unionByName(stock)

    def scanned(part: DataFrame) -> list[DataFrame]:
        return [lots.positions(part, EVENT_ORDER, scan)]

    return materialize(amounts.by_width(rows, "token", scanned, money=("cost", "proceeds", "gas"))[0], "audit-events")


def audit_fifo(placed: DataFrame, scan: ScanRules = ScanRules(), narrow: bool = False) -> DataFrame:
    """Sales with cost and result; a sale that touches stock of unknown cost has neither. Quantities are returned as wide values,
    with ``narrow`` in the type of ``placed``."""
    sales = lots.audit_sales(placed, scan, carry_cols=("tx", "ts", "log_index", "pool", "origin"))
    return sales if narrow else amounts.widened(sales)


def wallet_audit(placed: DataFrame, sales: DataFrame, balances: DataFrame) -> DataFrame:
    """Per wallet: are transfers and balances consistent, and what did consistent, fully known sales earn.

    balances: wallet, token, opening, ending. A token reconciles when opening plus all movements equals ending.
    """
    c = F.col
    moved = placed.filter("ts >= 0")
    of = amounts.of_column(placed, "quantity")
    balances = amounts.exact(balances, ("opening", "ending"))
    signed = F.when(c("side") == "buy", c("quantity")).otherwise(of.negate(c("quantity")))
    delta = moved.groupBy("wallet", "token").agg(of.total(signed).alias("delta"), _COUNT().alias("events"), F.sum("gas").alias("fees"))
    stock = placed.groupBy("wallet", "token").agg(of.minus(F.max("bought"), F.max("head_final")).alias("left"))
    tokens = amounts.exact(delta.join(balances, ["wallet", "token"], "left").join(stock, ["wallet", "token"]), ("delta", "left"), ())
    tokens = tokens.withColumn("reconciled", holds(wide.plus(c("opening"), c("delta")) == c("ending")))
    tokens = materialize(tokens, "audit-tokens")
    per_wallet = tokens.groupBy("wallet").agg(
        F.sum("events").alias("transfer_events"), _COUNT().alias("tokens"), F.count_if("reconciled").alias("tokens_reconciled"),
        F.count_if(c("opening") > wide.zero()).alias("tokens_with_opening"), F.count_if(c("left") > wide.zero()).alias("open_positions"),
        F.sum("fees").alias("fees"))
    judged = sales.join(tokens.select("wallet", "token", "reconciled"), ["wallet", "token"])
    good = c("pnl").isNotNull() & c("reconciled")
    result = judged.groupBy("wallet").agg(
        F.count_if(good).alias("matched_sales"), F.count_if(~good).alias("unmatched_sales"),
        F.count_if(good & (c("pnl") > 0)).alias("winning_sales"), F.sum(F.when(good, c("pnl"))).alias("pnl"),
        F.sum(F.when(good, c("cost"))).alias("cost"))
    out = per_wallet.join(result, "wallet", "left").fillna(0, ["matched_sales", "unmatched_sales", "winning_sales"])
    return out.withColumn("return_pct", F.try_divide(c("pnl"), c("cost")) * 100).drop("cost")


def predeployment_zero(opening: DataFrame, code: DataFrame) -> DataFrame:
    """An unknown opening balance is zero only where the contract was proven absent; a failed call alone proves nothing."""
    absent = code.select("token", "height", (F.col("code") == "0x").alias("_absent"))
    joined = opening.join(absent, ["token", "height"], "left")
    balance = F.when(F.col("balance").isNull() & holds(F.col("_absent")), F.lit(0)).otherwise(F.col("balance"))
    return joined.select(*[c for c in opening.columns if c != "balance"], balance.alias("balance"))


def explorer_crosscheck(history: DataFrame, receipts: DataFrame) -> DataFrame:
    """Per wallet: explorer history against independently fetched receipts of its token transactions.

    history: wallet, hash, block, block_hash, sender, recipient, gas_used, gas_price, status, failed. receipts: wallet, hash
    and the same fields. A receipt whose sender and recipient are both other accounts is internal and not expected.
    """
    fields = ["block", "block_hash", "gas_used", "gas_price", "status", "sender", "recipient"]
    c = F.col
    mine = lambda: (c("wallet") == c("sender")) | (c("wallet") == c("recipient"))
    external = receipts.withColumn("internal", ~holds(mine()))
    both = joins.reconcile(history.select("wallet", "hash", *fields), external.filter("NOT internal"), ["wallet", "hash"], fields)
    internal = external.filter("internal").select("wallet", "hash").distinct()
    state = both.groupBy("wallet").agg(
        F.count_if(c("status") == "matched").alias("receipt_matches"), F.count_if(c("status") == "right_only").alias("missing"),
        F.count_if(c("status") == "mismatched").alias("mismatched"), F.count_if(c("status") == "left_only").alias("_only"))
    shared = history.select("wallet", "hash").join(internal, ["wallet", "hash"], "left_semi").groupBy("wallet").agg(
        _COUNT().alias("_shared"))
    own = c("sender") == c("wallet")
    totals = history.groupBy("wallet").agg(
        _COUNT().alias("external_transactions"), F.count_if(own & c("failed")).alias("outgoing_failed"),
        F.sum(F.when(own, c("gas_used") * c("gas_price")).otherwise(0)).alias("outgoing_fees"))
    inner = internal.groupBy("wallet").agg(_COUNT().alias("internal_transactions"))
    out = state.join(totals, "wallet", "left").join(inner, "wallet", "left").join(shared, "wallet", "left").fillna(0)
    return out.withColumns({
        "without_token_events": c("_only") - c("_shared"),
        "status": F.when((c("missing") == 0) & (c("mismatched") == 0), "matched").otherwise("disagreement")}).drop("_only", "_shared")


def holder_ledger(transfers: DataFrame, supply: DataFrame) -> DataFrame:
    """Holder count and top-ten share per token, only if no balance is negative and they add up to the supply. Amounts
    become wide values."""
    balances = net_deltas(amounts.exact(transfers, ("amount",)), ["token"]).withColumnRenamed("delta", "amount")
    balances = materialize(balances, "balances")
    supply, zero = amounts.exact(supply, ("supply",)), wide.zero()
    check = balances.groupBy("token").agg(F.min("amount").alias("_low"), wide.total(F.col("amount")).alias("_sum"))
    held = top_share(balances.filter(F.col("amount") > zero), ["token"], "amount", "wallet", 10, "top10_share")
    joined = supply.join(check, "token", "left").join(held, "token", "left")
    c = F.col
    reason = (F.when(~holds(c("supply") > zero), "no_supply").when(c("_low") < zero, "negative_balance")
              .when(~holds(c("_sum") == c("supply")), "supply_mismatch"))
    ok = c("reason").isNull()
    return joined.withColumn("reason", reason).select(
        "token", F.when(ok, "reconciled").otherwise("rejected").alias("status"), "reason",
        F.when(ok, c("holders")).alias("holders"), F.when(ok, c("top10_share")).alias("top10_share"))


def v2_state_metrics(pools: DataFrame) -> DataFrame:
    """Price, two-sided liquidity and burned LP share; a share of no supply is undefined, not zero.

    pools: quote_reserve, token_reserve, decimals, rate, lp_supply, lp_burned.
    """
    c = F.col
    quote, token = c("quote_reserve").cast("double"), c("token_reserve").cast("double")
    scale = F.concat(F.lit("1e"), c("decimals").cast("string")).cast("double")
    priced = (quote != 0) & (token != 0)
    return pools.withColumns({
        "price": F.when(priced, quote * c("rate") * scale / (token * 1e18)), "liquidity": quote * c("rate") * 2 / 1e18,
        "lp_burned_fraction": F.try_divide(c("lp_burned").cast("double"), c("lp_supply").cast("double")),
        "lp_burn_status": F.when(c("lp_supply") != 0, "measured").otherwise("undefined")})


def concentrated_price(sqrt_price: Column, quote_index: Column, decimals: Column, rate: Column) -> Column:
    """Token price from the square-root price; NULL when that is not positive."""
    ratio = sqrt_price * sqrt_price / float(2 ** 192)
    scale = F.concat(F.lit("1e"), decimals.cast("string")).cast("double")
    oriented = F.when(quote_index == 0, 1 / ratio).otherwise(ratio)
    return F.when(sqrt_price > 0, oriented * scale / 1e18 * rate)


def constant_product_quote(amount: Column, reserve_in: Column, reserve_out: Column) -> Column:
    """Exact output, as a wide value, of a constant-product pool with a 0.3 % fee, from wide values; NULL without reserves.

    The product of amount and reserve may have 512 bits; it is kept as limbs until it is divided.
    """
    good = (reserve_in > wide.zero()) & (reserve_out > wide.zero()) & (amount >= wide.zero())
    return F.when(good, wide.fee_quote(amount, reserve_in, reserve_out, 997, 1000))


def trade_ledger(fills: DataFrame, scan: ScanRules = ScanRules(), order: Sequence[str] = ("ts", "fill_id")) -> DataFrame:
    """Running cash per arm; cost of the open position and result of every exit per (arm, token).

    fills: arm, token, fill_id, ts, side, amount, fee; they are read several times, so costly ones should be written down. A buy
    spends amount plus fee, a sale brings amount minus fee and ends the position, so its cost is what was spent since the sale before.
    """
    c = F.col
    buy = c("side") == "buy"
    rows = fills.withColumn("cash_flow", F.when(buy, -c("amount") - c("fee")).otherwise(c("amount") - c("fee")))
    bucket = width_bucket("ts", scan.bucket_seconds)
    spent = F.when(buy, -c("cash_flow")).otherwise(F.lit(0).cast("bigint"))
    cash = running(rows, ["arm"], order, bucket, max_rows=scan.max_rows, sums={"cash": (c("cash_flow"), True)})
    out = since_marks(cash, ["arm", "token"], order, bucket, spent, ~buy, "_since", scan.max_rows)
    return out.withColumns({
        "position_cost": F.when(buy, c("_since")).otherwise(0),
        "pnl": F.when(~buy, c("cash_flow") - c("_since"))}).drop("_since")


def portfolio_report(trades: DataFrame, marks: DataFrame, bankroll: int, now: Column, max_age: int = MAX_AGE_SECONDS) -> DataFrame:
    """Cash, equity, realised and unrealised result per arm; in the stressed equity a stale mark is worth nothing.

    trades: arm, token, side, quantity, cash_flow, fee, pnl. marks: token, mark_id, mark, marked_at.
    """
    c = F.col
    signed = F.when(c("side") == "buy", c("quantity")).otherwise(-c("quantity"))
    cost = F.when(c("side") == "buy", -c("cash_flow")).otherwise(0)
    per = trades.groupBy("arm", "token").agg(
        F.sum(signed).alias("held"), F.sum("cash_flow").alias("flow"), F.sum("fee").alias("fees"), _COUNT().alias("fills"),
        F.coalesce(F.sum("pnl"), F.lit(0)).alias("pnl"), F.sum(cost).alias("spent"))
    newest = latest(marks, ["token"], ["marked_at", "mark_id"]).select("token", "mark", "marked_at")
    open_ = c("held") > 0
    valued = per.join(newest, "token", "left").withColumns({
        "stale": open_ & ~holds(now - c("marked_at") <= max_age),
        "value": F.when(open_, c("held") * c("mark")).otherwise(0)})
    return valued.groupBy("arm").agg(
        (F.sum("flow") + bankroll).alias("cash"), (F.sum("flow") + bankroll + F.coalesce(F.sum("value"), F.lit(0))).alias("equity"),
        (F.sum("flow") + bankroll + F.coalesce(F.sum(F.when(~c("stale"), c("value"))), F.lit(0))).alias("stressed_equity"),
        F.sum("pnl").alias("realized_pnl"), F.sum("fees").alias("fees"), F.sum("fills").alias("fills"),
        F.count_if(open_).alias("open_positions"), F.count_if("stale").alias("stale_positions"))
