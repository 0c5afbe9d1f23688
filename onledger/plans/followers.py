"""What a delayed follower would have earned: cohort, enrolment, price paths, rankings, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions.guards import age_ok, finite, holds, is_number
from onledger.operators import joins
from onledger.operators.aggregates import earliest, exact_median
from onledger.operators.rules import failed
from onledger.operators.windows import greedy_pairs
from onledger.params import FEED_MAX_AGE_SECONDS, FollowerRules, ScreenRules
from onledger.session import materialize

_EXACT = "decimal(38,12)"


def first_buy_cohort(flows: DataFrame, live: DataFrame, enrolled: DataFrame, now: Column,
                     rules: FollowerRules = FollowerRules()) -> DataFrame:
    """First observed buy per wallet and token, whatever became of it. Only buys old enough to be measured to the end."""
    cols = ["tx", "wallet", "token", "ts"]
    buys = flows.filter("side = 'buy'").select(cols).union(live.filter("side = 'buy'").select(cols)).distinct()
    matured = buys.filter(F.col("ts") < now - rules.max_hold - rules.entry_deadline - rules.exit_grace)
    first = earliest(matured, ["wallet", "token"], ["ts", "tx"])
    return first.join(enrolled.select("wallet", "token"), ["wallet", "token"], "left_anti").join(
        enrolled.select("tx"), "tx", "left_anti").select(cols)


def enroll(cohort: DataFrame, swaps: DataFrame, pools: DataFrame, seen: DataFrame,
           rules: FollowerRules = FollowerRules()) -> DataFrame:
    """Bind each sample to the one pool its own transaction used, and to a case shared by equal (pool, target).

    pools: pool, native0, native1, created_block. Exactly one side must be the quote currency and the pool must exist by
    then; none or several such pools leave the sample unresolved.
    """
    usable = pools.filter(F.col("native0") != F.col("native1")).select("pool", "created_block")
    candidates = swaps.select("tx", "token", "pool", "block").join(usable, "pool").filter("created_block <= block")
    found = joins.resolve_one(candidates, ["tx", "token"], "pool", "pool")
    rows = cohort.join(found, ["tx", "token"], "left").join(seen.select("tx", "seen_at"), "tx", "left")
    target = F.ceil(F.greatest(F.col("leader_ts") + rules.delay, F.col("seen_at"))).cast("bigint")
    rows = rows.withColumn("target", target)
    late = F.col("target") > F.col("leader_ts") + rules.entry_deadline
    status = F.when(F.col("pool").isNull(), "unresolved").when(late, "entry_rejected").otherwise("replaying")
    reason = F.when(F.col("pool").isNull(), "leader_pool_ambiguous_or_missing").when(late, "observed_after_entry_deadline")
    open_ = F.col("status") == "replaying"
    key = F.sha2(F.concat(F.lit(f"[{rules.measurement_version}, \""), F.col("pool").cast("string"), F.lit('", '),
                          F.col("target").cast("string"), F.lit("]")), 256)
    return rows.withColumns({"status": status, "reason": reason}).select(
        "tx", "wallet", "token", "leader_ts", "status", "reason", "pool", F.when(open_, F.col("target")).alias("entry_target"),
        F.when(open_, key).alias("case_key"))


def replay_cases(enrolled: DataFrame) -> DataFrame:
    """One row per case: identical work is done once."""
    return enrolled.filter("case_key IS NOT NULL").groupBy("case_key").agg(
        F.min("token").alias("token"), F.min("pool").alias("pool"), F.min("entry_target").alias("entry_target"),
        F.count("*").alias("members"))


def net_exit(output: Column, rate: Column, tax: Column, rules: FollowerRules) -> Column:
    """Proceeds after transfer tax, slippage and the fixed fee, never below zero."""
    value = output.cast("double") * rate * (1 - tax) * (1 - rules.slippage) - rules.network_fee
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


REASONS = "array('stop_loss', 'take_profit', 'time_exit')"


def exit_reason(value: Column, cost: float, elapsed: Column, rules: FollowerRules) -> Column:
    return (F.when(value <= cost * (1 - rules.stop_loss), "stop_loss")
            .when(value >= cost * (1 + rules.take_profit), "take_profit")
            .when(value.isNotNull() & (elapsed >= rules.max_hold), "time_exit"))


def replay_paths(cases: DataFrame, quotes: DataFrame, candles: DataFrame, candle_width: int,
                 rules: FollowerRules = FollowerRules(), keys=("token",)) -> DataFrame:
    """Outcome of every case.

    Entry at the first quote at or after the target, then a fixed schedule of observations up to the holding limit. Each
    observation takes the first quote at or after its time; later than the allowed gap it is missing. The first step that
    meets an exit rule ends the path: ``complete`` if nothing was missing before it, else ``incomplete`` with a stress
    return. Nothing at the last step is ``unresolved``.

    cases: case_key, keys, entry_target. quotes: keys, quote_ts, price, failed (a proven execution failure).
    candles: start, rate. The schedule has a fixed number of steps, so a case expands to a known few rows.
    """
    keys = list(keys)
    rated = lambda rows, at_: joins.last_closed(rows, candles, at_, candle_width, rules.max_fx_age, ["rate"])
    entry = joins.asof_forward(cases.select("case_key", *keys, "entry_target"), quotes, keys, ["case_key"], "entry_target",
                               "quote_ts", ["price", "failed"], ["quote_id"], rules.max_entry_gap)
    entry = rated(entry.withColumnRenamed("found_at", "entry_at"), "entry_at")
    usd_in = rules.position_size - rules.network_fee
    quantity = F.floor(F.try_divide(F.lit(usd_in), F.col("price") * F.col("rate")) * 1e6 * (1 - rules.slippage))
    opened = F.col("entry_at").isNotNull() & holds(F.col("price") * F.col("rate") > 0)
    entry = entry.withColumns({
        "quantity": F.when(opened & ~F.col("failed"), quantity),
        "entry_state": F.when(holds(F.col("failed")), "entry_rejected").when(~opened, "unresolved").otherwise("open")})
    entry = materialize(entry, "entries")

    steps = entry.filter("entry_state = 'open'").select(
        "case_key", *keys, "entry_at", "quantity", F.explode(F.sequence(
            F.col("entry_at") + rules.step, F.col("entry_at") + rules.max_hold, F.lit(rules.step).cast("bigint"))).alias("due"))
    seen = joins.asof_forward(steps, quotes, keys, ["case_key", "due"], "due", "quote_ts", ["price", "failed"], ["quote_id"],
                              rules.max_entry_gap)
    seen = rated(seen.withColumnRenamed("found_at", "stamp"), "stamp")
    usable = ~holds(F.col("failed")) & F.col("price").isNotNull() & F.col("rate").isNotNull()
    value = F.when(usable, net_exit(F.col("quantity") * F.col("price") / 1e6, F.col("rate"), F.lit(0.0), rules))
    seen = seen.withColumn("value", value)
    why = exit_reason(F.col("value"), rules.position_size, F.col("stamp") - F.col("entry_at"), rules)
    # numbers only, so the steps are combined in a hash table; a struct or a text would be sorted by case
    hit = F.when(F.col("why").isNotNull(), F.col("due"))
    walked = seen.withColumn("why", F.array_position(F.expr(REASONS), why)).groupBy("case_key").agg(
        F.min(hit).alias("due"), *[F.min_by(n, hit).alias(n) for n in ("stamp", "value", "why")],
        F.min(F.when(F.col("value").isNull(), F.col("due"))).alias("gap"))
    walked = walked.select("case_key", "gap", F.when(F.col("due").isNotNull(), F.struct(
        "due", "stamp", "value", F.get(F.expr(REASONS), F.col("why") - 1).alias("why"))).alias("hit"))

    out = entry.join(walked, "case_key", "left")
    ended = F.col("hit").isNotNull()
    gappy = ended & holds(F.col("gap") < F.col("hit.due"))
    status = (F.when(F.col("entry_state") != "open", F.col("entry_state")).when(gappy, "incomplete").when(ended, "complete")
              .otherwise("unresolved"))
    stress = F.when(gappy | ((F.col("entry_state") == "open") & ~ended), rules.stress_return)
    return out.select(
        "case_key", *keys, "entry_target", "entry_at", status.alias("status"), F.col("hit.why").alias("reason"),
        F.when(ended, F.col("hit.stamp")).when(F.col("entry_state") == "open", F.col("entry_at") + rules.max_hold).alias("ended_at"),
        F.when(ended, F.col("hit.value") / rules.position_size - 1).alias("return_fraction"), stress.alias("stress_return"))


def cost_model(rows: DataFrame, rules: FollowerRules = FollowerRules()) -> DataFrame:
    """Size, net exit value, entry premium and every reason an entry would be refused.

    rows: quote_status, quote_block, usd_in, usd_out, quote_quantity, price, sim_status, sim_block, buy_shortfall,
    sell_shortfall, roundtrip_loss, received (atomic), exit_output, rate, observed_at, assessed_at, now, block, block_hash.
    """
    c = F.col
    capped = lambda name, cap: is_number(c(name)) & (c(name) <= cap)
    quantity = F.floor(c("received") * (1 - rules.slippage))
    premium = F.try_divide(F.lit(rules.position_size), c("quote_quantity") * (1 - rules.slippage) * c("price")) - 1
    out = rows.withColumns({
        "quantity": quantity.cast("bigint"), "premium": finite(premium),
        "net_exit": net_exit(c("exit_output"), c("rate"), c("sell_shortfall"), rules)})
    known = is_number(c("rate")) & (c("rate") > 0)
    return out.withColumn("reasons", failed([
        ("quote_provenance_missing", c("block").isNotNull() & c("block_hash").isNotNull() & is_number(c("observed_at"))),
        ("quote_stale", (F.abs(c("assessed_at") - c("observed_at")) <= 120)
         & (c("now") - F.greatest("assessed_at", "observed_at")).between(0, 120)),
        ("entry_quote_or_simulation_missing", (c("quote_status") == "quoted") & (c("sim_status") == "passed")),
        ("entry_size_mismatch", F.abs(c("usd_in") - (rules.position_size - rules.network_fee)) <= 1e-6),
        ("entry_simulation_costs_failed", capped("buy_shortfall", rules.max_transfer_tax)
         & capped("sell_shortfall", rules.max_transfer_tax) & capped("roundtrip_loss", rules.max_roundtrip_loss)),
        ("entry_quantity_zero", c("quantity") > 0),
        ("quote_block_mismatch", (c("quote_block") == c("block")) & (c("sim_block") == c("block"))),
        ("usd_reference_invalid", known),
        ("entry_premium_above_2_percent", c("premium") <= rules.max_entry_premium),
        ("independent_exit_depth_failed", c("net_exit") >= rules.position_size * rules.min_exit_fraction),
    ]))


def paper_entry(price: Column, rules: ScreenRules = ScreenRules()) -> Column:
    """Units, fee and effective price of a fixed-budget buy; the budget includes the fee."""
    paid = price * (1 + rules.slippage_bps / 10000)
    gross = (rules.position_size - rules.network_fee) / (1 + rules.fee_bps / 10000)
    return F.struct((gross / paid).alias("quantity"), F.lit(rules.position_size - gross).alias("fee"), paid.alias("price"))


def paper_exit(mark: Column, quantity: Column, rules: ScreenRules = ScreenRules()) -> Column:
    price = mark * (1 - rules.slippage_bps / 10000)
    gross = price * quantity
    fee = gross * rules.fee_bps / 10000 + rules.network_fee
    return F.struct(price.alias("price"), fee.alias("fee"), (gross - fee).alias("proceeds"))


def follower_rankings(samples: DataFrame, as_of: Column, rules: FollowerRules = FollowerRules()) -> DataFrame:
    """Wallets by what following them returned, seen from ``as_of``: only what was strictly known before counts.

    samples: tx, wallet, token, leader_ts, queued_at, status, ended_at, completed_at, return_fraction, stress_return, version.
    Sums are decimal, so the order of rows cannot change a result.
    """
    c = F.col
    known = samples.filter((c("leader_ts") < as_of) & (c("queued_at") < as_of))
    result = F.coalesce("stress_return", "return_fraction")
    usable = ((c("version") == rules.measurement_version) & (c("completed_at") < as_of) & (c("ended_at") < as_of)
              & result.isNotNull())
    marked = known.withColumns({"_use": holds(usable), "_ret": F.when(holds(usable), result)})
    marked = marked.withColumn("_got", c("_use") & (c("status") == "complete") & c("return_fraction").isNotNull())
    base = marked.groupBy("wallet").agg(
        F.count_if("_got").alias("samples"), F.count("*").alias("observed_buys"),
        F.countDistinct(F.when(c("_got"), c("token"))).alias("tokens"),
        F.sum(c("_ret").cast(_EXACT)).alias("_sum"), F.count_if("_use").alias("_n"),
        F.count_if(c("_ret") > 0).alias("wins"), F.count_if(c("_use") & c("stress_return").isNotNull()).alias("stressed_exits"),
        F.sum(F.when(c("_got"), c("return_fraction")).cast(_EXACT)).alias("_msum"))
    medians = exact_median(marked.filter("_use"), ["wallet"], "_ret", "median_return")
    out = base.join(medians, "wallet", "left")
    some = c("samples") > 0
    out = out.withColumns({
        "coverage": c("samples") / c("observed_buys"),
        "mean_return": F.when(some, c("_sum").cast("double") / c("_n")),
        "median_return": F.when(some, c("median_return")),
        "measured_mean_return": F.when(some, c("_msum").cast("double") / c("samples")),
        "win_rate": F.try_divide("wins", "_n")})
    qualified = ((c("samples") >= rules.min_samples) & (c("tokens") >= rules.min_tokens) & (c("coverage") >= rules.min_coverage)
                 & (c("win_rate") >= rules.min_win_rate) & (c("mean_return") >= rules.min_mean_return)
                 & (c("median_return") > rules.min_median_return))
    return out.select("wallet", "samples", "observed_buys", "tokens", "coverage", "mean_return", "median_return",
                      "measured_mean_return", "wins", "stressed_exits", holds(qualified).alias("qualified"))


def ranking_order() -> list[Column]:
    return [F.desc("qualified"), F.desc("samples"), F.coalesce("mean_return", F.lit(-10.0)).desc(), F.asc("wallet")]


def momentum_signal(anchors: DataFrame, swaps: DataFrame, flows: DataFrame, creators: DataFrame, ranked: DataFrame,
                    indexed_through: Column, rules: FollowerRules = FollowerRules()) -> DataFrame:
    """Buying pressure in the window before each anchor.

    anchors: id, token, pool, anchor_at — one row per (token, pool), so a swap meets at most one anchor. swaps: tx, token, pool, ts,
    signed_quote, evidence_ok. flows: tx, wallet, token, ts, seen_at, side, quote, origin. creators: token, deployer,
    initiator, status. ranked: wallet, available_before. A net flow with one unproven swap is unknown, not partial.
    """
    c = F.col
    events = swaps.join(anchors, ["token", "pool"]).filter((c("ts") >= c("anchor_at") - rules.window) & (c("ts") <= c("anchor_at")))
    events = materialize(events.select("id", "token", "anchor_at", "tx", "signed_quote", "evidence_ok"), "signal-events")
    net = events.groupBy("id").agg(
        F.when(F.bool_and("evidence_ok"), F.sum("signed_quote")).alias("net"), F.bool_and("evidence_ok").alias("proven"),
        F.countDistinct("tx").alias("observed_transactions"))

    expected = events.select("id", "token", "anchor_at", "tx").distinct()
    rows = flows.join(expected, ["tx", "token"]).filter(
        (c("ts") >= c("anchor_at") - rules.window) & (c("ts") <= c("anchor_at")) & (c("seen_at") <= c("anchor_at")))
    rows = materialize(rows.select("id", "token", "tx", "wallet", "origin", "ts", "side", "quote"), "signal-flows")
    signed = F.when(c("side") == "buy", c("quote")).otherwise(-c("quote"))
    attributed = rows.groupBy("id").agg(F.sum(signed).alias("attributed_net"), F.countDistinct("tx").alias("attributed_transactions"))

    known = creators.select("token", F.explode(F.array_distinct(F.array_compact(F.array("deployer", "initiator")))).alias("who"))
    buys = rows.filter("side = 'buy'")
    for column in ("wallet", "origin"):
        buys = buys.join(known.withColumnRenamed("who", column), ["token", column], "left_anti")
    buyers = greedy_pairs(buys, ["id"], "wallet", "origin", ["ts", "tx"])
    counted = buyers.join(ranked.select("wallet", "available_before"), "wallet", "left").groupBy("id").agg(
        F.count("*").alias("buyers"), F.count_if(c("available_before") < c("ts")).alias("qualified_wallets"))

    status = creators.select("token", (c("status") == "verified").alias("_verified"))
    out = anchors.select("id", "token", "pool", "anchor_at")
    for part in (net, attributed, counted):
        out = out.join(part, "id", "left")
    out = out.join(status, "token", "left").withColumn("indexed_through", indexed_through)
    out = out.fillna(0, ["observed_transactions", "attributed_transactions", "buyers", "qualified_wallets", "attributed_net"])
    out = out.withColumn("net", F.when(c("proven").isNull(), F.lit(0)).otherwise(c("net")))
    return out.withColumn("reasons", failed([
        ("creator_identity_unresolved", c("_verified")),
        ("pool_flow_evidence_missing", c("proven").isNull() | c("proven")),
        ("trade_feed_stale", c("indexed_through").isNotNull() & age_ok(c("anchor_at"), c("indexed_through"), FEED_MAX_AGE_SECONDS)),
        ("verified_net_buying_not_positive", c("net") > 0),
        ("fewer_than_two_distinct_buyers", c("buyers") >= 2),
    ])).drop("_verified", "proven")


def focus_wallets(samples: DataFrame, rules: FollowerRules = FollowerRules()) -> DataFrame:
    """Repeat wallets with work left, earliest first. Returns play no part in the choice."""
    pending = F.col("status").isin("queued", "replaying")
    return samples.groupBy("wallet").agg(
        F.count("*").alias("total"), F.countDistinct("token").alias("tokens"), F.count_if(pending).alias("pending"),
        F.count_if(F.col("status") == "complete").alias("measured"), F.min("leader_ts").alias("first_leader_ts"),
    ).filter((F.col("total") >= rules.min_samples) & (F.col("tokens") >= rules.min_tokens) & (F.col("pending") > 0))
