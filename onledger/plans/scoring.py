"""Risk assessment, candidate score, launch decision and the gates behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.bindings import RISK_FLAGS
from onledger.functions.decode import BURN_ADDRESS, ZERO_ADDRESS
from onledger.functions.guards import age_ok, clamp, finite, fraction, holds, is_number
from onledger.operators.aggregates import latest
from onledger.operators.rules import failed, merged, screen, settle_reasons
from onledger.params import (APPROVAL_MAX_AGE_SECONDS, REFRESH_COOLDOWN_SECONDS, REFRESH_MAX_ATTEMPTS, FollowerRules,
                             LaunchRules)
from onledger.plans.evidence import ACTIONS

# --- fixed values: score components (name, weight) --------------------------------------------------------------------
COMPONENTS = (
    ("Published source", 10),
    ("Contract controls", 20),
    ("Executable quote", 5),
    ("Buy and sell simulation", 5),
    ("Round-trip costs", 5),
    ("Liquidity", 15),
    ("Holder distribution", 10),
    ("Liquidity withdrawal protection", 10),
    ("Verified recent buyers", 15),
    ("Qualified wallet activity", 5),
)
SCORE_VERSION = 3
# --- fixed values: decision arms --------------------------------------------------------------------------------------
ARMS = ("wallet_momentum", "wallet_momentum_reviewed", "simple_momentum")

_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def risk_assess(rows: DataFrame, rules: LaunchRules = LaunchRules()) -> DataFrame:
    """Reasons, source status, matched-pool liquidity, top-ten share and burned LP share of one provider report.

    rows: source_flag, one text column per risk flag ('0' clear, '1' flagged), buy_tax, sell_tax, hooks, pool, version,
    pairs (array of pair, liquidity), holders (array of shares as text), holder_count, lp_holders (array of address, share).
    A missing field is unknown, never a pass.
    """
    c = F.col
    source = F.when(c("source_flag") == "1", "verified").when(c("source_flag") == "0", "unverified").otherwise("unavailable")
    reasons = [F.when(source == "unverified", "source_reported_unverified_by_goplus").when(
        source == "unavailable", "source_verification_data_unavailable")]
    for flag in RISK_FLAGS:
        reasons.append(F.when(holds(c(flag) == "0"), F.lit(None)).when(holds(c(flag) == "1"), f"{flag}_flagged").otherwise(
            f"{flag}_unknown"))
    for tax in ("buy_tax", "sell_tax"):
        value = fraction(c(tax))
        reasons.append(F.when(value.isNull(), f"{tax}_data_unavailable").when(value > rules.max_tax, f"{tax}_above_limit"))
    reasons.append(F.when(~holds(c("hooks") == ZERO_ADDRESS), "unreviewed_v4_hook"))
    matched = F.filter("pairs", lambda p: F.lower(p["pair"]) == c("pool"))
    shares = F.transform("holders", lambda h: fraction(h))
    complete = (F.size("holders") > 0) & ~F.exists(shares, lambda x: x.isNull()) & (
        F.size("holders") >= F.least(c("holder_count").try_cast("int"), F.lit(10)))
    ten = F.slice(F.sort_array(shares, asc=False), 1, 10)
    dead = F.filter("lp_holders", lambda h: F.lower(h["address"]).isin(ZERO_ADDRESS, BURN_ADDRESS) & fraction(h["share"]).isNotNull())
    countable = (c("version") == 2) & (F.size("pairs") == 1) & (F.size(matched) == 1)
    burned = F.when(countable & (F.size("lp_holders") > 0), F.aggregate(
        dead, F.lit(0.0), lambda a, h: a + fraction(h["share"])))
    reasons.append(F.when(~holds(burned >= rules.min_lp_burned), "liquidity_withdrawal_risk_unresolved"))
    return rows.withColumns({
        "reasons": F.array_compact(F.array(*reasons)), "source_status": source,
        "matched_liquidity": F.when(F.size(matched) > 0, finite(F.try_element_at(matched, F.lit(1))["liquidity"])),
        "top10_share": F.when(complete, F.aggregate(ten, F.lit(0.0), lambda a, x: a + x)), "lp_burned": burned})


def candidate_score(rows: DataFrame, rules: LaunchRules = LaunchRules(), now: str = "now") -> DataFrame:
    """Adds ``components`` and ``score`` to effective snapshots. Missing evidence earns no points and says so."""
    c = F.col
    controls = [c(f"eff_{flag}") for flag in RISK_FLAGS[3:]]
    one = lambda cond: F.when(holds(cond), 1).otherwise(0)
    passed = sum((one(x == "pass") for x in controls), F.lit(0))
    known = sum((one(x.isin("pass", "fail")) for x in controls), F.lit(0))
    fresh = is_number(c("observed_at")) & age_ok(c(now), c("observed_at"), rules.max_age)
    costs = [c("buy_shortfall"), c("sell_shortfall"), c("roundtrip_loss")]
    cheap = (costs[0] <= rules.max_tax) & (costs[1] <= rules.max_tax) & (costs[2] <= rules.max_roundtrip_loss)
    simulated = holds(c("eff_sim") == "passed") & is_number(costs[0]) & is_number(costs[1]) & is_number(costs[2])
    share, burned = c("eff_top10"), c("eff_lp_burned")
    fractions = (
        F.when(c("eff_source") == "verified", 1.0).when(c("eff_source") == "unverified", 0.0),
        F.when(known > 0, passed / float(len(controls))),
        F.when(c("eff_quote").isNotNull(), one((c("eff_quote") == "quoted") & fresh)),
        F.when(c("eff_sim").isNotNull(), one((c("eff_sim") == "passed") & fresh)),
        F.when(simulated, one(fresh & cheap)),
        F.when(is_number(c("eff_liquidity")), F.least(c("eff_liquidity") / rules.min_liquidity, F.lit(1.0)) if rules.min_liquidity > 0 else one(c("eff_liquidity") > 0)),
        F.when(is_number(share) & (share <= 1), F.least(F.lit(1.0), (1 - share) / (1 - rules.max_top10_share)) if rules.max_top10_share < 1 else F.lit(1.0)),
        F.when(is_number(burned) & (burned <= 1), one(burned >= rules.min_lp_burned)),
        F.when(is_number(c("eff_buyers")), F.least(c("eff_buyers") / 5, F.lit(1.0))),
        F.when(is_number(c("eff_qualified")), F.least(c("eff_qualified"), F.lit(1.0))),
    )
    # shares stand in columns of their own and points are added up as they are: a lambda over the components is not compiled
    shares = {f"_share_{i}": share_of.cast("double") for i, share_of in enumerate(fractions)}
    parts, points = [], []
    for (name, weight), share_of in zip(COMPONENTS, shares):
        f = c(share_of)
        points.append(F.coalesce(F.round(weight * clamp(f, 0.0, 1.0) * 100).cast("bigint"), F.lit(0)))
        parts.append(F.struct(
            F.lit(name).alias("name"), F.lit(weight).alias("maximum"), points[-1].alias("hundredths"),
            F.when(f.isNull(), "unknown").when(f >= 1, "met").when(f > 0, "partial").otherwise("not_met").alias("status")))
    total = sum(points, F.lit(0).cast("bigint"))
    return rows.withColumns(shares).withColumns({"components": F.array(*parts), "score": F.round(total / 100, 1)}).drop(*shares)


@screen("launch")
def decide(rows: DataFrame, rules: LaunchRules = LaunchRules(), now: str = "now") -> DataFrame:
    """SKIP / MIRROR / SNIPE with reasons. MIRROR is tried before SNIPE; a low score turns a clean row into SKIP.

    rows: effective snapshots with ``findings`` and ``risk_reasons``.
    """
    c = F.col
    scored = candidate_score(rows, rules, now)
    blockers = F.transform(F.filter("findings", lambda f: f["severity"] == "blocker"),
                           lambda f: F.concat(F.lit("evidence_"), F.lower(f["code"])))
    quote = priced_effective(rules, c(now))
    checks = failed([
        ("quote_missing_or_stale", quote),
        ("liquidity_data_unavailable", is_number(c("eff_liquidity"))),
        ("liquidity_below_limit", ~is_number(c("eff_liquidity")) | (c("eff_liquidity") >= rules.min_liquidity)),
        ("holder_concentration_data_unavailable", is_number(c("eff_top10"))),
        ("holder_concentration_above_limit", ~is_number(c("eff_top10")) | (c("eff_top10") <= rules.max_top10_share)),
        ("risk_stale", is_number(c("risk_checked_at")) & (c(now) - c("risk_checked_at")).between(0, rules.max_risk_age)),
        ("launch_too_old_or_unknown", is_number(c("launch_age")) & (c("launch_age") <= rules.max_launch_age)),
        ("token_deployment_unconfirmed", c("deployment_confirmed")),
    ])
    given = F.coalesce("risk_reasons", F.array(F.lit("risk_unavailable")))
    found = scored.withColumn("_base", F.concat(given, blockers, checks))
    clean = F.size("_base") == 0
    mirror = F.coalesce(c("eff_qualified"), F.lit(0)) >= rules.mirror_wallets
    snipe = (c("launch_age") <= rules.snipe_age) & (F.coalesce(c("eff_buyers"), F.lit(0)) >= rules.snipe_buyers)
    wanted = F.when(mirror, "MIRROR").when(snipe, "SNIPE")
    low = c("score") < rules.min_score
    extra = (F.when(~clean, _none()).when(wanted.isNull(), F.array(F.lit("insufficient_launch_or_wallet_signal")))
             .when(low, F.array(F.lit("score_below_threshold"))).otherwise(_none()))
    out = found.withColumn("reasons", F.concat("_base", extra))
    return out.withColumn("action", F.when(F.size("reasons") == 0, wanted).otherwise("SKIP")).drop("_base")


def priced_effective(rules: LaunchRules, now: Column) -> Column:
    c = F.col
    return (c("token").isNotNull() & is_number(c("eff_price")) & holds(c("eff_price") > 0) & is_number(c("observed_at"))
            & age_ok(now, c("observed_at"), rules.max_age))


def reconcile_reasons(rows: DataFrame, rules: LaunchRules = LaunchRules()) -> DataFrame:
    """Drop reasons that stronger evidence disproves and add the ones it establishes.

    rows: reasons, lp_burned (measured), version, sim_status, buy_shortfall, sell_shortfall, roundtrip_loss, source_status,
    feed_current. The order of the rules is: LP burn, simulation, published source, feed.
    """
    c = F.col
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    when = lambda cond, *xs: F.when(holds(cond), names(*xs)).otherwise(_none())
    sim_ok = holds(c("sim_status") == "passed")
    locked = c("lp_burned") >= rules.min_lp_burned
    thin = c("lp_burned").isNotNull() & ~locked & (c("version") == 2)
    disproved = F.concat(
        when(locked | thin, "liquidity_withdrawal_risk_unresolved"),
        when(sim_ok, "cannot_buy_unknown", "cannot_sell_all_unknown", "is_honeypot_unknown"),
        when(sim_ok & (c("buy_shortfall") <= rules.max_tax), "buy_tax_data_unavailable"),
        when(sim_ok & (c("sell_shortfall") <= rules.max_tax), "sell_tax_data_unavailable"),
        when(c("source_status") == "verified", "source_reported_unverified_by_goplus", "source_verification_data_unavailable"),
        when(c("feed_current"), "scanner_catching_up"))
    established = F.concat(
        when(thin, "v2_lp_burn_below_95_percent"),
        when(sim_ok & (c("buy_shortfall") > rules.max_tax), "simulated_buy_shortfall_above_limit"),
        when(sim_ok & (c("sell_shortfall") > rules.max_tax), "simulated_sell_shortfall_above_limit"),
        when(sim_ok & (c("roundtrip_loss") > rules.max_roundtrip_loss), "simulated_roundtrip_loss_above_10_percent"),
        when(c("sim_status") == "failed", "buy_sell_simulation_failed"))
    return rows.withColumn("settled", settle_reasons(c("reasons"), disproved, established))


def approval_gate(assessments: DataFrame, reviews: DataFrame, max_age: int = APPROVAL_MAX_AGE_SECONDS) -> DataFrame:
    """Why the latest review of a token does not approve an assessment; NULL means approved.

    assessments: id, token, pool, action, now. reviews: review_id, token, status, action, finished_at, evidence_ts, pool.
    """
    newest = latest(reviews, ["token"], ["review_id"]).select(
        "token", F.col("status").alias("r_status"), F.col("action").alias("r_action"), "finished_at", "evidence_ts",
        F.col("pool").alias("r_pool"), F.lit(True).alias("_has"))
    joined = assessments.join(newest, "token", "left")
    c = F.col
    timely = holds((c("now") - c("evidence_ts")).between(0, max_age)) & holds(c("finished_at").isNotNull()) & holds(
        c("now") - c("finished_at") <= max_age)
    gate = (F.when(c("_has").isNull(), "review_pending")
            .when(~holds(c("r_status") == "complete"), F.concat(F.lit("review_"), c("r_status")))
            .when(c("r_action") == "SKIP", "review_skip").when(~timely, "review_stale")
            .when(~c("r_pool").eqNullSafe(c("pool")), "review_pool_mismatch")
            .when(~holds(c("r_action") == c("action")) | ~c("action").isin("SNIPE", "MIRROR"), "review_signal_no_longer_matches"))
    return joined.select(*assessments.columns, gate.alias("gate"))


def arm_decisions(signals: DataFrame, arms=ARMS) -> DataFrame:
    """One row per (assessment, arm): the union of reasons, BUY only if there is none.

    signals: id, token, base_reasons, qualified, gate, capital_reasons. The arms are a literal list of three, so each row
    expands in place.
    """
    c = F.col
    rows = signals.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    wallet = F.when((c("arm") != "simple_momentum") & (c("qualified") < 2),
                    F.array(F.lit("fewer_than_two_prequalified_followable_wallets"))).otherwise(_none())
    review = F.when((c("arm") == "wallet_momentum_reviewed") & c("gate").isNotNull(), F.array(c("gate"))).otherwise(_none())
    out = rows.withColumn("reasons", merged(c("base_reasons"), wallet, review, c("capital_reasons")))
    return out.select("id", "token", "arm", F.when(F.size("reasons") == 0, "BUY").otherwise("SKIP").alias("action"), "reasons")


def refresh_requests(findings: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """New refresh requests: one per (token, action), not while one is open, at most three attempts, after a cooldown.

    findings: token, follow_up. state: token, follow_up, status, attempts, attempted_at, requested_at.
    """
    wanted = findings.filter(F.col("follow_up").isin(*[a for a in ACTIONS if a != "none"])).select("token", "follow_up").distinct()
    c = F.col
    joined = wanted.join(state, ["token", "follow_up"], "left")
    blocked = (c("status").isin("queued", "running") | (c("attempts") >= REFRESH_MAX_ATTEMPTS)
               | (now - F.coalesce("attempted_at", "requested_at") < REFRESH_COOLDOWN_SECONDS))
    return joined.filter(c("status").isNull() | ~holds(blocked)).select(
        "token", "follow_up", F.lit("queued").alias("status"), now.alias("requested_at"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"))


def finish_refreshes(running: DataFrame, findings: DataFrame, validity: DataFrame) -> DataFrame:
    """Outcome of running requests: unavailable if the finding persists or the document is invalid, completed otherwise."""
    still = findings.select("token", "follow_up").distinct().withColumn("_still", F.lit(True))
    joined = running.join(still, ["token", "follow_up"], "left").join(validity.select("token", "valid"), "token", "left")
    lost = F.coalesce("_still", F.lit(False)) | ~F.coalesce("valid", F.lit(False))
    return joined.select("token", "follow_up", F.when(lost, "unavailable").otherwise("completed").alias("outcome"))


def market_snapshot(pairs: DataFrame, now: str = "now") -> DataFrame:
    """The most liquid USD-priced pool per token. pairs: token, base_token, price_usd, liquidity, pair, created_ms, ..."""
    usable = pairs.filter((F.col("base_token") == F.col("token")) & F.col("price_usd").isNotNull())
    fields = [x for x in pairs.columns if x not in ("token", "base_token")]
    best = usable.groupBy("token").agg(F.max_by(F.struct(*fields), F.struct(
        F.coalesce("liquidity", F.lit(0.0)).alias("l"), F.col("pair").alias("p"))).alias("b"))
    return best.select("token", "b.*").withColumn(
        "age_seconds", F.when(F.coalesce("created_ms", F.lit(0)) != 0, F.greatest(F.lit(0.0), F.col(now) - F.col("created_ms") / 1000)))


def review_packets(tokens: DataFrame, assessments: DataFrame, bridge: DataFrame, checks: DataFrame, max_bytes: int,
                   newest_pools: int = 5) -> DataFrame:
    """One JSON document per token: its latest assessment, else the token with its newest pools and latest checks.

    bridge: token, pool, version, block — a pool listed once per token side. A document over the byte limit is flagged.
    """
    from pyspark.sql import Window

    last = latest(assessments, ["token"], ["id"]).select(
        "token", F.struct(*[x for x in assessments.columns if x != "token"]).alias("assessment"))
    w = Window.partitionBy("token").orderBy(F.desc("block"), "pool")
    pools = (bridge.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= newest_pools).groupBy("token")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "pool", "version", "block"))),
                              lambda p: F.struct(p["pool"].alias("pool"), p["version"].alias("version"),
                                                 p["block"].alias("block"))).alias("pools")))
    newest = latest(checks, ["token"], ["checked_at"]).select(
        "token", F.struct(*[x for x in checks.columns if x != "token"]).alias("checks"))
    rows = tokens.join(last, "token", "left").join(pools, "token", "left").join(newest, "token", "left")
    known = F.col("assessment").isNotNull()
    document = F.when(known, F.to_json(F.struct("token", "assessment"))).otherwise(
        F.to_json(F.struct("token", F.lit("SKIP").alias("action"), "pools", "checks")))
    out = rows.select("token", F.when(known, "assessed").otherwise("unassessed").alias("kind"), document.alias("packet"))
    size = F.octet_length("packet").cast("bigint")
    return out.withColumns({"bytes": size, "too_large": size > max_bytes})


def entry_readiness(decisions: DataFrame, control_arm: str, now: Column, max_age: int, top: int) -> tuple[DataFrame, DataFrame]:
    """(latest control decision counts, most frequent blockers) over decisions not older than ``max_age``."""
    recent = decisions.filter((F.col("arm") == control_arm) & (now - F.col("ts") <= max_age))
    newest = latest(recent, ["token"], ["id"])
    skipped = newest.filter("action = 'SKIP'")
    counts = newest.agg(F.count("*").alias("tokens"), F.count_if(F.col("action") == "SKIP").alias("skipped"))
    blockers = (skipped.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
                .orderBy(F.desc("n"), "reason").limit(top))
    return counts, blockers


def feed_status(head: Column, cursor: Column, last_success: Column, now: Column, error: Column,
                max_age: int = 45, max_lag: int = 22) -> Column:
    """live / catching_up / error of a scanner."""
    return (F.when(error.isNotNull(), "error")
            .when(holds(now - last_success < max_age) & holds(head - cursor <= max_lag), "live").otherwise("catching_up"))


def follower_entry_reasons(rows: DataFrame, rules: FollowerRules = FollowerRules()) -> Column:
    """Entry reasons of a launch snapshot beyond the launch decision itself."""
    c = F.col
    premium = F.try_divide(F.lit(rules.position_size), c("quantity") * (1 - rules.slippage) * c("price")) - 1
    exit_value = c("usd_out") * (1 - rules.slippage) - rules.network_fee
    return failed([
        ("launch_older_than_15_minutes", c("launch_age") <= rules.max_launch_age),
        ("entry_premium_above_2_percent", premium <= rules.max_entry_premium),
        ("independent_exit_depth_failed", exit_value >= rules.position_size * rules.min_exit_fraction),
    ])


