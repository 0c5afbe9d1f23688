"""Rules of the domain jobs on hand-made rows."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from onledger.functions import wide
from onledger.bindings import RISK_FLAGS
from onledger.operators.rules import SCREENS, apply_screen
from onledger.params import FollowerRules, LaunchRules, ScreenRules, rules_hash
from onledger.plans import attribution as at
from onledger.plans import evidence as ev
from onledger.plans import followers as fo
from onledger.plans import ledger, portfolio, scoring, screens

T = 1000
BASE = dict(
    id=1, ts=T, now=T, token="0x" + "a" * 40, pool="0x" + "b" * 40, observed_at=T, launch_age=200, deployment_confirmed=True, pool_version=2,
    price=1.0, liquidity=50000.0, market_present=True, market_source="v2_reserves", market_at=T, market_block=100,
    market_hash="0x" + "c" * 64, lp_supply="1000", lp_burned=0.97, quote_present=True, quote_status="quoted", quote_quantity=2.0,
    quote_usd_in=1.995, quote_source="canonical_pool_quote", quote_block=100, quote_error=None, sim_status="passed", sim_source="eth_call",
    sim_at=T, sim_block=100, sim_error=None, buy_shortfall=0.0, sell_shortfall=0.0, roundtrip_loss=0.02, top10_share=0.2,
    holder_source="verified_transfer_ledger", holder_at=T, holder_block=100, buyers_present=True, distinct_buyers=5, qualified_buys=0,
    buyer_total=5, buyer_reviewed=5, buyer_pending=0, buyer_ambiguous=0, buyer_at=T, buyer_block=100, source_status="verified",
    source_provider="explorer", source_at=T, risk_checked_at=T, **{f: "pass" for f in RISK_FLAGS})
SCHEMA = ", ".join(
    f"{k} " + ("boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string")
    for k, v in BASE.items())


def documents(table, *changes):
    rows = [tuple({**BASE, "id": i, **c}[k] for k in BASE) for i, c in enumerate(changes)]
    return ev.assess(table(SCHEMA, rows))


def codes(row):
    return {f.code for f in row.findings}


def test_sound_document_and_zero_denominators(table):
    out = documents(table, {}, dict(lp_supply="0"), dict(buyer_total=0, buyer_reviewed=0), dict(buyer_total=9)).orderBy("id").collect()
    assert out[0].errors == [] and codes(out[0]) == {"UNRESOLVED_HOLDER_CLASSIFICATION", "SIMULATION_SCOPE"}
    ms = {m.metric_id: m for m in out[1].ms}
    assert ms["liquidity.lp_burned"].status == "undefined" and ms["liquidity.lp_burned"].number is None and out[1].errors == []
    cover = {m.metric_id: m for m in out[2].ms}["buyers.coverage"]
    assert (cover.status, cover.number, cover.reason) == ("undefined", None, "no_observed_transactions")
    assert out[3].errors == ["buyers: inconsistent coverage counts"] and codes(out[3]) == {"SCHEMA_INVALID"}


def test_score_is_full_only_with_fresh_evidence(table):
    rows = documents(table, dict(qualified_buys=1), dict(market_at=T - 500, observed_at=T - 500), dict(top10_share=1.5),
                     dict(source_status=None, source_provider=None, **{f: None for f in RISK_FLAGS}))
    out = scoring.candidate_score(ev.effective(rows)).orderBy("id").collect()
    assert out[0].score == 100.0 and {p.status for p in out[0].components} == {"met"}
    stale = {p.name: p for p in out[1].components}
    assert stale["Liquidity"].status == "unknown" and stale["Executable quote"].hundredths == 0
    assert out[2].score == 0.0  # an invalid document earns nothing
    assert {p.name: p.status for p in out[3].components}["Contract controls"] == "unknown"


def test_decision_precedence(table):
    changes = [dict(qualified_buys=1), dict(), dict(distinct_buyers=1), dict(launch_age=90000), dict(qualified_buys=1, pool_version=3)]
    rows = ev.effective(documents(table, *changes)).withColumn("risk_reasons", F.array().cast("array<string>"))
    out = scoring.decide(rows, LaunchRules()).orderBy("id").collect()
    assert [r.action for r in out] == ["MIRROR", "SNIPE", "SKIP", "SKIP", "SKIP"]
    assert out[2].reasons == ["insufficient_launch_or_wallet_signal"] and out[3].reasons == ["launch_too_old_or_unknown"]
    assert out[4].reasons == ["evidence_liquidity_lock_unresolved"]
    high = scoring.decide(rows.filter("id = 1"), LaunchRules(min_score=99.0)).collect()[0]
    assert (high.action, high.reasons) == ("SKIP", ["score_below_threshold"])
    none = scoring.decide(rows.filter("id = 0").withColumn("risk_reasons", F.lit(None).cast("array<string>"))).collect()[0]
    assert none.reasons == ["risk_unavailable"]


def test_screens_are_interchangeable_and_fail_closed(table):
    rows = table("token string, now long, chain string, standard_token boolean, mint_known boolean, mint_authority string, freeze_known boolean, "
                 "freeze_authority string, price double, observed_at long, liquidity double, volume_h24 double, age_seconds long, "
                 "top10_share double, buys_m5 long, sells_m5 long, change_m5 double",
                 [("t", 100, "solana", True, True, None, True, None, 1.0, 100, 3e4, 2e4, 4000, 0.3, 30, 10, 5.0),
                  ("t", 100, "solana", None, False, None, True, "k", None, 100, None, 2e4, 4000, float("nan"), None, 10, 5.0)])
    out = apply_screen("token", rows, ScreenRules()).collect()
    assert (out[0].score, out[0].reasons) == (82.0, []) and out[1].score == 0.0
    assert out[1].reasons == ["invalid_or_stale_quote", "unsupported_or_unknown_token_program", "mint_authority_active_or_unknown",
                              "freeze_authority_active_or_unknown", "liquidity_low_or_unknown", "top10_concentration_high_or_unknown",
                              "missing_activity"]
    assert set(SCREENS) >= {"token", "exchange", "launch"} and len(rules_hash(ScreenRules())) == 64


def test_rankings_see_only_the_past(table):
    schema = "tx long, wallet long, token long, leader_ts long, queued_at long, status string, ended_at long, completed_at long, return_fraction double, stress_return double, version int"
    rows = [(i, 1, i % 6, 10, 11, "complete", 50, 60, 0.1, None, 2) for i in range(10)]
    rows += [(90, 1, 1, 10, 11, "complete", 50, 100, 9.0, None, 2), (91, 1, 1, 10, 11, "complete", 50, 60, 9.0, None, 1),
             (92, 2, 1, 200, 201, "complete", 50, 60, 9.0, None, 2), (93, 3, 1, 10, 11, "unresolved", 50, 60, None, -1.0, 2)]
    out = {r.wallet: r for r in fo.follower_rankings(table(schema, rows), F.lit(100)).collect()}
    assert set(out) == {1, 3}
    assert (out[1].samples, out[1].observed_buys, out[1].tokens, out[1].mean_return, out[1].qualified) == (10, 12, 6, 0.1, True)
    assert (out[3].samples, out[3].mean_return, out[3].stressed_exits, out[3].qualified) == (0, None, 1, False)


def test_paths_gap_disqualifies_and_timeout_is_unresolved(table):
    rules = FollowerRules(step=30, max_hold=90, max_entry_gap=5, max_fx_age=10**6)
    def price_at(prices, token):
        return [(token, ts, i, p, f) for i, (ts, p, f) in enumerate(prices)]
    ok = [(100, 100, False), (130, 100, False), (160, 130, False)]
    gap = [(100, 100, False), (160, 130, False)]
    lost = [(100, 100, False), (130, 100, False), (160, 100, False)]
    failed = [(100, 100, True)]
    quotes = table("token string, quote_ts long, quote_id long, price long, failed boolean",
                   price_at(ok, "ok") + price_at(gap, "gap") + price_at(lost, "lost") + price_at(failed, "failed") + price_at([(110, 1, False)], "late"))
    cases = table("case_key string, token string, entry_target long", [(k, k, 100) for k in ("ok", "gap", "lost", "failed", "late")])
    candles = table("start long, rate double", [(60 * i, 0.01) for i in range(-3, 9)])
    out = {r.case_key: r for r in fo.replay_paths(cases, quotes, candles, 60, rules).collect()}
    assert (out["ok"].status, out["ok"].reason, out["ok"].ended_at, out["ok"].stress_return) == ("complete", "take_profit", 160, None)
    assert (out["gap"].status, out["gap"].reason, out["gap"].stress_return) == ("incomplete", "take_profit", -1.0)
    assert (out["lost"].status, out["lost"].ended_at, out["lost"].return_fraction, out["lost"].stress_return) == ("unresolved", 190, None, -1.0)
    assert out["failed"].status == "entry_rejected" and (out["late"].status, out["late"].stress_return) == ("unresolved", None)


def test_cohort_and_enrolment(table):
    flows = table("tx long, wallet string, token string, ts long, side string",
                  [(1, "w1", "t1", 1, "buy"), (2, "w1", "t1", 2, "buy"), (3, "w2", "t1", 3, "buy"), (4, "w1", "t2", 4, "buy"), (5, "w3", "t1", 9000, "buy")])
    none = table("tx long, wallet string, token string", [])
    cohort = fo.first_buy_cohort(flows, flows, none, F.lit(5000))
    assert rows_of(cohort, "tx") == [(1,), (3,), (4,)]
    swaps = table("tx long, token string, pool string, block long", [(1, "t1", "p", 5), (3, "t1", "p", 5), (3, "t1", "q", 5), (4, "t2", "r", 5)])
    pools = table("pool string, native0 boolean, native1 boolean, created_block long", [("p", True, False, 1), ("q", False, True, 1), ("r", True, True, 1)])
    out = fo.enroll(cohort.withColumnRenamed("ts", "leader_ts"), swaps, pools, table("tx long, seen_at double", [(1, 31.2)]))
    assert rows_of(out, "tx", "status", "entry_target") == [(1, "replaying", 32), (3, "unresolved", None), (4, "unresolved", None)]


def test_frames_prune_errors_and_find_the_deployer(table):
    tree = ('{"type":"CALL","from":"A","to":"R","value":"0x5","calls":[{"type":"CREATE2","from":"R","to":"tok","value":"0x1",'
            '"calls":[{"type":"CALL","from":"tok","to":"a","value":"0x2"}]},{"type":"CALL","from":"R","to":"a","value":"0x9","error":"x",'
            '"calls":[{"type":"CALL","from":"R","to":"a","value":"0x7"}]},{"type":"DELEGATECALL","from":"R","to":"a","value":"0x3"}]}')
    frames = at.flatten_frames(table("tx long, trace string", [(1, tree), (2, '{"error":"reverted","from":"a"}'), (3, None)]))
    from onledger.functions.decode import quantity
    assert rows_of(at.native_deltas(frames, quantity(F.col("value"))), "tx", "wallet", "delta") == [(1, "a", -3), (1, "r", 4), (1, "tok", -1)]
    assert rows_of(at.deployment_origins(frames), "tx", "token", "deployer", "initiator") == [(1, "tok", "r", "a")]


def test_approval_is_bound_to_pool_action_and_age(table):
    reviews = table("review_id long, token string, status string, action string, finished_at long, evidence_ts long, pool string",
                    [(1, "a", "complete", "SKIP", 900, 900, "p"), (2, "a", "complete", "MIRROR", 900, 900, "p"), (3, "b", "running", None, None, 900, "p"),
                     (4, "c", "complete", "MIRROR", 500, 500, "p")])
    rows = table("id long, token string, pool string, action string, now long",
                 [(1, "a", "p", "MIRROR", 1000), (2, "a", "q", "MIRROR", 1000), (3, "a", "p", "SNIPE", 1000), (4, "b", "p", "MIRROR", 1000),
                  (5, "c", "p", "MIRROR", 1000), (6, "d", "p", "MIRROR", 1000)])
    assert [r.gate for r in scoring.approval_gate(rows, reviews).orderBy("id").collect()] == [
        None, "review_pool_mismatch", "review_signal_no_longer_matches", "review_running", "review_stale", "review_pending"]


def test_holder_ledger_and_pool_prices(table):
    moves = table("token string, sender string, recipient string, amount long", [("t", "0x0", "a", 60), ("t", "0x0", "b", 40), ("t", "a", "b", 10), ("u", "x", "y", 1)])
    out = portfolio.holder_ledger(moves, table("token string, supply long", [("t", 100), ("u", 1), ("v", 0)])).orderBy("token").collect()
    assert (out[0].status, out[0].holders, out[0].top10_share) == ("reconciled", 2, 1.0)
    assert [r.reason for r in out] == [None, "negative_balance", "no_supply"]
    q = table("a long, i long, o long", [(100, 1000, 1000), (100, 0, 1000)])
    quote = portfolio.constant_product_quote(*[wide.of(F.col(n)) for n in ("a", "i", "o")])
    assert [r.v for r in q.select(wide.to_text(quote).alias("v")).collect()] == ["90", None]
    p = table("quote_reserve long, token_reserve long, decimals int, rate double, lp_supply long, lp_burned long", [(10**18, 10**18, 18, 2000.0, 0, 0)])
    r = portfolio.v2_state_metrics(p).collect()[0]
    assert (r.price, r.liquidity, r.lp_burned_fraction, r.lp_burn_status) == (pytest.approx(2000.0), 4000.0, None, "undefined")


def test_identity_conflicts_and_lp_rule(table):
    rows = table("n long, h string", [(1, "a"), (1, "b"), (2, "c")])
    assert rows_of(ledger.identity_conflicts([("block", rows, ["n"], F.col("h"))]), "conflict", "key", "variants") == [("block", "1", 2)]
    base = table("reasons array<string>, lp_burned double, version int, sim_status string, buy_shortfall double, sell_shortfall double, roundtrip_loss double, "
                 "source_status string, feed_current boolean",
                 [(["liquidity_withdrawal_risk_unresolved", "cannot_buy_unknown", "scanner_catching_up"], 0.5, 2, "passed", 0.0, 0.5, 0.0, None, True)])
    assert scoring.reconcile_reasons(base).collect()[0].settled == ["v2_lp_burn_below_95_percent", "simulated_sell_shortfall_above_limit"]


def test_failure_cause(table):
    df = table("m string", [("Pool has no reserves now",), ("timeout",), (None,)])
    assert [r.c for r in df.select(screens.failure_cause(F.col("m")).alias("c")).collect()] == ["execution_failure", "data_unavailable", None]
