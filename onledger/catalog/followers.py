"""Delayed-follower study."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.operators.aggregates import earliest
from onledger.params import FollowerRules
from onledger.plans import followers as fo

C = F.col
NOW = 985000000
AS_OF = 915148800
# day-granular inputs, so the waiting times are widened; every rule stays the same
COHORT = FollowerRules(max_hold=86400, entry_deadline=43200, exit_grace=43200)
PATHS = FollowerRules(step=7200, max_hold=86400, max_entry_gap=3600, max_fx_age=7200)
SIGNAL = FollowerRules(window=63072000)
RANKS = FollowerRules(min_samples=3, min_tokens=2, min_coverage=0.3)

COHORT_SQL = f""" u AS (SELECT tx, wallet, token, ts FROM flows WHERE side = 'buy' AND pool % 3 <> 0
   UNION SELECT tx, wallet, token, ts FROM flows WHERE side = 'buy' AND quantity > 10),
 f1 AS (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY ts, tx) AS rn FROM u WHERE ts < {NOW - 172800}),
 en AS (SELECT tx, wallet, token FROM flows WHERE side = 'buy' AND pool % 400 = 1),
 cohort AS (SELECT tx, wallet, token, ts FROM f1 WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM en WHERE en.wallet = f1.wallet
   AND en.token = f1.token) AND tx NOT IN (SELECT tx FROM en))"""


@query("pip_27_first_buy_cohort", "WITH" + COHORT_SQL + " SELECT tx, wallet, token, ts FROM cohort")
def first_buy_cohort(t):
    f = t.flows
    return fo.first_buy_cohort(f.filter("pool % 3 <> 0"), f.filter("quantity > 10"),
                               f.filter("side = 'buy' AND pool % 400 = 1"), F.lit(NOW), COHORT)


ENROLL_SQL = """ base AS (SELECT tx, origin AS wallet, min(token) AS token, min(ts) AS leader_ts FROM flows WHERE side = 'buy' GROUP BY tx, origin),
 pl AS (SELECT p_partkey AS pool, p_partkey % 3 = 0 AS native0, p_partkey % 4 = 1 AS native1, p_size * 40 AS created_block FROM part),
 sn AS (SELECT tx, ts + tx % 200 AS seen_at FROM (SELECT tx, min(ts) AS ts FROM flows WHERE side = 'buy' AND tx % 3 <> 0 GROUP BY tx) x),
 cd AS (SELECT s.tx, s.token, count(DISTINCT s.pool) AS n, min(s.pool) AS pool FROM swaps s JOIN pl USING (pool)
   WHERE native0 <> native1 AND created_block <= block GROUP BY s.tx, s.token),
 tg AS (SELECT b.*, CASE WHEN n = 1 THEN cd.pool END AS pool, greatest(leader_ts + 30, coalesce(seen_at, 0)) AS target
   FROM base b LEFT JOIN cd ON cd.tx = b.tx AND cd.token = b.token LEFT JOIN sn ON sn.tx = b.tx),
 enrolled AS (SELECT tx, wallet, token, leader_ts, pool, CASE WHEN pool IS NULL THEN 'unresolved' WHEN target > leader_ts + 120
     THEN 'entry_rejected' ELSE 'replaying' END AS status, CASE WHEN pool IS NULL THEN 'leader_pool_ambiguous_or_missing'
     WHEN target > leader_ts + 120 THEN 'observed_after_entry_deadline' END AS reason,
   CASE WHEN pool IS NOT NULL AND target <= leader_ts + 120 THEN target END AS entry_target,
   CASE WHEN pool IS NOT NULL AND target <= leader_ts + 120 THEN sha256('[2, "' || pool || '", ' || target || ']') END AS case_key FROM tg)"""


def enrolled(t):
    part = {n: t.sql("WITH" + ENROLL_SQL.split(",\n cd AS")[0] + f" SELECT * FROM {n}") for n in ("base", "pl", "sn")}
    return fo.enroll(part["base"], t.swaps, part["pl"], part["sn"])


@query("pip_28_enroll", "WITH" + ENROLL_SQL + " SELECT * FROM enrolled")
def enroll(t):
    return enrolled(t)


@query("pip_28_shared_cases", "WITH" + ENROLL_SQL + """
 SELECT case_key, min(token) AS token, min(pool) AS pool, min(entry_target) AS entry_target, CAST(count(*) AS BIGINT) AS members
 FROM enrolled WHERE case_key IS NOT NULL GROUP BY case_key""")
def shared_cases(t):
    return fo.replay_cases(enrolled(t))


PATH_INPUT = """ cs AS (SELECT quote_id AS case_key, token, ts + 30 AS entry_target FROM quotes),
 qt AS (SELECT token, ts AS quote_ts, quote_id, cents AS price, user_id % 50 = 7 AS failed FROM quotes),
 cn AS (SELECT start, close_cents / 10000.0E0 AS rate FROM candles WHERE start % 86400 <> 0)"""
PATH_SQL = PATH_INPUT + """,
 q1 AS (SELECT token, quote_ts, min_by(price, quote_id) AS price, min_by(failed, quote_id) AS failed FROM qt GROUP BY token, quote_ts),
 e0 AS (SELECT c.*, CASE WHEN q.quote_ts - c.entry_target <= 3600 THEN q.quote_ts END AS entry_at, q.price, q.failed
   FROM cs c ASOF LEFT JOIN q1 q ON c.token = q.token AND c.entry_target <= q.quote_ts),
 e1 AS (SELECT e0.*, CASE WHEN entry_at - (cn.start + 3600) BETWEEN 0 AND 7200 THEN cn.rate END AS rate FROM e0
   LEFT JOIN cn ON cn.start = IDIV(entry_at, 3600) * 3600 - 3600),
 e2 AS (SELECT *, CASE WHEN entry_at IS NOT NULL AND failed THEN 'entry_rejected' WHEN entry_at IS NULL OR rate IS NULL OR price * rate <= 0
     THEN 'unresolved' ELSE 'open' END AS state, floor(1.995::DOUBLE / (price * rate) * 1e6 * (1 - 0.01::DOUBLE)) AS qty FROM e1),
 s0 AS (SELECT case_key, token, entry_at, qty, unnest(generate_series(entry_at + 7200, entry_at + 86400, 7200)) AS due FROM e2
   WHERE state = 'open'),
 s1 AS (SELECT s.*, CASE WHEN q.quote_ts - s.due <= 3600 THEN q.quote_ts END AS stamp, q.price, q.failed
   FROM s0 s ASOF LEFT JOIN q1 q ON s.token = q.token AND s.due <= q.quote_ts),
 s2 AS (SELECT s1.*, CASE WHEN stamp - (cn.start + 3600) BETWEEN 0 AND 7200 THEN cn.rate END AS rate FROM s1
   LEFT JOIN cn ON cn.start = IDIV(stamp, 3600) * 3600 - 3600),
 s3 AS (SELECT *, CASE WHEN stamp IS NOT NULL AND NOT failed AND rate IS NOT NULL
   THEN greatest(0.0::DOUBLE, qty * price / 1e6 * rate * (1 - 0.01::DOUBLE) - 0.005::DOUBLE) END AS value FROM s2),
 s4 AS (SELECT *, CASE WHEN value <= 2 * (1 - 0.08::DOUBLE) THEN 'stop_loss' WHEN value >= 2 * (1 + 0.2::DOUBLE) THEN 'take_profit'
   WHEN value IS NOT NULL AND stamp - entry_at >= 86400 THEN 'time_exit' END AS why FROM s3),
 h AS (SELECT case_key, min(CASE WHEN why IS NOT NULL THEN due END) AS hit, min(CASE WHEN value IS NULL THEN due END) AS gap
   FROM s4 GROUP BY case_key)
 SELECT e2.case_key, e2.token, e2.entry_target, e2.entry_at, CASE WHEN state <> 'open' THEN state WHEN hit IS NULL THEN 'unresolved'
   WHEN gap < hit THEN 'incomplete' ELSE 'complete' END AS status, s4.why AS reason,
   CASE WHEN hit IS NOT NULL THEN s4.stamp WHEN state = 'open' THEN e2.entry_at + 86400 END AS ended_at,
   s4.value / 2 - 1 AS return_fraction,
   CASE WHEN state = 'open' AND (hit IS NULL OR gap < hit) THEN -1.0::DOUBLE END AS stress_return
 FROM e2 LEFT JOIN h USING (case_key) LEFT JOIN s4 ON s4.case_key = e2.case_key AND s4.due = h.hit"""


@query("pip_29_replay_paths", "WITH" + PATH_SQL)
def replay_paths(t):
    cs, qt, cn = (t.sql("WITH" + PATH_INPUT + f" SELECT * FROM {n}") for n in ("cs", "qt", "cn"))
    return fo.replay_paths(cs, qt, cn, 3600, PATHS)


COST_INPUT = """SELECT id, quote_status, quote_block, quote_usd_in AS usd_in, quote_usd_out AS usd_out, quote_quantity, sim_status, sim_block,
   buy_shortfall, sell_shortfall, roundtrip_loss, price, id * 37 % 1000 AS received, id % 900 + 50 AS exit_output,
   CASE WHEN id % 12 <> 0 THEN (id % 7) / 400.0E0 END AS rate, observed_at, ts AS assessed_at, ts + 60 AS now, market_block AS block,
   market_hash AS block_hash FROM observed"""


@query("pip_30_cost_model", f"""
 WITH i AS ({COST_INPUT}),
 k AS (SELECT *, CAST(floor(received * (1 - 0.01::DOUBLE)) AS BIGINT) AS quantity,
   CASE WHEN quote_quantity * (1 - 0.01::DOUBLE) * price <> 0 THEN 2.0::DOUBLE / (quote_quantity * (1 - 0.01::DOUBLE) * price) - 1 END AS premium,
   CASE WHEN rate IS NOT NULL AND sell_shortfall IS NOT NULL
     THEN greatest(0.0::DOUBLE, exit_output::DOUBLE * rate * (1 - sell_shortfall) * (1 - 0.01::DOUBLE) - 0.005::DOUBLE) END AS net_exit FROM i)
 SELECT id, quantity, round(premium, 9) AS premium, round(net_exit, 9) AS net_exit, concat_ws(',',
   CASE WHEN block IS NULL OR block_hash IS NULL OR observed_at IS NULL THEN 'quote_provenance_missing' END,
   CASE WHEN NOT coalesce(abs(assessed_at - observed_at) <= 120 AND now - greatest(assessed_at, observed_at) BETWEEN 0 AND 120, false)
     THEN 'quote_stale' END,
   CASE WHEN NOT coalesce(quote_status = 'quoted' AND sim_status = 'passed', false) THEN 'entry_quote_or_simulation_missing' END,
   CASE WHEN NOT coalesce(abs(usd_in - 1.995::DOUBLE) <= 1e-6, false) THEN 'entry_size_mismatch' END,
   CASE WHEN NOT coalesce(buy_shortfall <= 0.03 AND sell_shortfall <= 0.03 AND roundtrip_loss <= 0.1, false)
     THEN 'entry_simulation_costs_failed' END,
   CASE WHEN quantity <= 0 THEN 'entry_quantity_zero' END,
   CASE WHEN NOT coalesce(quote_block = block AND sim_block = block, false) THEN 'quote_block_mismatch' END,
   CASE WHEN NOT coalesce(rate > 0, false) THEN 'usd_reference_invalid' END,
   CASE WHEN NOT coalesce(premium <= 0.02::DOUBLE, false) THEN 'entry_premium_above_2_percent' END,
   CASE WHEN NOT coalesce(net_exit >= 2 * 0.9::DOUBLE, false) THEN 'independent_exit_depth_failed' END) AS reasons FROM k""")
def cost_model(t):
    return fo.cost_model(t.sql(COST_INPUT)).select(
        "id", "quantity", F.round("premium", 9).alias("premium"), F.round("net_exit", 9).alias("net_exit"),
        F.array_join("reasons", ",").alias("reasons"))


RANK_SQL = f""" k AS (SELECT *, version = 2 AND completed_at < {AS_OF} AND ended_at < {AS_OF} AND (return_bp IS NOT NULL OR stress_bp IS NOT NULL) AS use
   FROM samples WHERE leader_ts < {AS_OF} AND queued_at < {AS_OF}),
 g AS (SELECT wallet, count(CASE WHEN use AND status = 'complete' AND return_bp IS NOT NULL THEN 1 END) AS samples, count(*) AS observed_buys,
   count(DISTINCT CASE WHEN use AND status = 'complete' AND return_bp IS NOT NULL THEN token END) AS tokens,
   sum(CASE WHEN use THEN coalesce(stress_bp, return_bp) END) AS total, count(CASE WHEN use THEN 1 END) AS n,
   count(CASE WHEN use AND coalesce(stress_bp, return_bp) > 0 THEN 1 END) AS wins,
   count(CASE WHEN use AND stress_bp IS NOT NULL THEN 1 END) AS stressed_exits,
   median(CASE WHEN use THEN coalesce(stress_bp, return_bp) END) AS med,
   sum(CASE WHEN use AND status = 'complete' THEN return_bp END) AS mtotal FROM k GROUP BY wallet),
 ranked AS (SELECT wallet, samples, observed_buys, tokens, samples / observed_buys::DOUBLE AS coverage,
   CASE WHEN samples > 0 THEN total / 10000.0::DOUBLE / n END AS mean_return, CASE WHEN samples > 0 THEN med / 10000.0::DOUBLE END AS median_return,
   CASE WHEN samples > 0 THEN mtotal / 10000.0::DOUBLE / samples END AS measured_mean_return, wins, stressed_exits,
   coalesce(samples >= 3 AND tokens >= 2 AND samples / observed_buys::DOUBLE >= 0.3 AND wins / n::DOUBLE >= 0.55
     AND total / 10000.0::DOUBLE / n >= 0.02 AND med > 0, false) AS qualified FROM g)"""
RANK_COLUMNS = ["coverage", "mean_return", "median_return", "measured_mean_return"]


def ranked(t):
    rows = t.samples.withColumns({"return_fraction": C("return_bp") / 10000.0, "stress_return": C("stress_bp") / 10000.0})
    return fo.follower_rankings(rows, F.lit(AS_OF), RANKS)


@query("pip_31_follower_rankings", "WITH" + RANK_SQL + """
 SELECT wallet, samples, observed_buys, tokens, round(coverage, 9) AS coverage, round(mean_return, 9) AS mean_return,
   round(median_return, 9) AS median_return, round(measured_mean_return, 9) AS measured_mean_return, wins, stressed_exits, qualified
 FROM ranked""")
def follower_rankings(t):
    return ranked(t).withColumns({c: F.round(c, 9) for c in RANK_COLUMNS})


@query("pip_31_top_ranked", "WITH" + RANK_SQL + """
 SELECT wallet, qualified, samples, round(mean_return, 9) AS mean_return FROM ranked
 ORDER BY qualified DESC, samples DESC, coalesce(round(mean_return, 9), -10) DESC, wallet LIMIT 25""")
def top_ranked(t):
    rows = ranked(t).withColumn("mean_return", F.round("mean_return", 9))
    return rows.orderBy(*fo.ranking_order()).limit(25).select("wallet", "qualified", "samples", "mean_return")


SIGNAL_INPUT = """ an AS (SELECT p_partkey AS id, p_brand AS token, p_partkey AS pool, 946684800 + (p_partkey % 10) * 8640000 AS anchor_at FROM part),
 ev AS (SELECT tx, token, pool, ts, CASE WHEN side = 'buy' THEN quote_amount ELSE -quote_amount END AS signed_quote, tx % 61 <> 0 AS evidence_ok
   FROM swaps),
 cr AS (SELECT token, deployer, initiator, CASE WHEN deployer % 4 <> 0 THEN 'verified' ELSE 'not_found' END AS status FROM creators),
 rk AS (SELECT DISTINCT wallet, 930000000 AS available_before FROM samples WHERE wallet % 3 = 0)"""
FIRST_FLOW = """SELECT tx, wallet % 25 AS wallet, token, ts, ts + tx % 100 AS seen_at, side, quote_amount AS quote, origin % 30 AS origin FROM swaps"""
SIGNAL_SQL = SIGNAL_INPUT + f""",
 fl AS (SELECT * EXCLUDE (rn) FROM (SELECT f.*, row_number() OVER (PARTITION BY tx ORDER BY token, ts, wallet, side, quote) AS rn
   FROM ({FIRST_FLOW}) f) WHERE rn = 1),
 e AS (SELECT an.id, an.token, an.anchor_at, ev.tx, ev.signed_quote, ev.evidence_ok FROM ev JOIN an USING (token, pool)
   WHERE ev.ts BETWEEN anchor_at - 63072000 AND anchor_at),
 nt AS (SELECT id, CASE WHEN bool_and(evidence_ok) THEN sum(signed_quote) END AS net, bool_and(evidence_ok) AS proven,
   count(DISTINCT tx) AS observed FROM e GROUP BY id),
 ro AS (SELECT x.id, fl.* FROM fl JOIN (SELECT DISTINCT id, token, anchor_at, tx FROM e) x ON x.tx = fl.tx AND x.token = fl.token
   WHERE fl.ts BETWEEN x.anchor_at - 63072000 AND x.anchor_at AND fl.seen_at <= x.anchor_at),
 atr AS (SELECT id, sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END) AS anet, count(DISTINCT tx) AS atx FROM ro GROUP BY id),
 by1 AS (SELECT ro.*, row_number() OVER (PARTITION BY id ORDER BY ts, tx) AS i FROM ro WHERE side = 'buy' AND NOT EXISTS (
   SELECT 1 FROM cr WHERE cr.token = ro.token AND (ro.wallet IN (deployer, initiator) OR ro.origin IN (deployer, initiator)))),
 gr AS (SELECT id, i, wallet, origin, ts, true AS ok, [wallet] AS ws, [origin] AS os FROM by1 WHERE i = 1
   UNION ALL SELECT b.id, b.i, b.wallet, b.origin, b.ts, NOT list_contains(ws, b.wallet) AND NOT list_contains(os, b.origin),
     CASE WHEN NOT list_contains(ws, b.wallet) AND NOT list_contains(os, b.origin) THEN list_append(ws, b.wallet) ELSE ws END,
     CASE WHEN NOT list_contains(ws, b.wallet) AND NOT list_contains(os, b.origin) THEN list_append(os, b.origin) ELSE os END
   FROM gr JOIN by1 b ON b.id = gr.id AND b.i = gr.i + 1),
 bu AS (SELECT id, count(*) AS buyers, count(CASE WHEN rk.available_before < gr.ts THEN 1 END) AS qualified FROM gr
   LEFT JOIN rk ON rk.wallet = gr.wallet WHERE ok GROUP BY id),
 sg AS (SELECT an.*, CASE WHEN proven IS NULL THEN 0 ELSE net END AS net, proven, coalesce(observed, 0) AS observed, coalesce(anet, 0) AS anet,
   coalesce(atx, 0) AS atx, coalesce(buyers, 0) AS buyers, coalesce(qualified, 0) AS qualified, cr.status
   FROM an LEFT JOIN nt USING (id) LEFT JOIN atr USING (id) LEFT JOIN bu USING (id) LEFT JOIN cr ON cr.token = an.token)
 SELECT id, CAST(net AS BIGINT) AS net, CAST(anet AS BIGINT) AS attributed_net, observed AS observed_transactions, atx AS attributed_transactions,
   buyers, qualified AS qualified_wallets, concat_ws(',', CASE WHEN status IS DISTINCT FROM 'verified' THEN 'creator_identity_unresolved' END,
   CASE WHEN NOT coalesce(proven, true) THEN 'pool_flow_evidence_missing' END,
   CASE WHEN NOT (anchor_at - 1000000000 BETWEEN -15 AND 30) THEN 'trade_feed_stale' END,
   CASE WHEN NOT coalesce(net > 0, false) THEN 'verified_net_buying_not_positive' END,
   CASE WHEN buyers < 2 THEN 'fewer_than_two_distinct_buyers' END) AS reasons FROM sg"""


@query("pip_32_momentum_signal", "WITH RECURSIVE" + SIGNAL_SQL)
def momentum_signal(t):
    an, evs, cr, rk = (t.sql("WITH" + SIGNAL_INPUT + f" SELECT * FROM {n}") for n in ("an", "ev", "cr", "rk"))
    flows = earliest(t.sql(FIRST_FLOW), ["tx"], ["token", "ts", "wallet", "side", "quote"])
    out = fo.momentum_signal(an, evs, flows, cr, rk, F.lit(1000000000), SIGNAL)
    return out.select("id", "net", "attributed_net", "observed_transactions", "attributed_transactions", "buyers",
                      "qualified_wallets", F.array_join("reasons", ",").alias("reasons"))


@query("pip_43_focus_wallets", """
 SELECT wallet, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT token) AS BIGINT) AS tokens,
   CAST(sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
   CAST(sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) AS BIGINT) AS measured, min(leader_ts) AS first_leader_ts
 FROM samples GROUP BY wallet HAVING count(*) >= 10 AND count(DISTINCT token) >= 5 AND sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) > 0""")
def focus_wallets(t):
    return fo.focus_wallets(t.samples)
