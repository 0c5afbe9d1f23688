"""Filters, predicates and screens."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.functions.guards import freshness
from onledger.operators.aggregates import latest
from onledger.operators.rules import apply_screen
from onledger.params import MAX_AGE_SECONDS, SOURCE_MAX_AGE_SECONDS, ScreenRules
from onledger.plans import screens



@query("flt_01_freshness", """
 SELECT id, CASE WHEN observed_at IS NULL THEN 'unknown' WHEN ts + 20 - observed_at BETWEEN -15 AND 120 THEN 'fresh'
     ELSE 'stale' END AS quote_state,
   CASE WHEN risk_checked_at IS NULL THEN 'unknown' WHEN ts + 3500 - risk_checked_at BETWEEN -15 AND 3600 THEN 'fresh'
     ELSE 'stale' END AS source_state FROM assessments""")
def fresh(t):
    return t.assessments.select(
        "id", freshness(F.col("ts") + 20, F.col("observed_at"), MAX_AGE_SECONDS).alias("quote_state"),
        freshness(F.col("ts") + 3500, F.col("risk_checked_at"), SOURCE_MAX_AGE_SECONDS).alias("source_state"))


TOKEN_SCREEN = """ m AS (SELECT *, buys_m5 IS NOT NULL AND sells_m5 IS NOT NULL AND change_m5 IS NOT NULL AND change_m5 >= -100
     AS active, CAST(buys_m5 + sells_m5 AS DOUBLE) AS c,
   CASE WHEN buys_m5 + sells_m5 = 0 THEN 0 ELSE buys_m5::DOUBLE / (buys_m5 + sells_m5) END AS ratio FROM snapshots),
 s AS (SELECT *, CASE WHEN active THEN round(40 * least(c / 50, 1) + 40 * ratio
     + CASE WHEN change_m5 > 0 AND change_m5 <= 30 THEN 20 ELSE 0 END, 2) ELSE 0.0::DOUBLE END AS score FROM m),
 screened AS (SELECT id, score, concat_ws(',',
   CASE WHEN NOT coalesce(price > 0 AND now - observed_at BETWEEN -15 AND 120, false) THEN 'invalid_or_stale_quote' END,
   CASE WHEN chain <> 'solana' THEN 'unsupported_chain' END,
   CASE WHEN standard_token IS DISTINCT FROM true THEN 'unsupported_or_unknown_token_program' END,
   CASE WHEN NOT mint_known OR mint_authority IS NOT NULL THEN 'mint_authority_active_or_unknown' END,
   CASE WHEN NOT freeze_known OR freeze_authority IS NOT NULL THEN 'freeze_authority_active_or_unknown' END,
   CASE WHEN liquidity IS NULL OR liquidity < 25000 THEN 'liquidity_low_or_unknown' END,
   CASE WHEN volume_h24 IS NULL OR volume_h24 < 10000 THEN 'volume_h24_low_or_unknown' END,
   CASE WHEN age_seconds IS NULL OR age_seconds < 3600 THEN 'age_seconds_low_or_unknown' END,
   CASE WHEN top10_share IS NULL OR top10_share > 0.5 THEN 'top10_concentration_high_or_unknown' END,
   CASE WHEN NOT active THEN 'missing_activity' END,
   CASE WHEN active AND (c < 20 OR ratio < 0.55 OR change_m5 <= 0 OR change_m5 > 30) THEN 'weak_or_overheated_momentum' END,
   CASE WHEN active AND score < 65 THEN 'score_below_threshold' END) AS reasons FROM s)"""


@query("flt_02_token_screen", "WITH" + TOKEN_SCREEN + """
 SELECT id, score, reasons, reasons = '' AS passed FROM screened""")
def token_screen(t):
    return apply_screen("token", t.snapshots, ScreenRules()).select(
        "id", "score", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("passed"))


EXCHANGE_SCREEN = """ x AS (SELECT *, sma_fast IS NOT NULL AND sma_slow IS NOT NULL AND sma_slow <> 0
     AND rising_fraction IS NOT NULL AND rising_fraction <= 1 AS known FROM tickers),
 y AS (SELECT *, CASE WHEN known THEN round(50 + 50 * rising_fraction, 2) ELSE 0.0::DOUBLE END AS xscore FROM x),
 traded AS (SELECT id, xscore AS score, concat_ws(',',
   CASE WHEN venue <> 'coinbase' OR token NOT IN ('BTC-USD', 'ETH-USD', 'SOL-USD') THEN 'unsupported_exchange_product' END,
   CASE WHEN NOT coalesce(price > 0 AND now - observed_at BETWEEN -15 AND 120, false) THEN 'invalid_or_stale_quote' END,
   CASE WHEN spread_bps IS NULL OR spread_bps > 20 THEN 'spread_high_or_unknown' END,
   CASE WHEN volume_h24 IS NULL OR volume_h24 < 10000 THEN 'volume_low_or_unknown' END,
   CASE WHEN candle_end IS NULL OR now - candle_end NOT BETWEEN 0 AND 120 THEN 'stale_or_incomplete_candles' END,
   CASE WHEN NOT known THEN 'missing_trend' END,
   CASE WHEN known AND (sma_fast / sma_slow < 1.0005::DOUBLE OR rising_fraction < 0.5) THEN 'weak_trend' END,
   CASE WHEN known AND xscore < 65 THEN 'score_below_threshold' END) AS reasons FROM y)"""


@query("flt_03_exchange_screen", "WITH" + EXCHANGE_SCREEN + """
 SELECT id, score, reasons FROM traded""")
def exchange_screen(t):
    return apply_screen("exchange", t.tickers, ScreenRules()).select(
        "id", "score", F.array_join("reasons", ",").alias("reasons"))


@query("flt_04_retention", """
 WITH n AS (SELECT max(ts) AS now FROM assessments),
  seen AS (SELECT token, max(ts) AS last_seen FROM assessments GROUP BY token),
  held AS (SELECT DISTINCT wallet AS token FROM samples WHERE status = 'queued' AND tx % 50 = 0)
 SELECT token, last_seen, token IN (SELECT token FROM held) AS held FROM seen, n
 WHERE last_seen >= now - 5184000 OR token IN (SELECT token FROM held)""")
def retention(t):
    now = t.assessments.select(F.max("ts")).scalar()
    held = t.samples.filter("status = 'queued' AND tx % 50 = 0").select(F.col("wallet").alias("token"))
    return screens.retain(t.assessments, held, "token", "ts", now, 5184000)


MARKED = """SELECT tx, log_index, pool, wallet, block, tx % 97 = 0 AS removed,
  block * 31 + CASE WHEN tx % 53 = 0 THEN 1 ELSE 0 END AS log_hash FROM swap_keys"""


@query("flt_05_quarantine", f"""
 WITH m AS ({MARKED}), h AS (SELECT block, min(block * 31) AS header_hash FROM swap_keys WHERE block % 101 <> 5 GROUP BY block)
 SELECT m.tx, m.log_index, m.pool, m.wallet, CASE WHEN removed AND log_hash IS DISTINCT FROM header_hash
     THEN 'removed,inconsistent_hash' WHEN removed THEN 'removed'
     WHEN log_hash IS DISTINCT FROM header_hash THEN 'inconsistent_hash' ELSE 'good' END AS verdict
 FROM m LEFT JOIN h ON m.block = h.block""")
def quarantine(t):
    headers = t.sql("SELECT block, min(block * 31) AS header_hash FROM swap_keys WHERE block % 101 <> 5 GROUP BY block")
    rows = t.sql(MARKED).join(headers, "block", "left")
    good, bad = screens.quarantine(rows, [("removed", ~F.col("removed")),
                                          ("inconsistent_hash", F.col("log_hash") == F.col("header_hash"))])
    cols = ["tx", "log_index", "pool", "wallet"]
    return good.select(*cols, F.lit("good").alias("verdict")).unionByName(
        bad.select(*cols, F.array_join("rejected_for", ",").alias("verdict")))


@query("flt_06_known_creators", """
 SELECT f.tx, f.log_index, f.pool, f.token, f.wallet, f.origin FROM flows f WHERE f.side = 'buy' AND NOT EXISTS (
   SELECT 1 FROM creators c WHERE c.token = f.token AND (f.wallet IN (c.deployer, c.initiator)
     OR f.origin IN (c.deployer, c.initiator)))""")
def known_creators(t):
    known = t.creators.select("token", F.explode(F.array_distinct(F.array("deployer", "initiator"))).alias("who"))
    out = t.flows.filter("side = 'buy'")
    for col in ("wallet", "origin"):
        out = out.join(known.withColumnRenamed("who", col), ["token", col], "left_anti")
    return out.select("tx", "log_index", "pool", "token", "wallet", "origin")


@query("flt_07_excluded_addresses", """
 WITH c AS (SELECT DISTINCT tx, who FROM (SELECT tx, wallet AS who FROM swap_keys UNION ALL SELECT tx, origin FROM txs))
 SELECT tx, who FROM c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.who AND s.s_nationkey = 7)
   AND NOT EXISTS (SELECT 1 FROM swap_keys k WHERE k.tx = c.tx AND k.pool = c.who)""")
def excluded_addresses(t):
    who = t.swap_keys.select("tx", F.col("wallet").alias("who")).unionByName(
        t.txs.select("tx", F.col("origin").alias("who"))).distinct()
    routers = t.supplier.filter("s_nationkey = 7").select(F.col("s_suppkey").alias("who"))
    pools = t.swap_keys.select("tx", F.col("pool").alias("who"))
    return who.join(routers, "who", "left_anti").join(pools, ["tx", "who"], "left_anti").select("tx", "who")


@query("flt_08_search_latest", """
 WITH r AS (SELECT a.*, row_number() OVER (PARTITION BY token ORDER BY id DESC) AS rn FROM assessments a)
 SELECT c.c_custkey AS token, c.c_name AS name, r.id, r.ts FROM r JOIN customer c ON c.c_custkey = r.token
 WHERE rn = 1 AND lower(c.c_name || ' ' || c.c_mktsegment) LIKE '%build%'""")
def search_latest(t):
    found = t.customer.filter(
        F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).like("%build%")).select(
        F.col("c_custkey").alias("token"), F.col("c_name").alias("name"))
    newest = latest(t.assessments.select("token", "id", "ts"), ["token"], ["id"])
    return found.join(newest, "token")


MESSAGES = """SELECT quote_id, CASE user_id % 6 WHEN 0 THEN 'Pool has no reserves at block ' || TEXT(quote_id)
  WHEN 1 THEN 'Historical FX candle unavailable' WHEN 2 THEN 'Round-trip simulation reverted'
  WHEN 3 THEN 'entry_quantity_zero' WHEN 4 THEN 'Target block not indexed yet' END AS message FROM quotes"""


@query("flt_09_failure_cause", f"""
 SELECT quote_id, CASE WHEN message IS NULL THEN NULL WHEN starts_with(message, 'Pool has no reserves')
   OR message IN ('Round-trip simulation reverted', 'entry_quantity_zero') THEN 'execution_failure'
   ELSE 'data_unavailable' END AS cause FROM ({MESSAGES}) m""")
def failure_cause(t):
    return t.sql(MESSAGES).select("quote_id", screens.failure_cause(F.col("message")).alias("cause"))


@query("udf_01_registered_screens", "WITH" + TOKEN_SCREEN + "," + EXCHANGE_SCREEN + """
 SELECT 'token' AS screen, CAST(count(*) AS BIGINT) AS seen, CAST(sum(CASE WHEN reasons = '' THEN 1 ELSE 0 END) AS BIGINT)
   AS passed FROM screened
 UNION ALL SELECT 'exchange', count(*), CAST(sum(CASE WHEN reasons = '' THEN 1 ELSE 0 END) AS BIGINT) FROM traded""")
def registered_screens(t):
    parts = [apply_screen(name, rows, ScreenRules()).agg(F.count("*").alias("seen"), F.count_if(F.size("reasons") == 0).alias("passed"))
             .select(F.lit(name).alias("screen"), "seen", "passed")
             for name, rows in (("token", t.snapshots), ("exchange", t.tickers))]
    return parts[0].unionByName(parts[1])
