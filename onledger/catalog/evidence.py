"""Evidence documents, risk, score, decisions and gates."""

from pyspark.sql import functions as F

from onledger.bindings import RISK_FLAGS
from onledger.catalog import query
from onledger.functions.decode import BURN_ADDRESS, ZERO_ADDRESS
from onledger.operators import joins
from onledger.operators.rules import apply_screen
from onledger.params import LaunchRules
from onledger.plans import evidence as ev
from onledger.plans import scoring

C = F.col

# ---- check: the documents once more as plain rows, one SELECT per metric ---------------------------------------------
_MKT = "market_source", "CASE WHEN market_present THEN coalesce(market_at, observed_at) END", "market_block", "market_hash"
_QUO = "quote_source", _MKT[1], "quote_block", "market_hash"
_SIM = ("sim_source", "coalesce(sim_at, CASE WHEN sim_status IS NOT NULL AND sim_block = market_block THEN observed_at END)",
        "sim_block", "NULL")
_HLD = "holder_source", "holder_at", "holder_block", "NULL"
_BUY = ("CASE WHEN buyers_present THEN 'receipt_and_call_trace' END",
        "coalesce(buyer_at, CASE WHEN buyers_present AND buyer_block = market_block THEN observed_at END)", "buyer_block", "NULL")
_NONE = "NULL", "NULL", "NULL", "NULL"
_INC = "coalesce(buyer_pending > 0 OR buyer_ambiguous > 0, false)"
_OTHER = ("coalesce(coalesce(pool_version, CASE WHEN market_source LIKE 'v3\\_%' ESCAPE '\\' THEN 3 WHEN market_source LIKE "
          "'v4\\_%' ESCAPE '\\' THEN 4 WHEN market_source = 'v2_reserves' THEN 2 END) IN (3, 4), false)")
_ZERO = f"(NOT {_OTHER} AND coalesce(lp_supply = '0', false))"


def _metric(name):
    """(number, flag, text, metadata, status override, reason override) as SQL."""
    n, f, x, meta, st, rs = "NULL", "NULL", "NULL", _NONE, "NULL", "NULL"
    if name.startswith("market."):
        n, meta = name.split(".")[1], _MKT
    elif name.startswith("quote."):
        n, meta, rs = f"CASE WHEN quote_status = 'quoted' THEN quote_{name.split('.')[1]} END", _QUO, "quote_error"
    elif name == "simulation.passed":
        f, meta = "CASE WHEN sim_status = 'passed' THEN true END", _SIM
        st, rs = "CASE WHEN sim_status = 'failed' THEN 'error' END", "sim_error"
    elif name.startswith("simulation."):
        n, meta = f"CASE WHEN sim_status = 'passed' THEN {name.split('.')[1]} END", _SIM
    elif name == "holders.raw_top10":
        n, meta = "top10_share", _HLD
    elif name == "holders.adjusted_top10":
        rs = "'address_classification_unresolved'"
    elif name in ("buyers.distinct", "buyers.qualified"):
        n, meta = {"buyers.distinct": "distinct_buyers", "buyers.qualified": "qualified_buys"}[name], _BUY
        st = f"CASE WHEN {_INC} AND {n} IS NOT NULL THEN 'partial' END"
        rs = f"CASE WHEN {_INC} THEN 'pending_or_ambiguous_transactions' END"
    elif name == "buyers.coverage":
        n, meta = "CASE WHEN buyer_total <> 0 THEN buyer_reviewed / buyer_total::DOUBLE END", _BUY
        st, rs = "CASE WHEN buyer_total = 0 THEN 'undefined' END", "CASE WHEN buyer_total = 0 THEN 'no_observed_transactions' END"
    elif name.startswith("buyers."):
        n, meta = f"buyer_{name.split('.')[1]}", _BUY
    elif name == "liquidity.lp_supply":
        x, meta = f"CASE WHEN NOT {_OTHER} THEN lp_supply END", _MKT
        st, rs = f"CASE WHEN {_OTHER} THEN 'not_applicable' END", f"CASE WHEN {_OTHER} THEN 'not_a_v2_pool' END"
    elif name == "liquidity.lp_burned":
        n, meta = f"CASE WHEN NOT {_OTHER} AND NOT {_ZERO} THEN lp_burned END", _MKT
        st = f"CASE WHEN {_OTHER} THEN 'not_applicable' WHEN {_ZERO} THEN 'undefined' END"
        rs = f"CASE WHEN {_OTHER} THEN 'not_a_v2_pool' WHEN {_ZERO} THEN 'zero_lp_supply' END"
    elif name == "source.verified":
        f = "CASE source_status WHEN 'verified' THEN true WHEN 'unverified' THEN false END"
        meta = "source_provider", "source_at", "NULL", "NULL"
    else:
        flag = name.split(".")[1]
        f = f"CASE {flag} WHEN 'pass' THEN false WHEN 'fail' THEN true END"
        meta = "'goplus'", "risk_checked_at", "NULL", "NULL"
    return n, f, x, meta, st, rs


def _rows():
    out = []
    for i, (name, kind, unit, low, high) in enumerate(ev.CATALOGUE):
        n, f, x, (src, obs, blk, hsh), st, rs = _metric(name)
        out.append(
            f"SELECT id, ts, token, {i} AS pos, '{name}' AS metric_id, '{kind}' AS kind, '{unit}' AS unit,"
            f" {'NULL' if low is None else low}::DOUBLE AS lo, {'NULL' if high is None else high}::DOUBLE AS hi,"
            f" ({n})::DOUBLE AS num, ({f})::BOOLEAN AS flg, ({x})::VARCHAR AS txt, ({src})::VARCHAR AS src,"
            f" ({obs})::DOUBLE AS obs, ({blk})::BIGINT AS blk, ({hsh})::VARCHAR AS hsh, ({st})::VARCHAR AS st,"
            f" ({rs})::VARCHAR AS rs FROM observed")
    return "\n UNION ALL ".join(out)


BUILT = f""" raw AS ({_rows()}),
 l0 AS (SELECT *, num IS NOT NULL OR flg IS NOT NULL OR txt IS NOT NULL AS has FROM raw),
 l1 AS (SELECT *, coalesce(st, CASE WHEN NOT has THEN 'missing' WHEN src IS NOT NULL AND obs IS NOT NULL THEN 'measured'
   ELSE 'partial' END) AS status FROM l0),
 built AS (SELECT *, CASE WHEN status <> 'measured' THEN coalesce(rs, CASE WHEN has THEN 'provenance_incomplete'
   ELSE 'not_observed' END) ELSE rs END AS reason FROM l1)"""

CHECKED = BUILT + """,
 own AS (SELECT id, metric_id || ': ' || e AS err FROM (SELECT id, metric_id, unnest([
   CASE WHEN has AND kind IN ('number', 'integer') AND (num < lo OR num > hi) THEN 'out of range' END,
   CASE WHEN metric_id = 'liquidity.lp_supply' AND NOT regexp_full_match(txt, '[0-9]+') THEN 'invalid atomic amount' END,
   CASE WHEN blk < 0 THEN 'invalid block number' END,
   CASE WHEN hsh IS NOT NULL AND blk IS NULL THEN 'block hash requires block number' END,
   CASE WHEN hsh IS NOT NULL AND NOT regexp_full_match(hsh, '0x[0-9a-fA-F]{64}') THEN 'invalid block hash' END,
   CASE WHEN status = 'measured' AND (src IS NULL OR obs IS NULL) THEN 'measured value requires provenance' END]) AS e FROM built)
   WHERE e IS NOT NULL
  UNION ALL SELECT id, 'Invalid token' FROM observed WHERE NOT regexp_full_match(token, '0x[0-9a-f]{40}')),
 bad AS (SELECT DISTINCT id FROM own),
 bp AS (SELECT id, max(CASE WHEN metric_id = 'buyers.total' THEN num END) AS total, max(CASE WHEN metric_id = 'buyers.reviewed'
     THEN num END) AS reviewed, max(CASE WHEN metric_id = 'buyers.pending' THEN num END) AS pending,
   max(CASE WHEN metric_id = 'buyers.ambiguous' THEN num END) AS ambiguous FROM built GROUP BY id),
 crossed AS (SELECT id, 'buyers: inconsistent coverage counts' AS err FROM bp
   WHERE (reviewed + pending <> total OR ambiguous > reviewed) AND id NOT IN (SELECT id FROM bad)),
 errors AS (SELECT * FROM own UNION ALL SELECT * FROM crossed)"""

GRADED = CHECKED + """,
 fr AS (SELECT *, CASE WHEN obs IS NULL THEN 'unknown' WHEN ts + 10 - obs BETWEEN -15 AND CASE WHEN metric_id = 'source.verified'
   THEN 3600 ELSE 120 END THEN 'fresh' ELSE 'stale' END AS fresh FROM built),
 ok AS (SELECT id FROM observed WHERE id NOT IN (SELECT id FROM errors)),
 v AS (SELECT * FROM fr WHERE id IN (SELECT id FROM ok)),
 ctl AS (SELECT * FROM v WHERE metric_id LIKE 'controls.%' AND metric_id NOT IN ('controls.is_honeypot', 'controls.cannot_buy',
   'controls.cannot_sell_all')),
 pre AS (SELECT *, split_part(metric_id, '.', 1) AS prefix FROM v),
 rb AS (SELECT id, blk FROM v WHERE metric_id = 'quote.quantity'),
 findings AS (
  SELECT id, 'SCHEMA_INVALID' AS code, '' AS ids, 'none' AS follow_up, 'blocker' AS severity, 0 AS ord FROM bad
  UNION ALL SELECT DISTINCT id, 'SCHEMA_INVALID', '', 'none', 'blocker', 0 FROM crossed
  UNION ALL SELECT id, CASE WHEN fresh = 'stale' THEN CASE pos WHEN 2 THEN 'STALE_QUOTE' ELSE 'STALE_HOLDERS' END
     ELSE 'MISSING_PROVENANCE' END, metric_id, CASE pos WHEN 2 THEN 'refresh_market' ELSE 'refresh_holders' END, 'blocker', pos
   FROM v WHERE metric_id IN ('quote.quantity', 'holders.raw_top10') AND (fresh = 'stale' OR (has AND fresh = 'unknown'))
  UNION ALL SELECT id, 'MISSING_QUOTE', metric_id, 'refresh_market', 'blocker', 10 FROM v WHERE metric_id = 'quote.quantity' AND NOT has
  UNION ALL SELECT id, CASE WHEN bool_or(fresh = 'unknown') THEN 'MISSING_PROVENANCE' ELSE 'STALE_QUOTE' END,
    string_agg(metric_id, ',' ORDER BY pos), CASE prefix WHEN 'buyers' THEN 'complete_buyers' ELSE 'refresh_market' END, 'blocker',
    CASE prefix WHEN 'market' THEN 11 WHEN 'simulation' THEN 12 ELSE 13 END
   FROM pre WHERE prefix IN ('market', 'simulation', 'buyers') AND has AND fresh <> 'fresh' GROUP BY id, prefix
  UNION ALL SELECT id, 'MISSING_PROVENANCE', string_agg(metric_id, ',' ORDER BY pos), 'none', 'blocker', 14 FROM v
   WHERE has AND src IS NULL GROUP BY id
  UNION ALL SELECT id, 'MISSING_PROVENANCE', metric_id, 'refresh_market', 'blocker', 15 FROM v
   WHERE metric_id = 'liquidity.lp_burned' AND has AND fresh <> 'fresh'
  UNION ALL SELECT id, 'MISSING_PERMISSIONS', string_agg(metric_id, ',' ORDER BY pos), 'refresh_permissions', 'blocker', 16 FROM ctl
   WHERE NOT has GROUP BY id
  UNION ALL SELECT id, 'STALE_PERMISSIONS', string_agg(metric_id, ',' ORDER BY pos), 'refresh_permissions', 'blocker', 17 FROM ctl
   WHERE has AND fresh <> 'fresh' GROUP BY id
  UNION ALL SELECT id, 'SOURCE_NOT_VERIFIED', metric_id, 'refresh_source', 'blocker', 18 FROM v
   WHERE metric_id = 'source.verified' AND (flg IS DISTINCT FROM true OR fresh <> 'fresh')
  UNION ALL SELECT id, 'INCOMPLETE_BUYER_HISTORY', 'buyers.distinct,buyers.qualified,buyers.coverage', 'complete_buyers', 'warning', 19
   FROM bp WHERE (coalesce(pending, 0) <> 0 OR coalesce(ambiguous, 0) <> 0) AND id IN (SELECT id FROM ok)
  UNION ALL SELECT id, 'UNRESOLVED_HOLDER_CLASSIFICATION', 'holders.raw_top10,holders.adjusted_top10', 'none', 'warning', 20 FROM ok
  UNION ALL SELECT id, CASE status WHEN 'undefined' THEN 'UNDEFINED_LP_BURN' ELSE 'LIQUIDITY_LOCK_UNRESOLVED' END,
    'liquidity.lp_supply,liquidity.lp_burned', 'none', CASE status WHEN 'undefined' THEN 'warning' ELSE 'blocker' END, 21 FROM v
   WHERE metric_id = 'liquidity.lp_burned' AND status IN ('undefined', 'not_applicable')
  UNION ALL SELECT v.id, 'BLOCK_MISMATCH', 'quote.quantity,' || string_agg(metric_id, ',' ORDER BY
      CASE metric_id WHEN 'holders.raw_top10' THEN 0 WHEN 'simulation.passed' THEN 1 ELSE 2 END), 'refresh_holders', 'warning', 22
   FROM v JOIN rb ON rb.id = v.id WHERE metric_id IN ('holders.raw_top10', 'simulation.passed', 'buyers.distinct')
     AND v.blk <> rb.blk GROUP BY v.id
  UNION ALL SELECT id, 'SIMULATION_SCOPE', metric_id, 'none', 'info', 23 FROM v WHERE metric_id = 'simulation.passed' AND flg
  UNION ALL SELECT a.id, 'SELLABILITY_PROVIDER_UNKNOWN', 'controls.cannot_sell_all,simulation.passed', 'none', 'info', 24
   FROM v a JOIN v b ON a.id = b.id WHERE a.metric_id = 'simulation.passed' AND a.flg AND b.metric_id = 'controls.cannot_sell_all'
     AND NOT b.has)"""


def _use(name, field):
    return f"max(CASE WHEN metric_id = '{name}' AND fresh = 'fresh' AND src IS NOT NULL THEN {field} END)"


EFFECTIVE = GRADED + f""",
 ef AS (SELECT id, {_use('market.price', 'num')} AS eff_price, {_use('market.liquidity', 'num')} AS eff_liquidity,
   {_use('holders.raw_top10', 'num')} AS eff_top10, {_use('buyers.distinct', 'num')} AS eff_buyers,
   {_use('buyers.qualified', 'num')} AS eff_qualified, {_use('liquidity.lp_burned', 'num')} AS eff_lp_burned,
   {_use('quote.quantity', 'num')} AS qty, {_use('quote.usd_in', 'num')} AS usd_in, {_use('simulation.passed', 'flg::INT')} AS sim,
   {_use('source.verified', 'flg::INT')} AS sv,
   count(CASE WHEN metric_id IN ({', '.join(f"'{x}'" for x in ev.CONTROLS)}) AND fresh = 'fresh' AND NOT flg THEN 1 END) AS passed,
   count(CASE WHEN metric_id IN ({', '.join(f"'{x}'" for x in ev.CONTROLS)}) AND fresh = 'fresh' AND flg IS NOT NULL THEN 1 END) AS known
   FROM v GROUP BY id),
 effective AS (SELECT o.*, ef.* EXCLUDE (id, qty, usd_in, sim, sv), CASE WHEN ef.id IS NOT NULL THEN CASE sv WHEN 1 THEN 'verified'
     WHEN 0 THEN 'unverified' ELSE 'unavailable' END END AS eff_source, CASE WHEN qty IS NOT NULL THEN quote_status END AS eff_quote,
   qty AS eff_quantity, CASE WHEN qty IS NOT NULL THEN usd_in END AS eff_usd_in, CASE WHEN sim = 1 THEN sim_status END AS eff_sim
   FROM observed o LEFT JOIN ef USING (id))"""

SCORED = EFFECTIVE + """,
 fq AS (SELECT *, coalesce(ts + 10 - observed_at BETWEEN -15 AND 120, false) AS fresh FROM effective),
 parts AS (SELECT *, CASE eff_source WHEN 'verified' THEN 1 WHEN 'unverified' THEN 0 END AS f1,
   CASE WHEN known > 0 THEN passed / 11.0::DOUBLE END AS f2,
   CASE WHEN eff_quote IS NOT NULL THEN CASE WHEN eff_quote = 'quoted' AND fresh THEN 1 ELSE 0 END END AS f3,
   CASE WHEN eff_sim IS NOT NULL THEN CASE WHEN eff_sim = 'passed' AND fresh THEN 1 ELSE 0 END END AS f4,
   CASE WHEN eff_sim = 'passed' THEN CASE WHEN fresh AND buy_shortfall <= 0.03 AND sell_shortfall <= 0.03 AND roundtrip_loss <= 0.1
     THEN 1 ELSE 0 END END AS f5,
   CASE WHEN eff_liquidity IS NOT NULL THEN least(eff_liquidity / 25000.0::DOUBLE, 1) END AS f6, CASE WHEN eff_top10 <= 1 THEN least(1, (1 - eff_top10) / 0.5::DOUBLE) END AS f7,
   CASE WHEN eff_lp_burned IS NOT NULL THEN CASE WHEN eff_lp_burned >= 0.95 THEN 1 ELSE 0 END END AS f8,
   CASE WHEN eff_buyers IS NOT NULL THEN least(eff_buyers / 5::DOUBLE, 1) END AS f9,
   CASE WHEN eff_qualified IS NOT NULL THEN least(eff_qualified, 1) END AS f10 FROM fq),
 scored AS (SELECT *, round((""" + " + ".join(
    f"coalesce(CAST(round({w} * greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN f{i} IS NOT NULL THEN f{i} END)) * 100) AS BIGINT)"
    f" * CASE WHEN f{i} IS NULL THEN 0 ELSE 1 END, 0)"
    for i, (_, w) in enumerate(scoring.COMPONENTS, 1)) + """) / 100.0::DOUBLE, 1) AS score FROM parts)"""


def graded(t):
    return ev.assess(t.spread().observed.withColumn("now", C("ts") + 10))


@query("pip_23_build_evidence", "WITH" + BUILT + """
 SELECT metric_id, status, reason, src AS source, unit, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS ids,
   CAST(sum(obs) AS DOUBLE) AS observed_sum, CAST(sum(blk) AS BIGINT) AS block_sum, round(sum(num), 4) AS number_sum,
   CAST(count(CASE WHEN flg THEN 1 END) AS BIGINT) AS true_flags FROM built GROUP BY metric_id, status, reason, src, unit""")
def build_evidence(t):
    rows = ev.measurements(ev.build(t.spread().observed))
    return rows.groupBy("metric_id", "status", "reason", "source", "unit").agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("observed_at").alias("observed_sum"),
        F.sum("block_number").alias("block_sum"), F.round(F.sum("number"), 4).alias("number_sum"),
        F.count_if("flag").alias("true_flags"))


@query("pip_24_validate_evidence", "WITH" + CHECKED + """
 SELECT id, string_agg(err, '; ' ORDER BY err) AS errors FROM errors GROUP BY id""")
def validate_evidence(t):
    checked = ev.validate(ev.build(t.spread().observed))
    return checked.select("id", F.array_join(F.array_sort("errors"), "; ").alias("errors")).filter("errors <> ''")


@query("pip_25_evidence_quality", "WITH" + GRADED + """
 SELECT id, code, ids AS evidence_ids, follow_up, severity FROM findings""")
def evidence_quality(t):
    return ev.finding_rows(graded(t)).select(
        "id", "code", F.array_join("evidence_ids", ",").alias("evidence_ids"), "follow_up", "severity")


@query("pip_26_effective_snapshot", "WITH" + EFFECTIVE + """
 SELECT id, eff_price, eff_liquidity, eff_top10, eff_buyers, eff_qualified, eff_lp_burned, eff_source, eff_quote, eff_quantity,
   eff_usd_in, eff_sim FROM effective""")
def effective_snapshot(t):
    return ev.effective(graded(t)).select(
        "id", "eff_price", "eff_liquidity", "eff_top10", "eff_buyers", "eff_qualified", "eff_lp_burned", "eff_source",
        "eff_quote", "eff_quantity", "eff_usd_in", "eff_sim")


@query("pip_21_candidate_score", "WITH" + SCORED + """
 SELECT id, score, concat_ws(',', """ + ", ".join(
    f"CASE WHEN f{i} IS NULL THEN 'unknown' WHEN f{i} >= 1 THEN 'met' WHEN f{i} > 0 THEN 'partial' ELSE 'not_met' END"
    for i in range(1, 11)) + """) AS statuses FROM scored""")
def candidate_score(t):
    out = scoring.candidate_score(ev.effective(graded(t)))
    return out.select("id", "score", F.array_join(F.transform("components", lambda p: p["status"]), ",").alias("statuses"))


DECIDED = SCORED + """,
 fl AS (SELECT id, string_agg('evidence_' || lower(code), ',' ORDER BY ord) AS blockers FROM findings WHERE severity = 'blocker' GROUP BY id),
 dc AS (SELECT s.*, concat_ws(',', CASE WHEN s.id % 6 = 1 THEN 'buy_tax_above_limit' END, blockers,
   CASE WHEN NOT coalesce(eff_price > 0 AND fresh, false) THEN 'quote_missing_or_stale' END,
   CASE WHEN eff_liquidity IS NULL THEN 'liquidity_data_unavailable' WHEN eff_liquidity < 25000 THEN 'liquidity_below_limit' END,
   CASE WHEN eff_top10 IS NULL THEN 'holder_concentration_data_unavailable' WHEN eff_top10 > 0.5
     THEN 'holder_concentration_above_limit' END,
   CASE WHEN ts + 10 - risk_checked_at NOT BETWEEN 0 AND 120 THEN 'risk_stale' END,
   CASE WHEN launch_age > 86400 THEN 'launch_too_old_or_unknown' END,
   CASE WHEN NOT deployment_confirmed THEN 'token_deployment_unconfirmed' END) AS base FROM scored s LEFT JOIN fl ON fl.id = s.id),
 decided AS (SELECT *, CASE WHEN base <> '' THEN base WHEN coalesce(eff_qualified, 0) < 1
     AND NOT (launch_age <= 300 AND coalesce(eff_buyers, 0) >= 3) THEN 'insufficient_launch_or_wallet_signal'
   WHEN score < 65 THEN 'score_below_threshold' ELSE '' END AS reasons FROM dc)"""


def decided(t):
    rows = ev.effective(graded(t)).withColumn("risk_reasons", F.when(
        C("id") % 6 == 1, F.array(F.lit("buy_tax_above_limit"))).otherwise(F.array().cast("array<string>")))
    return apply_screen("launch", rows, LaunchRules())


@query("pip_22_decide", "WITH" + DECIDED + """
 SELECT id, score, reasons, CASE WHEN reasons <> '' THEN 'SKIP' WHEN coalesce(eff_qualified, 0) >= 1 THEN 'MIRROR' ELSE 'SNIPE' END
   AS action FROM decided""")
def decide(t):
    return decided(t).select("id", "score", F.array_join("reasons", ",").alias("reasons"), "action")


# ---- provider risk report --------------------------------------------------------------------------------------------
REPORT = """SELECT id, CASE id % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1' END AS source_flag,
  CASE WHEN id % 9 <> 0 THEN TEXT((id % 8) / 100.0E0) END AS buy_tax, CASE WHEN id % 10 = 0 THEN 'n/a' ELSE TEXT((id % 5) / 100.0E0) END
  AS sell_tax, id % 13 = 0 AS hooked, 2 + id % 3 AS version, id % 4 AS n_pairs, liquidity AS pair_liquidity, pool, id % 12 AS n_holders,
  CASE WHEN id % 15 <> 0 THEN TEXT(id % 14) END AS holder_count, id % 3 AS n_lp, id % 17 = 0 AS holder_gap, FLAGS
  FROM observed""".replace("FLAGS", ", ".join(
    f"CASE {flag} WHEN 'pass' THEN '0' WHEN 'fail' THEN '1' END AS {flag}" for flag in RISK_FLAGS))


@query("pip_20_risk_assess", f"""
 WITH r AS ({REPORT}),
  k AS (SELECT *, version = 2 AND n_pairs = 1 AND n_lp > 0 AS countable FROM r),
  b AS (SELECT *, CASE WHEN countable THEN CASE WHEN n_lp = 2 THEN 0.96::DOUBLE ELSE 0.5::DOUBLE END END AS burned FROM k)
 SELECT id, CASE source_flag WHEN '1' THEN 'verified' WHEN '0' THEN 'unverified' ELSE 'unavailable' END AS source_status,
  CASE WHEN n_pairs > 0 THEN pair_liquidity END AS matched_liquidity, burned AS lp_burned,
  round(CASE WHEN n_holders > 0 AND NOT holder_gap AND n_holders >= least(CAST(holder_count AS INT), 10)
    THEN least(n_holders, 10) * 0.03::DOUBLE END, 9) AS top10_share,
  concat_ws(',', CASE source_flag WHEN '1' THEN NULL WHEN '0' THEN 'source_reported_unverified_by_goplus'
     ELSE 'source_verification_data_unavailable' END, """ + ", ".join(
    f"CASE {flag} WHEN '0' THEN NULL WHEN '1' THEN '{flag}_flagged' ELSE '{flag}_unknown' END" for flag in RISK_FLAGS) + """,
   CASE WHEN buy_tax IS NULL THEN 'buy_tax_data_unavailable' WHEN CAST(buy_tax AS DOUBLE) > 0.03 THEN 'buy_tax_above_limit' END,
   CASE WHEN sell_tax = 'n/a' THEN 'sell_tax_data_unavailable' WHEN CAST(nullif(sell_tax, 'n/a') AS DOUBLE) > 0.03
     THEN 'sell_tax_above_limit' END,
   CASE WHEN hooked THEN 'unreviewed_v4_hook' END,
   CASE WHEN burned IS NULL OR burned < 0.95 THEN 'liquidity_withdrawal_risk_unresolved' END) AS reasons FROM b""")
def risk_assess(t):
    c = C
    rows = t.spread().sql(REPORT)
    share = F.when(c("holder_gap"), F.lit(None)).otherwise(F.lit("0.03")).cast("string")
    rows = rows.withColumns({
        "hooks": F.when(c("hooked"), F.concat(F.lit("0x1"), F.repeat(F.lit("0"), F.lit(39)))).otherwise(F.lit(ZERO_ADDRESS)),
        "pairs": F.when(c("n_pairs") > 0, F.array_repeat(F.struct(F.upper("pool").alias("pair"), c("pair_liquidity").cast(
            "string").alias("liquidity")), c("n_pairs").cast("int"))).otherwise(F.array().cast("array<struct<pair:string,liquidity:string>>")),
        "holders": F.array_repeat(share, c("n_holders").cast("int")),
        "lp_holders": F.when(c("n_lp") == 0, F.array().cast("array<struct<address:string,share:string>>")).when(
            c("n_lp") == 1, F.array(F.struct(F.lit(BURN_ADDRESS).alias("address"), F.lit("0.5").alias("share")),
                                    F.struct(F.lit("0xaa").alias("address"), F.lit("0.5").alias("share")))).otherwise(
            F.array(F.struct(F.lit(ZERO_ADDRESS).alias("address"), F.lit("0.96").alias("share")))),
    })
    return scoring.risk_assess(rows).select(
        "id", "source_status", "matched_liquidity", "lp_burned", F.round("top10_share", 9).alias("top10_share"),
        F.array_join("reasons", ",").alias("reasons"))


REVIEWS = """SELECT tx AS review_id, origin AS token, CASE status_code WHEN 'F' THEN 'complete' WHEN 'P' THEN 'complete'
    ELSE 'running' END AS status, CASE tx % 4 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'SNIPE' ELSE 'MIRROR' END AS action,
  CASE WHEN tx % 21 <> 0 THEN ts + 100 END AS finished_at, ts AS evidence_ts, tx % 4 AS pool FROM txs WHERE tx % 3 <> 0"""
GATED = """SELECT id, token, pool % 4 AS pool, CASE id % 3 WHEN 0 THEN 'MIRROR' WHEN 1 THEN 'SNIPE' ELSE 'SKIP' END AS action,
  ts + 200 AS now FROM assessments"""
GATE_SQL = f""" rv AS ({REVIEWS}), asm AS ({GATED}),
 nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY review_id DESC) AS rn FROM rv) WHERE rn = 1),
 gated AS (SELECT a.*, CASE WHEN r.token IS NULL THEN 'review_pending' WHEN r.status <> 'complete' THEN 'review_' || r.status
   WHEN r.action = 'SKIP' THEN 'review_skip'
   WHEN NOT coalesce(a.now - evidence_ts BETWEEN 0 AND 300 AND a.now - finished_at <= 300, false) THEN 'review_stale'
   WHEN r.pool IS DISTINCT FROM a.pool THEN 'review_pool_mismatch'
   WHEN r.action <> a.action OR a.action NOT IN ('SNIPE', 'MIRROR') THEN 'review_signal_no_longer_matches' END AS gate
   FROM asm a LEFT JOIN nr r ON r.token = a.token)"""


@query("pip_36_approval_gate", "WITH" + GATE_SQL + " SELECT id, token, gate FROM gated")
def approval_gate(t):
    return scoring.approval_gate(t.sql(GATED), t.sql(REVIEWS)).select("id", "token", "gate")


@query("pip_37_arm_decisions", "WITH" + GATE_SQL + """,
 arms AS (SELECT unnest(['wallet_momentum', 'wallet_momentum_reviewed', 'simple_momentum']) AS arm),
 rr AS (SELECT id, token, arm, list_sort(list_distinct(list_filter([CASE WHEN id % 4 = 0 THEN 'trade_feed_stale' END,
   CASE WHEN id % 6 = 0 THEN 'creator_identity_unresolved' END,
   CASE WHEN arm <> 'simple_momentum' AND id % 5 < 2 THEN 'fewer_than_two_prequalified_followable_wallets' END,
   CASE WHEN arm = 'wallet_momentum_reviewed' THEN gate END,
   CASE WHEN id % 9 = 0 THEN 'max_positions' END], lambda x: x IS NOT NULL))) AS rs FROM gated, arms)
 SELECT id, token, arm, CASE WHEN len(rs) = 0 THEN 'BUY' ELSE 'SKIP' END AS action, array_to_string(rs, ',') AS reasons FROM rr""")
def arm_decisions(t):
    one = lambda cond, x: F.when(cond, F.lit(x))
    rows = scoring.approval_gate(t.sql(GATED), t.sql(REVIEWS)).select(
        "id", "token", "gate", (C("id") % 5).alias("qualified"),
        F.array_compact(F.array(one(C("id") % 4 == 0, "trade_feed_stale"), one(C("id") % 6 == 0, "creator_identity_unresolved"))
                        ).alias("base_reasons"),
        F.array_compact(F.array(one(C("id") % 9 == 0, "max_positions"))).alias("capital_reasons"))
    return scoring.arm_decisions(rows).withColumn("reasons", F.array_join("reasons", ","))


@query("pip_44_entry_readiness", """
 WITH d AS (SELECT id, token, ts, launch_age, id % 3 <> 0 AS skip, id % 2 = 0 AS control,
   list_filter([CASE WHEN id % 3 = 1 THEN 'trade_feed_stale' END, CASE WHEN id % 3 > 0 AND id % 5 = 0 THEN 'risk_stale' END,
   CASE WHEN id % 3 = 2 THEN 'fewer_than_two_distinct_buyers' END], lambda x: x IS NOT NULL) AS rs FROM assessments),
  n AS (SELECT max(ts) AS now FROM assessments),
  l AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY id DESC) AS rn FROM d, n WHERE control AND now - ts <= 31536000)
 SELECT 'blocker' AS kind, reason AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(rs) AS reason FROM l WHERE rn = 1 AND skip)
   GROUP BY reason
 UNION ALL SELECT 'tokens', 'latest', count(*) FROM l WHERE rn = 1
 UNION ALL SELECT 'tokens', 'skipped', count(*) FROM l WHERE rn = 1 AND skip""")
def entry_readiness(t):
    one = lambda cond, x: F.when(cond, F.lit(x))
    i = C("id")
    rows = t.assessments.select(
        "id", "token", "ts", F.when(i % 2 == 0, "simple_momentum").otherwise("wallet_momentum").alias("arm"),
        F.when(i % 3 != 0, "SKIP").otherwise("BUY").alias("action"),
        F.array_compact(F.array(one(i % 3 == 1, "trade_feed_stale"), one((i % 3 > 0) & (i % 5 == 0), "risk_stale"),
                                one(i % 3 == 2, "fewer_than_two_distinct_buyers"))).alias("reasons"))
    now = t.assessments.select(F.max("ts")).scalar()
    counts, blockers = scoring.entry_readiness(rows, "simple_momentum", now, 31536000, 4)
    tokens = counts.select(F.explode(F.create_map(F.lit("latest"), "tokens", F.lit("skipped"), "skipped")).alias("name", "n"))
    return blockers.select(F.lit("blocker").alias("kind"), F.col("reason").alias("name"), "n").unionByName(
        tokens.select(F.lit("tokens").alias("kind"), "name", "n"))


@query("pip_45_review_findings_check", """
 WITH r AS (SELECT id, id % 6 AS k FROM assessments)
 SELECT id, CASE k WHEN 1 THEN 'invalid_code_action_or_severity' WHEN 2 THEN 'evidence_not_supplied'
   WHEN 3 THEN 'evidence_not_supplied,invalid_code_action_or_severity' WHEN 4 THEN 'too_many_findings' ELSE '' END AS errors FROM r""")
def review_findings_check(t):
    k = C("id") % 6
    one = F.struct(F.when(k.isin(1, 3), "NO_SUCH_CODE").otherwise("STALE_QUOTE").alias("code"),
                   F.array(F.when(k.isin(2, 3), "market.none").otherwise("market.price")).alias("evidence_ids"),
                   F.lit("refresh_market").alias("follow_up"), F.lit("blocker").alias("severity"))
    rows = t.assessments.select("id", F.array_repeat(one, F.when(k == 4, 41).otherwise(2)).alias("findings"),
                                F.array(*[F.lit(m) for m in ev.METRICS]).alias("supplied"))
    return ev.check_review_findings(rows).select("id", F.array_join("errors", ",").alias("errors"))


STATE = """SELECT token, CASE token % 3 WHEN 0 THEN 'refresh_market' WHEN 1 THEN 'refresh_source' ELSE 'complete_buyers' END AS follow_up,
  CASE token % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'completed' WHEN 2 THEN 'unavailable' ELSE 'running' END AS status,
  token % 5 AS attempts, CASE WHEN token % 7 <> 0 THEN 1000000000 - token % 600 END AS attempted_at, 1000000000 - 500 AS requested_at
  FROM assessments GROUP BY token"""
WANTED = """SELECT token, CASE id % 5 WHEN 0 THEN 'refresh_market' WHEN 1 THEN 'refresh_source' WHEN 2 THEN 'complete_buyers'
  WHEN 3 THEN 'none' ELSE 'refresh_holders' END AS follow_up FROM assessments"""


@query("pip_46_refresh_requests", f"""
 WITH s AS ({STATE}), w AS (SELECT DISTINCT * FROM ({WANTED}) WHERE follow_up <> 'none')
 SELECT w.token, w.follow_up, 'queued' AS status, 1000000000 AS requested_at, coalesce(attempts, 0) AS attempts
 FROM w LEFT JOIN s ON s.token = w.token AND s.follow_up = w.follow_up
 WHERE s.status IS NULL OR NOT (s.status IN ('queued', 'running') OR attempts >= 3
   OR 1000000000 - coalesce(attempted_at, requested_at) < 300)""")
def refresh_requests(t):
    return scoring.refresh_requests(t.sql(WANTED), t.sql(STATE), F.lit(1000000000))


@query("pip_46_refresh_outcomes", f"""
 WITH s AS (SELECT * FROM ({STATE}) WHERE status = 'running'), w AS (SELECT DISTINCT * FROM ({WANTED}))
 SELECT s.token, s.follow_up, CASE WHEN w.token IS NOT NULL OR s.token % 8 = 7 THEN 'unavailable' ELSE 'completed' END AS outcome
 FROM s LEFT JOIN w ON w.token = s.token AND w.follow_up = s.follow_up""")
def refresh_outcomes(t):
    running = t.sql(STATE).filter("status = 'running'")
    validity = t.assessments.select("token", (C("token") % 8 != 7).alias("valid")).distinct()
    return scoring.finish_refreshes(running, t.sql(WANTED), validity)


PAIRS = """SELECT id AS pair, token, CASE WHEN id % 6 <> 0 THEN token ELSE -1 END AS base_token,
  CASE WHEN id % 7 <> 0 THEN liquidity * 2 END AS price_usd, liquidity, CASE WHEN id % 8 <> 0 THEN ts * 1000 END AS created_ms,
  ts + 500 AS now, id % 40 AS buys_m5, id % 30 AS sells_m5 FROM assessments"""


@query("pip_47_market_snapshot", f"""
 WITH p AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY coalesce(liquidity, 0) DESC, pair DESC) AS rn FROM ({PAIRS})
   WHERE base_token = token AND price_usd IS NOT NULL)
 SELECT token, pair, price_usd, liquidity, buys_m5, sells_m5, CASE WHEN created_ms IS NOT NULL
   THEN greatest(0, now - created_ms / 1000.0::DOUBLE) END AS age_seconds FROM p WHERE rn = 1""")
def market_snapshot(t):
    return scoring.market_snapshot(t.sql(PAIRS)).select(
        "token", "pair", "price_usd", "liquidity", "buys_m5", "sells_m5", "age_seconds")


@query("pip_48_reconcile_reasons", """
 WITH b AS (SELECT *, list_filter([CASE WHEN id % 2 = 0 THEN 'liquidity_withdrawal_risk_unresolved' END,
    CASE WHEN id % 3 = 0 THEN 'cannot_buy_unknown' END, CASE WHEN id % 5 = 0 THEN 'buy_tax_data_unavailable' END,
    CASE WHEN id % 7 = 0 THEN 'source_reported_unverified_by_goplus' END, CASE WHEN id % 11 = 0 THEN 'scanner_catching_up' END,
    CASE WHEN id % 13 = 0 THEN 'is_proxy_flagged' END], lambda x: x IS NOT NULL) AS rs FROM observed)
 SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter(rs, lambda r:
     NOT (r = 'liquidity_withdrawal_risk_unresolved' AND coalesce(lp_burned >= 0.95 OR (lp_burned IS NOT NULL AND pool_version = 2), false))
     AND NOT (r = 'cannot_buy_unknown' AND coalesce(sim_status = 'passed', false))
     AND NOT (r = 'buy_tax_data_unavailable' AND coalesce(sim_status = 'passed' AND buy_shortfall <= 0.03, false))
     AND NOT (r = 'source_reported_unverified_by_goplus' AND coalesce(source_status = 'verified', false))
     AND NOT (r = 'scanner_catching_up' AND id % 4 = 0)),
   list_filter([CASE WHEN lp_burned < 0.95 AND pool_version = 2 THEN 'v2_lp_burn_below_95_percent' END,
     CASE WHEN sim_status = 'passed' AND buy_shortfall > 0.03 THEN 'simulated_buy_shortfall_above_limit' END,
     CASE WHEN sim_status = 'passed' AND roundtrip_loss > 0.1 THEN 'simulated_roundtrip_loss_above_10_percent' END,
     CASE WHEN sim_status = 'failed' THEN 'buy_sell_simulation_failed' END], lambda x: x IS NOT NULL)))), ',') AS reasons FROM b""")
def reconcile_reasons(t):
    one = lambda n, x: F.when(C("id") % n == 0, F.lit(x))
    rows = t.observed.withColumns({
        "reasons": F.array_compact(F.array(
            one(2, "liquidity_withdrawal_risk_unresolved"), one(3, "cannot_buy_unknown"), one(5, "buy_tax_data_unavailable"),
            one(7, "source_reported_unverified_by_goplus"), one(11, "scanner_catching_up"), one(13, "is_proxy_flagged"))),
        "version": C("pool_version"), "feed_current": C("id") % 4 == 0})
    return scoring.reconcile_reasons(rows).select("id", F.array_join(F.array_sort("settled"), ",").alias("reasons"))


@query("pip_49_review_packets", """
 WITH tk AS (SELECT c_custkey AS token FROM customer),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY id DESC) AS rn FROM assessments WHERE token % 3 <> 0) WHERE rn = 1),
  pl AS (SELECT p_partkey AS pool, p_partkey % 1500 AS token, p_size AS block FROM part UNION ALL
    SELECT p_partkey, (p_partkey * 7 + 1) % 1500, p_size FROM part WHERE p_partkey % 1500 <> (p_partkey * 7 + 1) % 1500),
  rk AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY block DESC, pool) AS rn FROM pl),
  f AS (SELECT token, string_agg(pool, ',' ORDER BY rn) AS pools FROM rk WHERE rn <= 5 GROUP BY token)
 SELECT tk.token, CASE WHEN l.id IS NOT NULL THEN 'assessed' ELSE 'unassessed' END AS kind, l.id AS assessment,
   CASE WHEN l.id IS NULL THEN f.pools END AS pools FROM tk LEFT JOIN l USING (token) LEFT JOIN f USING (token)""")
def review_packets(t):
    pools = t.part.select(C("p_partkey").alias("pool"), (C("p_partkey") % 1500).alias("token0"),
                          ((C("p_partkey") * 7 + 1) % 1500).alias("token1"), (2 + C("p_partkey") % 3).alias("version"),
                          C("p_size").alias("block"))
    tokens = t.customer.select(C("c_custkey").alias("token"))
    bridge = joins.or_key(tokens, pools, "token", ["token0", "token1"])
    checks = t.txs.select(C("origin").alias("token"), C("ts").alias("checked_at"), "status_code")
    packets = scoring.review_packets(tokens, t.assessments.filter("token % 3 <> 0").select("token", "id", "ts", "liquidity"),
                                     bridge, checks, 200_000)
    ids = F.from_json(F.get_json_object("packet", "$.pools"), "array<struct<pool:bigint>>")
    return packets.select("token", "kind", F.get_json_object("packet", "$.assessment.id").cast("bigint").alias("assessment"),
                          F.when(C("kind") == "unassessed", F.array_join(F.transform(ids, lambda p: p["pool"].cast("string")), ",")
                                 ).alias("pools"))
