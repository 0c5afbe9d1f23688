"""Join operators."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.operators import joins
from onledger.operators.aggregates import latest

DAY = 86400
LOGS = """ logs AS (SELECT tx, log_index, min(block) AS log_block, CAST(count(*) AS BIGINT) AS copies
  FROM swap_keys GROUP BY tx, log_index)"""
POOLS = """ pools AS (SELECT p_partkey AS pool, 'T' || TEXT(p_partkey % 40) AS token0,
  'T' || TEXT((p_partkey * 7 + 3) % 40) AS token1, 2 + p_partkey % 3 AS version, CAST(p_size AS BIGINT) AS block
  FROM part)"""
BLOCKS = " blocks AS (SELECT block, min(ts) AS ts FROM txs WHERE block % 7 <> 3 GROUP BY block)"


def logs(t):
    return t.sql("WITH" + LOGS + " SELECT * FROM logs")


def pools(t):
    return t.sql("WITH" + POOLS + " SELECT * FROM pools")


def blocks(t):
    return t.sql("WITH" + BLOCKS + " SELECT * FROM blocks")


@query("jon_01_swaps_with_logs", "WITH" + LOGS + """
 SELECT tx, log_index, token, side, quote_amount, log_block, copies FROM swaps JOIN logs USING (tx, log_index)""")
def swaps_with_logs(t):
    return t.swaps.join(logs(t), ["tx", "log_index"]).select(
        "tx", "log_index", "token", "side", "quote_amount", "log_block", "copies")


@query("jon_02_logs_left_swaps", "WITH" + LOGS + """
 SELECT l.tx, l.log_index, l.log_block, s.token, s.side, s.wallet FROM logs l
 LEFT JOIN (SELECT * FROM swaps WHERE side = 'sell') s ON l.tx = s.tx AND l.log_index = s.log_index""")
def logs_left_swaps(t):
    sells = t.swaps.filter("side = 'sell'").select("tx", "log_index", "token", "side", "wallet")
    return logs(t).drop("copies").join(sells, ["tx", "log_index"], "left")


@query("jon_03_anti_not_exists", """
 SELECT tx, wallet, status FROM samples s WHERE NOT EXISTS (
   SELECT 1 FROM swap_keys k WHERE k.tx = s.tx AND k.side = 'sell')""")
def anti_not_exists(t):
    return joins.anti(t.samples, t.swap_keys.filter("side = 'sell'"), ["tx"]).select("tx", "wallet", "status")


@query("jon_03_anti_left_is_null", """
 SELECT s.tx, s.wallet FROM samples s LEFT JOIN (SELECT DISTINCT tx FROM swap_keys WHERE line_status = 'O') k
 ON k.tx = s.tx WHERE k.tx IS NULL""")
def anti_left_is_null(t):
    return joins.anti(t.samples, t.swap_keys.filter("line_status = 'O'"), ["tx"]).select("tx", "wallet")


@query("jon_03_anti_not_in", """
 SELECT 'plain' AS list, wallet, CAST(count(*) AS BIGINT) AS n FROM samples
 WHERE tx NOT IN (SELECT tx FROM swap_keys WHERE side = 'sell') GROUP BY wallet
 UNION ALL
 SELECT 'holds_null' AS list, wallet, CAST(count(*) AS BIGINT) AS n FROM samples
 WHERE tx NOT IN (SELECT CASE WHEN side = 'sell' THEN tx END FROM swap_keys) GROUP BY wallet""")
def anti_not_in(t):
    sells = t.swap_keys.filter("side = 'sell'")
    gaps = t.swap_keys.select(F.when(F.col("side") == "sell", F.col("tx")).alias("tx"))
    parts = [joins.not_in(t.samples, lst, "tx").groupBy("wallet").agg(F.count("*").alias("n"))
             .select(F.lit(label).alias("list"), "wallet", "n") for label, lst in (("plain", sells), ("holds_null", gaps))]
    return parts[0].unionByName(parts[1])


@query("jon_04_semi_exists", """
 SELECT tx, log_index, token, side, quote_amount FROM swaps s
 WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = s.pool AND q.p_size > 25)
   AND origin IN (SELECT token FROM assessments WHERE deployment_confirmed)""")
def semi_exists(t):
    large = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("pool"))
    seen = t.assessments.filter("deployment_confirmed").select(F.col("token").alias("origin")).distinct()
    return (t.swaps.join(large, "pool", "left_semi").join(seen, "origin", "left_semi")
            .select("tx", "log_index", "token", "side", "quote_amount"))


@query("jon_05_semi_having", """
 SELECT tx, wallet, token, leader_ts FROM samples WHERE wallet IN (
   SELECT wallet FROM samples GROUP BY wallet HAVING count(*) >= 10 AND count(DISTINCT token) >= 5
     AND sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) > 0)""")
def semi_having(t):
    busy = (t.samples.groupBy("wallet").agg(
        F.count("*").alias("n"), F.countDistinct("token").alias("k"),
        F.count_if(F.col("status") == "queued").alias("open"))
        .filter("n >= 10 AND k >= 5 AND open > 0").select("wallet"))
    return t.samples.join(busy, "wallet", "left_semi").select("tx", "wallet", "token", "leader_ts")


@query("jon_06_or_key", "WITH" + POOLS + """,
 tokens AS (SELECT token0 AS token FROM pools UNION SELECT token1 FROM pools)
 SELECT t.token, p.pool, p.version, p.block FROM tokens t JOIN pools p ON t.token = p.token0 OR t.token = p.token1""")
def or_key(t):
    p = pools(t)
    tokens = p.select(F.col("token0").alias("token")).union(p.select("token1")).distinct()
    return joins.or_key(tokens, p, "token", ["token0", "token1"]).select("token", "pool", "version", "block")


@query("jon_07_range_totals", """
 SELECT a.user_id, a.quote_id, a.ts, CAST(count(f.quote_id) AS BIGINT) AS n, CAST(coalesce(sum(f.cents), 0) AS BIGINT) AS cents
 FROM quotes a LEFT JOIN quotes f ON f.user_id = a.user_id AND f.ts BETWEEN a.ts - 21600 AND a.ts
 WHERE a.token = 'purchase' GROUP BY a.user_id, a.quote_id, a.ts""")
def range_totals(t):
    anchors = t.quotes.filter("token = 'purchase'")
    return joins.range_totals(anchors, t.quotes, ["user_id"], ["quote_id"], "ts", "ts", 21600,
                              {"n": F.lit(1).cast("bigint"), "cents": F.col("cents")})


@query("jon_08_last_closed_candle", """
 SELECT q.quote_id, q.ts, CASE WHEN q.ts - (c.start + 3600) BETWEEN 0 AND 1800 THEN c.close_cents END AS close_cents
 FROM quotes q LEFT JOIN candles c ON c.start = IDIV(q.ts, 3600) * 3600 - 3600""")
def last_closed_candle(t):
    return joins.last_closed(t.quotes.select("quote_id", "ts"), t.candles, "ts", 3600, 1800, ["close_cents"])


@query("jon_08_asof_backward", """
 SELECT l.quote_id, l.user_id, l.ts, CASE WHEN l.ts - r.ts <= 86400 THEN r.ts END AS found_at,
   CASE WHEN l.ts - r.ts <= 86400 THEN r.cents END AS price_cents
 FROM (SELECT * FROM quotes WHERE token = 'purchase') l
 ASOF LEFT JOIN (SELECT user_id, ts, max_by(cents, quote_id) AS cents FROM quotes WHERE token = 'view'
                 GROUP BY user_id, ts) r
 ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(t):
    looks = t.quotes.filter("token = 'purchase'").select("quote_id", "user_id", "ts")
    facts = t.quotes.filter("token = 'view'").select("user_id", F.col("ts").alias("seen"),
                                                      F.col("cents").alias("price_cents"), F.col("quote_id").alias("fid"))
    return joins.asof_backward(looks, facts, ["user_id"], ["quote_id"], "ts", "seen", ["price_cents"], ["fid"], DAY)


@query("jon_09_asof_forward_block", "WITH" + BLOCKS + """
 SELECT s.tx, s.target, b.ts AS found_at, b.block, CASE WHEN b.ts IS NULL THEN 'not_indexed_yet' ELSE 'found' END AS state
 FROM (SELECT tx, leader_ts + 30 AS target FROM samples) s ASOF LEFT JOIN blocks b ON s.target <= b.ts""")
def asof_forward_block(t):
    looks = t.samples.select("tx", (F.col("leader_ts") + 30).alias("target"))
    facts = blocks(t).withColumnRenamed("ts", "block_ts")
    out = joins.asof_forward(looks, facts, [], ["tx"], "target", "block_ts", ["block"], ["block"])
    return out.withColumn("state", F.when(F.col("found_at").isNull(), "not_indexed_yet").otherwise("found"))


@query("jon_10_latest_lookup", """
 WITH last AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY id DESC) AS rn FROM assessments)
 SELECT x.tx, x.origin, l.id AS assessment, l.ts AS assessed_at, l.liquidity
 FROM txs x LEFT JOIN (SELECT * FROM last WHERE rn = 1) l ON l.token = x.origin""")
def latest_lookup(t):
    newest = latest(t.assessments.select("token", "id", "ts", "liquidity"), ["token"], ["id"])
    newest = newest.select(F.col("token").alias("origin"), F.col("id").alias("assessment"),
                           F.col("ts").alias("assessed_at"), "liquidity")
    return t.txs.select("tx", "origin").join(newest, "origin", "left")


@query("jon_11_resolve_exactly_one", """
 WITH c AS (SELECT tx, count(DISTINCT pool) AS n, min(pool) AS pool FROM swap_keys WHERE side = 'buy' GROUP BY tx)
 SELECT s.tx, CASE WHEN c.n = 1 THEN c.pool END AS pool,
   CASE WHEN c.n = 1 THEN 'resolved' ELSE 'leader_pool_ambiguous_or_missing' END AS outcome
 FROM samples s LEFT JOIN c ON c.tx = s.tx""")
def resolve_exactly_one(t):
    found = joins.resolve_one(t.swap_keys.filter("side = 'buy'"), ["tx"], "pool", "pool")
    return t.samples.select("tx").join(found, "tx", "left").withColumn(
        "outcome", F.when(F.col("pool").isNotNull(), "resolved").otherwise("leader_pool_ambiguous_or_missing"))


@query("jon_12_provenance_checked", "WITH" + LOGS + """
 SELECT s.wallet, CAST(count(*) AS BIGINT) AS swaps,
   CASE WHEN bool_and(l.log_block IS NOT DISTINCT FROM s.block)
     THEN CAST(sum(CASE WHEN s.side = 'buy' THEN s.quote_amount ELSE -s.quote_amount END) AS BIGINT) END AS net_quote,
   CASE WHEN NOT bool_and(l.log_block IS NOT DISTINCT FROM s.block) THEN 'pool_flow_evidence_missing' END AS reason
 FROM (SELECT tx, log_index, block, side, quote_amount, wallet * 1000 + pool % 1000 AS wallet FROM swap_keys) s
 LEFT JOIN logs l ON l.tx = s.tx AND l.log_index = s.log_index GROUP BY s.wallet""")
def provenance_checked(t):
    swaps = t.swap_keys.withColumn("wallet", F.col("wallet") * 1000 + F.col("pool") % 1000)
    checked = swaps.join(logs(t), ["tx", "log_index"], "left")
    agrees = F.bool_and(F.col("log_block").eqNullSafe(F.col("block")))
    net = F.sum(F.when(F.col("side") == "buy", F.col("quote_amount")).otherwise(-F.col("quote_amount")))
    return checked.groupBy("wallet").agg(
        F.count("*").alias("swaps"), F.when(agrees, net).alias("net_quote"),
        F.when(~agrees, F.lit("pool_flow_evidence_missing")).alias("reason"))


@query("jon_13_reconcile", """
 WITH a AS (SELECT tx, origin, block, CASE WHEN tx % 17 = 0 THEN total_cents + 1 ELSE total_cents END AS total_cents,
              CASE WHEN tx % 23 <> 0 THEN status_code END AS status_code FROM txs WHERE tx % 13 <> 0),
  b AS (SELECT tx, origin, block, total_cents, status_code FROM txs WHERE tx % 19 <> 0)
 SELECT tx, CASE WHEN b.block IS NULL THEN 'left_only' WHEN a.block IS NULL THEN 'right_only'
     WHEN a.total_cents IS DISTINCT FROM b.total_cents OR a.status_code IS DISTINCT FROM b.status_code THEN 'mismatched'
     ELSE 'matched' END AS status,
   CASE WHEN a.block IS NOT NULL AND b.block IS NOT NULL AND (a.total_cents IS DISTINCT FROM b.total_cents
       OR a.status_code IS DISTINCT FROM b.status_code) THEN concat_ws(',',
     CASE WHEN a.total_cents IS DISTINCT FROM b.total_cents THEN 'total_cents' END,
     CASE WHEN a.status_code IS DISTINCT FROM b.status_code THEN 'status_code' END) END AS differing
 FROM a FULL JOIN b USING (tx)""")
def reconcile(t):
    a = t.sql("""SELECT tx, origin, block, CASE WHEN tx % 17 = 0 THEN total_cents + 1 ELSE total_cents END AS total_cents,
        CASE WHEN tx % 23 <> 0 THEN status_code END AS status_code FROM txs WHERE tx % 13 <> 0""")
    b = t.txs.filter("tx % 19 <> 0")
    return joins.reconcile(a, b, ["tx"], ["origin", "block", "total_cents", "status_code"]).select(
        "tx", "status", "differing")


CASES = """ members AS (SELECT tx, wallet, token * 1000000000000 + leader_ts AS case_key, status, return_bp FROM samples),
  cases AS (SELECT case_key, max(return_bp) AS case_return, CAST(count(*) AS BIGINT) AS case_size
    FROM members WHERE status = 'complete' GROUP BY case_key)"""


@query("jon_15_member_fan_out", "WITH" + CASES + """
 SELECT m.tx, m.wallet, m.case_key, c.case_return, c.case_size FROM members m JOIN cases c USING (case_key)""")
def member_fan_out(t):
    members = t.samples.withColumn("case_key", F.col("token") * 1000000000000 + F.col("leader_ts"))
    cases = members.filter("status = 'complete'").groupBy("case_key").agg(
        F.max("return_bp").alias("case_return"), F.count("*").alias("case_size"))
    return members.join(cases, "case_key").select("tx", "wallet", "case_key", "case_return", "case_size")
