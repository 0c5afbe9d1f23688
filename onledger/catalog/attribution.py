"""Normalisation, call frames, attribution."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.catalog import rawlogs as raw
from onledger.functions import decode as d
from onledger.functions import amounts, wide
from onledger.plans import attribution as at
from onledger.plans import ledger
from onledger.sources.readers import parse_logs, parse_receipts

C = F.col
ROUTER = 999999


def chain_logs(t):
    """Swap logs placed in their transaction's block; every tenth transaction reports no time."""
    t = t.spread()
    rows = t.swaps.drop("block", "ts", "origin").join(t.txs.select("tx", "block", "ts"), "tx")
    rows = rows.withColumn("ts", F.when(C("tx") % 10 != 0, C("ts")).otherwise(0))
    logs = parse_logs(raw.swap_logs(rows)).withColumns({
        "indexed_tx": raw.hash32(C("tx")), "indexed_hash": raw.hash32(C("block")),
        "indexed_block": F.when(C("tx") % 37 == 0, C("block") + 1).otherwise(C("block"))})
    return ledger.accepted_logs(logs)


def receipts(t):
    raw_receipts = t.txs.filter("status_code <> 'O'").select("tx", F.to_json(F.struct(
        raw.hash32(C("tx")).alias("transactionHash"), raw.hash32(C("block")).alias("blockHash"),
        raw.hexq(C("block")).alias("blockNumber"),
        raw.hexq(F.when(C("status_code") == "F", 1).otherwise(0).cast("bigint")).alias("status"),
        raw.addr(C("origin")).alias("from"), raw.addr(C("origin") % 10 + ROUTER).alias("to"),
        raw.hexq(C("total_cents")).alias("gasUsed"), raw.hexq(C("block") + 1).alias("effectiveGasPrice"))).alias("raw"))
    return parse_receipts(raw_receipts)


HASH = "'0x' || lpad(lower(to_hex({})), 64, '0')"
ADDR = "'0x' || lpad(lower(to_hex({})), 40, '0')"


@query("pip_01_blocks", f"""
 SELECT {HASH.format('x.block')} AS block_hash, x.block AS number, CAST(NULL AS VARCHAR) AS parent_hash,
   min(CASE WHEN tx % 10 <> 0 THEN x.ts END) AS ts, 'rpc_log_or_observation' AS source
 FROM swap_keys s JOIN txs x USING (tx) WHERE tx % 37 <> 0 GROUP BY x.block""")
def blocks(t):
    return ledger.blocks(chain_logs(t).filter("identity_ok"))


@query("pip_01_transactions", f"""
 SELECT {HASH.format('tx')} AS tx_hash, {HASH.format('x.block')} AS block_hash, min(s.wallet) AS tx_index,
   CASE WHEN x.status_code <> 'O' THEN {ADDR.format('x.origin')} END AS sender,
   CASE WHEN x.status_code <> 'O' THEN {ADDR.format('x.origin % 10 + 999999')} END AS recipient,
   CASE WHEN x.status_code <> 'O' THEN x.status_code = 'F' END AS succeeded,
   CASE WHEN x.status_code <> 'O' THEN x.total_cents END AS gas_used, CASE WHEN x.status_code <> 'O' THEN x.block + 1 END
   AS gas_price, CASE WHEN x.status_code <> 'O' THEN x.total_cents * (x.block + 1) END AS fee, x.status_code <> 'O' AS receipt_available
 FROM swap_keys s JOIN txs x USING (tx) WHERE tx % 37 <> 0
 GROUP BY tx, x.block, x.status_code, x.origin, x.total_cents""")
def transactions(t):
    out = ledger.transactions(chain_logs(t).filter("identity_ok"), receipts(t))
    return out.withColumn("fee", C("fee").cast("bigint"))


@query("pip_01_accounts", f"""
 WITH e AS (SELECT DISTINCT CASE WHEN pool % 3 = 2 THEN '{d.SINGLETON_V4}' ELSE {ADDR.format('pool')} END AS address
     FROM swap_keys WHERE tx % 37 <> 0
   UNION SELECT {ADDR.format('origin')} FROM txs WHERE status_code <> 'O'
   UNION SELECT {ADDR.format('origin % 10 + 999999')} FROM txs WHERE status_code <> 'O'),
  c AS (SELECT {ADDR.format('p_partkey')} AS address FROM part WHERE p_size > 25)
 SELECT address, CASE WHEN c.address IS NOT NULL THEN true END AS is_contract FROM e LEFT JOIN c USING (address)""")
def accounts(t):
    code = t.part.filter("p_size > 25").select(raw.addr(C("p_partkey")).alias("address"))
    return ledger.accounts(chain_logs(t).filter("identity_ok"), receipts(t), code)


@query("pip_01_logs", f"""
 SELECT {HASH.format('tx')} AS tx_hash, log_index AS log_number, CASE WHEN pool % 3 = 2 THEN '{d.SINGLETON_V4}'
   ELSE {ADDR.format('pool')} END AS emitter, 'swap' AS kind FROM swap_keys WHERE tx % 37 <> 0""")
def log_rows(t):
    return ledger.log_rows(chain_logs(t).filter("identity_ok")).drop("digest")


@query("pip_02_identity_conflicts", """
 WITH k AS (SELECT *, block * 31 + CASE WHEN tx % 53 = 0 THEN 1 ELSE 0 END AS log_hash FROM swap_keys)
 SELECT 'block_number' AS conflict, TEXT(block) AS key, CAST(count(DISTINCT log_hash) AS BIGINT) AS variants FROM k
   GROUP BY block HAVING count(DISTINCT log_hash) > 1
 UNION ALL SELECT 'transaction_block', TEXT(tx), count(DISTINCT block) FROM k GROUP BY tx HAVING count(DISTINCT block) > 1
 UNION ALL SELECT 'log_content', tx || ':' || log_index, count(DISTINCT pool || ':' || quote_amount) FROM k
   GROUP BY tx, log_index HAVING count(DISTINCT pool || ':' || quote_amount) > 1""")
def identity_conflicts(t):
    k = t.swap_keys
    digest = F.sha2(F.concat_ws(":", "pool", "quote_amount"), 256)
    return ledger.identity_conflicts([
        ("block_number", k, ["block"], C("block") * 31 + F.when(C("tx") % 53 == 0, 1).otherwise(0)),
        ("transaction_block", k, ["tx"], C("block")),
        ("log_content", k, ["tx", "log_index"], digest)])


@query("pip_03_referential_orphans", """
 SELECT 'swap_transaction' AS relation, CAST(count(*) AS BIGINT) AS orphan_rows, CAST(count(DISTINCT tx) AS BIGINT) AS orphan_keys
   FROM swap_keys WHERE tx NOT IN (SELECT tx FROM txs)
 UNION ALL SELECT 'transaction_account', count(*), count(DISTINCT origin) FROM txs WHERE origin NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT 'quote_user', count(*), count(DISTINCT user_id) FROM quotes WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def referential_orphans(t):
    return ledger.orphans({
        "swap_transaction": (t.swap_keys, "tx", t.txs, "tx"),
        "transaction_account": (t.txs, "origin", t.supplier, "s_suppkey"),
        "quote_user": (t.quotes, "user_id", t.supplier, "s_suppkey")})


def traces(t):
    """Call trees three levels deep: the order, its lines, and a refund below some lines."""
    atomic = lambda x: F.concat(x.cast("string"), F.lit("0" * 18))
    leaf = F.when(C("gas") > 500, F.array(F.struct(
        F.lit("CALL").alias("type"), C("wallet").cast("string").alias("from"), C("origin").cast("string").alias("to"),
        atomic(C("gas")).alias("value"))))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("call", "DELEGATECALL", "CREATE", "SELFDESTRUCT")]),
                        (C("log_index") % 4 + 1).cast("int"))
    line = F.struct(
        kind.alias("type"), F.lit(str(ROUTER)).alias("from"), C("wallet").cast("string").alias("to"),
        atomic(C("quote_amount")).alias("value"), F.when(C("side") == "sell", "execution reverted").alias("error"),
        leaf.alias("calls"))
    lines = t.swaps.groupBy("tx").agg(F.collect_list(line).alias("calls"))
    return t.txs.join(lines, "tx").select("tx", F.to_json(F.struct(
        F.lit("CALL").alias("type"), C("origin").cast("string").alias("from"), F.lit(str(ROUTER)).alias("to"),
        atomic(C("total_cents")).alias("value"),
        F.when((C("status_code") == "P") & (C("tx") % 3 == 0), "out of gas").alias("error"), "calls")).alias("trace"))


LIVE = f""" live AS (SELECT s.*, x.total_cents, x.origin AS root FROM swaps s JOIN txs x USING (tx)
   WHERE NOT (x.status_code = 'P' AND tx % 3 = 0)),
 fr AS (SELECT DISTINCT tx, TEXT(root) AS sender, '{ROUTER}' AS recipient, ATOMIC(total_cents) AS v, 'CALL' AS kind FROM live
   UNION ALL SELECT tx, '{ROUTER}', TEXT(wallet), ATOMIC(quote_amount),
     CASE log_index % 4 WHEN 0 THEN 'CALL' WHEN 1 THEN 'DELEGATECALL' WHEN 2 THEN 'CREATE' ELSE 'SELFDESTRUCT' END
     FROM live WHERE side = 'buy'
   UNION ALL SELECT tx, TEXT(wallet), TEXT(root), ATOMIC(gas), 'CALL' FROM live WHERE side = 'buy' AND gas > 500)"""


@query("pip_04_trace_native_delta", "WITH" + LIVE + """,
 d AS (SELECT tx, sender AS wallet, -v AS v FROM fr WHERE kind <> 'DELEGATECALL'
   UNION ALL SELECT tx, recipient, v FROM fr WHERE kind <> 'DELEGATECALL')
 SELECT tx, wallet, TEXT(sum(v)) AS delta FROM d GROUP BY tx, wallet""")
def trace_native_delta(t):
    frames = at.flatten_frames(traces(t))
    out = at.native_deltas(frames, d.wide_quantity(C("value")), narrow=d.narrow_quantity(C("value")))
    return out.withColumn("delta", amounts.text(out, "delta"))


@query("pip_05_deployment_origin", "WITH" + LIVE + """
 SELECT tx, recipient AS token, min(sender) AS deployer, (SELECT TEXT(x.origin) FROM txs x WHERE x.tx = fr.tx) AS initiator
 FROM fr WHERE kind = 'CREATE' GROUP BY tx, recipient""")
def deployment_origin(t):
    return at.deployment_origins(at.flatten_frames(traces(t)))


# receipts, transfers and native flows of the bound transactions, one SQL text for both engines
ATTR = f""" one AS (SELECT tx, min(wallet) AS first_wallet FROM swap_keys GROUP BY tx),
 rc AS (SELECT x.tx, NOT (x.status_code = 'P' AND x.tx % 3 = 0) AS ok, TEXT(x.origin) AS origin,
   TEXT(one.first_wallet) AS to_address, CASE WHEN x.tx % 29 = 0 THEN '{ROUTER}' ELSE TEXT(x.origin) END AS trace_origin,
   x.tx % 31 = 0 AS mixed FROM txs x JOIN one ON one.tx = x.tx),
 leg AS (SELECT s.tx, s.token, s.side, s.token_amount, s.quote_amount, 'P' || TEXT(s.pool) AS pool,
   CASE WHEN s.tx % 2 = 0 THEN TEXT(s.origin) ELSE TEXT(one.first_wallet) END AS holder
   FROM swaps s JOIN one ON one.tx = s.tx),
 mv AS (SELECT tx, token, CASE WHEN side = 'buy' THEN pool ELSE holder END AS sender,
     CASE WHEN side = 'buy' THEN holder ELSE pool END AS recipient, token_amount AS amount FROM leg
   UNION ALL SELECT tx, 'WRAPPED' AS token, CASE WHEN side = 'buy' THEN holder ELSE pool END AS sender,
     CASE WHEN side = 'buy' THEN pool ELSE holder END AS recipient, quote_amount AS amount FROM leg WHERE tx % 4 <> 1),
 nat AS (SELECT tx, holder AS wallet, CASE WHEN side = 'buy' THEN -quote_amount ELSE quote_amount END AS delta FROM leg
   WHERE tx % 4 = 1)"""
ATTR_SQL = ATTR + """,
 ck AS (SELECT *, CASE WHEN NOT ok THEN 'Transaction reverted' WHEN trace_origin <> origin THEN 'Trace origin mismatch'
   WHEN mixed THEN 'Mixed liquidity and swap transaction' END AS failure FROM rc),
 who AS (SELECT DISTINCT tx, origin, wallet FROM (SELECT tx, origin, origin AS wallet FROM ck WHERE failure IS NULL
   UNION ALL SELECT tx, origin, to_address FROM ck WHERE failure IS NULL) WHERE wallet NOT IN ('7', '13')),
 nd AS (SELECT tx, token, wallet, sum(amount) AS amount FROM (SELECT tx, token, recipient AS wallet, amount FROM mv
   UNION ALL SELECT tx, token, sender, -amount FROM mv) GROUP BY ALL
   UNION ALL SELECT tx, NULL, wallet, sum(delta) FROM nat GROUP BY ALL),
 lg AS (SELECT tx, wallet, origin, sum(CASE WHEN token IS NULL OR token = 'WRAPPED' THEN amount ELSE 0 END) AS quote,
     count(CASE WHEN token <> 'WRAPPED' AND amount <> 0 THEN 1 END) AS tokens,
     max(CASE WHEN token <> 'WRAPPED' AND amount <> 0 THEN token END) AS token,
     sum(CASE WHEN token <> 'WRAPPED' AND amount <> 0 THEN amount END) AS quantity
   FROM who JOIN nd USING (tx, wallet) GROUP BY tx, wallet, origin),
 ok AS (SELECT *, count(*) OVER (PARTITION BY tx) AS n, bool_or(wallet = origin) OVER (PARTITION BY tx) AS own FROM lg
   WHERE tokens = 1 AND sign(quantity) * sign(quote) < 0),
 best AS (SELECT * FROM ok WHERE (own AND wallet = origin) OR (NOT own AND n = 1)),
 attributed AS (SELECT ck.tx, CASE WHEN failure IS NULL AND best.tx IS NOT NULL THEN 'complete' ELSE 'ambiguous' END AS status,
   coalesce(failure, CASE WHEN best.tx IS NULL THEN 'Cannot isolate one holder with opposing token and ETH/WETH flows' END) AS reason,
   best.wallet, best.token, CAST(quantity AS BIGINT) AS quantity, CAST(quote AS BIGINT) AS quote,
   CASE WHEN quantity > 0 THEN 'buy' WHEN quantity < 0 THEN 'sell' END AS side FROM ck LEFT JOIN best USING (tx)),
 known AS (SELECT DISTINCT tx, token FROM swaps WHERE pool % 17 <> 0),
 judged AS (SELECT a.*, a.status = 'complete' AND k.tx IS NULL AS lost FROM attributed a LEFT JOIN known k USING (tx, token)),
 reviewed AS (SELECT tx, CASE WHEN lost THEN 'ambiguous' ELSE status END AS status,
   CASE WHEN lost THEN 'Wallet asset not in indexed swap pools' ELSE reason END AS reason,
   CASE WHEN NOT lost THEN wallet END AS wallet, CASE WHEN NOT lost THEN token END AS token,
   CASE WHEN NOT lost THEN quantity END AS quantity, CASE WHEN NOT lost THEN quote END AS quote,
   CASE WHEN NOT lost THEN side END AS side FROM judged)"""


def attributed(t):
    part = {name: t.sql(f"WITH {ATTR} SELECT * FROM {name}") for name in ("rc", "mv", "nat")}
    excluded = t.supplier.filter("s_suppkey IN (7, 13)").select(C("s_suppkey").cast("string").alias("wallet"))
    emitters = t.swap_keys.select("tx", F.concat(F.lit("P"), C("pool").cast("string")).alias("wallet"))
    native = part["nat"].groupBy("tx", "wallet").agg(F.sum("delta").alias("delta"))
    return at.attribute_flows(part["rc"], part["mv"], native, emitters, excluded, "WRAPPED")


def reviewed(t):
    return at.attribution_status(attributed(t), t.swaps.filter("pool % 17 <> 0"))


@query("pip_06_attribute_flows", "WITH" + ATTR_SQL + " SELECT * FROM attributed")
def attribute_flows(t):
    return attributed(t)


@query("pip_07_attribution_status", "WITH" + ATTR_SQL + " SELECT * FROM reviewed")
def attribution_status(t):
    return reviewed(t)


LIVE_FLOWS = """ seen AS (SELECT r.tx, r.status, x.ts, CASE WHEN r.tx % 43 = 0 THEN 'other' ELSE r.wallet END AS wallet, r.token
   FROM reviewed r JOIN txs x USING (tx))"""


@query("pip_33_live_flow_capture", "WITH" + ATTR_SQL + "," + LIVE_FLOWS + """
 SELECT s.tx, s.wallet, s.token, s.ts, (SELECT max(ts) FROM txs) AS seen_at, r.side, abs(r.quote) AS quote
 FROM seen s JOIN reviewed r ON r.tx = s.tx AND r.wallet = s.wallet AND r.token = s.token
 WHERE s.status = 'complete' AND s.ts >= (SELECT max(ts) FROM txs) - 31536000 AND s.tx % 5 <> 0""")
def live_flow_capture(t):
    rows = reviewed(t)
    seen = rows.join(t.txs.select("tx", "ts"), "tx").select(
        "tx", "status", "ts", F.when(C("tx") % 43 == 0, "other").otherwise(C("wallet")).alias("wallet"), "token")
    done = t.txs.filter("tx % 5 = 0").select("tx")
    now = t.txs.select(F.max("ts")).scalar()
    return at.capture_live_flows(seen, rows, done, now, 31536000)


BUYERS = """ w AS (SELECT tx, CASE WHEN status_code = 'F' THEN 'complete' WHEN status_code = 'P' THEN 'ambiguous' END AS status,
    origin AS wallet, CASE WHEN tx % 3 = 0 THEN 'sell' ELSE 'buy' END AS side FROM txs WHERE status_code <> 'O'),
  an AS (SELECT token, max(ts) - 8640000 AS at FROM swaps GROUP BY token),
  near AS (SELECT s.*, an.at FROM swaps s JOIN an USING (token) WHERE s.ts BETWEEN an.at - 31536000 AND an.at
    AND s.block <= 2300)"""


def buyer_inputs(t):
    reviews = t.sql("WITH" + BUYERS.split(",\n  an AS")[0] + " SELECT * FROM w")
    anchors = t.swaps.groupBy("token").agg((F.max("ts") - 8640000).alias("at")).withColumn("height", F.lit(2300))
    swaps = t.swaps.withColumn("attributed", C("pool") % 4 == 0)
    return at.recent_buyers(swaps, reviews, anchors, 31536000)


@query("pip_34_recent_buyers", "WITH" + BUYERS + """
 SELECT DISTINCT token, buyer FROM (
   SELECT near.token, w.wallet AS buyer FROM near JOIN w USING (tx) WHERE w.status = 'complete' AND w.side = 'buy'
   UNION ALL SELECT token, wallet FROM near WHERE pool % 4 = 0 AND side = 'buy')""")
def recent_buyers(t):
    return buyer_inputs(t)[0]


@query("pip_34_buyer_coverage", "WITH" + BUYERS + """
 SELECT token, CAST(count(DISTINCT tx) AS BIGINT) AS transactions,
   CAST(count(DISTINCT CASE WHEN w.status IS NOT NULL THEN tx END) AS BIGINT) AS reviewed,
   CAST(count(DISTINCT CASE WHEN w.status = 'ambiguous' THEN tx END) AS BIGINT) AS ambiguous,
   CAST(count(DISTINCT tx) - count(DISTINCT CASE WHEN w.status IS NOT NULL THEN tx END) AS BIGINT) AS pending
 FROM near LEFT JOIN w USING (tx) GROUP BY token""")
def buyer_coverage(t):
    return buyer_inputs(t)[1]


@query("pip_35_attribution_backlog", """
 WITH n AS (SELECT max(ts) AS now FROM swap_keys),
  c AS (SELECT tx, min(ts) AS ts, min(block) AS block, min(token) AS token, min(CASE side WHEN 'buy' THEN 0 ELSE 1 END) AS sell
    FROM swaps, n WHERE ts BETWEEN now - 15552000 AND now AND tx % 4 <> 0 GROUP BY tx),
  r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY sell, ts DESC, tx) AS token_rank FROM c),
  b AS (SELECT token, count(DISTINCT wallet) AS buyers FROM swaps WHERE side = 'buy' AND tx % 4 = 0 GROUP BY token),
  a AS (SELECT DISTINCT token FROM swaps WHERE token NOT LIKE '%3')
 SELECT tx, token, ts, block, sell, token_rank, CAST(coalesce(buyers, 0) AS BIGINT) AS buyers, a.token IS NOT NULL AS assessed
 FROM r LEFT JOIN b USING (token) LEFT JOIN a USING (token)
 ORDER BY coalesce(buyers, 0) >= 2, sell, assessed DESC, token_rank, ts DESC, tx LIMIT 60""")
def attribution_backlog(t):
    now = t.swap_keys.select(F.max("ts")).scalar()
    buyers = t.swaps.filter("side = 'buy' AND tx % 4 = 0").groupBy("token").agg(
        F.countDistinct("wallet").alias("buyers"))
    return at.backlog(t.swaps, t.txs.filter("tx % 4 = 0"), buyers, t.swaps.filter("token NOT LIKE '%3'"), now, 15552000, 60)


@query("pip_42_creator_history", """
 SELECT p_partkey AS token, p_brand AS deployer, p_type || p_size AS initiator,
   CAST(count(*) OVER (PARTITION BY p_type || p_size) AS BIGINT) AS observed_deployments FROM part""")
def creator_history(t):
    creators = t.part.select(C("p_partkey").alias("token"), C("p_brand").alias("deployer"),
                             F.concat("p_type", C("p_size").cast("string")).alias("initiator"))
    return at.creator_history(creators)


@query("pip_50_pool_keys", f"""
 SELECT p_partkey * 3 AS tx, {HASH.format('p_partkey')} AS pool, CASE WHEN p_partkey % 9 <> 2 AND p_partkey % 10 <> 0
   THEN p_partkey % 7 - 3 END AS tick_spacing, CASE WHEN p_partkey % 9 <> 2 AND p_partkey % 10 <> 0 THEN 'resolved'
   ELSE 'pool_key_unavailable' END AS state FROM part WHERE p_partkey % 3 = 2""")
def pool_keys(t):
    logs = raw.creation_logs(t.part.select("p_partkey")).withColumns({"tx": C("pool") * 3, "words": d.words(C("data"))})
    logs = logs.withColumn("made", d.pool_created(C("address"), C("topics"), C("words")))
    creation = logs.filter("pool % 9 <> 2 AND made IS NOT NULL").select("tx", C("made.pool").alias("pool"), "words")
    pools = t.part.filter("p_partkey % 3 = 2").select((C("p_partkey") * 3).alias("tx"), raw.hash32(C("p_partkey")).alias("pool"))
    tick = wide.to_decimal(d.signed(F.try_element_at("words", F.lit(2)))).cast("bigint")
    return at.pool_keys(pools, creation, tick)
