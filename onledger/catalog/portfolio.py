"""Audit, holder ledger, pool pricing and portfolio reports."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.functions import amounts, wide
from onledger.functions.pin import pinned
from onledger.operators import joins
from onledger.plans import portfolio as pf
from onledger.plans.signals import net_deltas
from onledger.session import materialize

C = F.col

AUDIT_EVENTS = """SELECT wallet, token, ts, tx, log_index, pool, origin, side, quantity,
  CASE WHEN side = 'buy' AND tx % 5 <> 0 THEN quote + gas END AS cost, CASE WHEN side = 'sell' AND tx % 7 <> 0 THEN quote - gas END AS proceeds,
  gas FROM atomic_flows"""
OPENING = "SELECT DISTINCT wallet, token, ATOMIC(20) AS quantity FROM atomic_flows WHERE wallet % 2 = 0"
AUDIT_SQL = f""" ev AS ({AUDIT_EVENTS} UNION ALL SELECT wallet, token, -1, 0, 0, 0, 0, 'buy', quantity, NULL, NULL, 0 FROM ({OPENING}) x),
 o1 AS (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY ts, tx, log_index, pool, origin, quantity, side) AS rn FROM ev),
 o2 AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER w AS s,
   sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS bought FROM o1 WINDOW w AS (PARTITION BY wallet, token ORDER BY rn)),
 o3 AS (SELECT *, s - CASE WHEN side = 'buy' THEN quantity ELSE -quantity END - least(0, coalesce(min(s) OVER (PARTITION BY wallet, token
   ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS held FROM o2),
 b1 AS (SELECT *, bought - quantity AS lo, bought AS hi FROM o3 WHERE side = 'buy'),
 s1 AS (SELECT *, bought - held AS lo, bought - held + least(quantity, held) AS hi FROM o3 WHERE side = 'sell' AND proceeds IS NOT NULL),
 ml AS (SELECT s1.wallet, s1.token, s1.rn, s1.tx, s1.ts, s1.log_index, s1.pool, s1.origin, s1.quantity AS sold, s1.proceeds,
   max(s1.quantity - (s1.hi - s1.lo)) + coalesce(sum(CASE WHEN b1.rn IS NOT NULL AND b1.cost IS NULL
     THEN least(b1.hi, s1.hi) - greatest(b1.lo, s1.lo) END), 0) AS unknown_quantity,
   coalesce(sum(CASE WHEN b1.cost IS NOT NULL THEN (least(b1.hi, s1.hi) - greatest(b1.lo, s1.lo)) * b1.cost / b1.quantity END), 0) AS cost
   FROM s1 LEFT JOIN b1 ON b1.wallet = s1.wallet AND b1.token = s1.token AND b1.lo < s1.hi AND s1.lo < b1.hi GROUP BY ALL),
 sales AS (SELECT *, CASE WHEN unknown_quantity = 0 THEN proceeds - cost END AS pnl FROM (
   SELECT * EXCLUDE (cost), CASE WHEN unknown_quantity = 0 THEN cost::DOUBLE END AS cost FROM ml))"""


def stored_flows(t):
    """The joined flows, written once for events, opening stock and balances."""
    return materialize(t.atomic_flows.select("wallet", "token", "ts", "tx", "log_index", "pool", "origin", "side", "quantity", "quote", "gas"), "flows")


def placed(t, flows):
    return pf.place_audit_events(t.sql(AUDIT_EVENTS, atomic_flows=flows), t.sql(OPENING, atomic_flows=flows))


@query("pip_11_audit_fifo", "WITH" + AUDIT_SQL + """
 SELECT wallet, token, tx, ts, log_index, pool, origin, TEXT(sold) AS sold, proceeds, TEXT(unknown_quantity) AS unknown_quantity,
   round(cost, 6) AS cost, round(pnl, 6) AS pnl FROM sales""")
def audit_fifo(t):
    sales = pf.audit_fifo(placed(t, stored_flows(t)), narrow=True)
    return sales.withColumns({
        "cost": F.round("cost", 6), "pnl": F.round("pnl", 6), "proceeds": C("proceeds").cast("bigint"),
        "sold": amounts.text(sales, "sold"), "unknown_quantity": amounts.text(sales, "unknown_quantity")})


BALANCES = """SELECT wallet, token, CASE WHEN wallet % 2 = 0 THEN ATOMIC(20) ELSE ATOMIC(0) END AS opening, CASE WHEN wallet % 11 <> 0 THEN
  sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) + CASE WHEN wallet % 2 = 0 THEN ATOMIC(20) ELSE ATOMIC(0) END
  + CASE WHEN wallet % 13 = 0 THEN 1 ELSE 0 END END AS ending FROM atomic_flows GROUP BY wallet, token"""


@query("pip_12_wallet_audit", "WITH" + AUDIT_SQL + f""",
 bal AS ({BALANCES}),
 tk AS (SELECT wallet, token, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS delta, count(*) AS events, sum(gas) AS fees
   FROM ev WHERE ts >= 0 GROUP BY wallet, token),
 fin AS (SELECT wallet, token, arg_max(s, rn) - least(0, min(s)) AS remaining FROM o2 GROUP BY wallet, token),
 tt AS (SELECT tk.*, bal.opening, coalesce(bal.opening + delta = ending, false) AS reconciled, remaining FROM tk JOIN bal USING (wallet, token)
   JOIN fin USING (wallet, token)),
 pw AS (SELECT wallet, CAST(sum(events) AS BIGINT) AS transfer_events, count(*) AS tokens, count(CASE WHEN reconciled THEN 1 END) AS tokens_reconciled,
   count(CASE WHEN opening > 0 THEN 1 END) AS tokens_with_opening, count(CASE WHEN remaining > 0 THEN 1 END) AS open_positions,
   CAST(sum(fees) AS BIGINT) AS fees FROM tt GROUP BY wallet),
 js AS (SELECT s.*, pnl IS NOT NULL AND reconciled AS good FROM sales s JOIN tt USING (wallet, token)),
 rs AS (SELECT wallet, count(CASE WHEN good THEN 1 END) AS matched_sales, count(CASE WHEN NOT good THEN 1 END) AS unmatched_sales,
   count(CASE WHEN good AND pnl > 0 THEN 1 END) AS winning_sales, sum(CASE WHEN good THEN pnl END) AS pnl,
   sum(CASE WHEN good THEN cost END) AS cost FROM js GROUP BY wallet)
 SELECT pw.*, coalesce(matched_sales, 0) AS matched_sales, coalesce(unmatched_sales, 0) AS unmatched_sales,
   coalesce(winning_sales, 0) AS winning_sales, round(pnl, 4) AS pnl, round(CASE WHEN cost <> 0 THEN pnl / cost * 100 END, 6) AS return_pct
 FROM pw LEFT JOIN rs USING (wallet)""")
def wallet_audit(t):
    flows = stored_flows(t)
    rows = placed(t, flows)
    out = pf.wallet_audit(rows, pf.audit_fifo(rows), t.sql(BALANCES, atomic_flows=flows))
    return out.withColumns({"pnl": F.round("pnl", 4), "return_pct": F.round("return_pct", 6), "fees": C("fees").cast("bigint")})


@query("pip_13_predeployment_zero", """
 SELECT p_partkey AS token, p_size AS height, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 3 WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 4 THEN 0 END AS balance FROM part""")
def predeployment_zero(t):
    k = C("p_partkey")
    opening = t.part.select(k.alias("token"), C("p_size").alias("height"), F.when(k % 4 != 0, C("p_size") * 3).alias("balance"))
    code = t.part.filter(k % 5 != 4).select(k.alias("token"), C("p_size").alias("height"),
                                            F.when(k % 3 == 0, "0x").when(k % 3 == 1, "0x6080").alias("code"))
    return pf.predeployment_zero(opening, code)


HISTORY = """SELECT origin AS wallet, tx AS hash, block, block * 7 AS block_hash, CASE WHEN tx % 4 = 0 THEN -1 ELSE origin END AS sender,
  CASE WHEN tx % 4 = 0 THEN origin ELSE tx % 50 END AS recipient, total_cents AS gas_used, CAST(3 AS BIGINT) AS gas_price,
  CASE WHEN status_code = 'P' THEN 0 ELSE 1 END AS status, status_code = 'P' AS failed FROM txs WHERE tx % 13 <> 0"""
RECEIPTS = """SELECT origin AS wallet, tx AS hash, block, block * 7 AS block_hash, CASE WHEN tx % 6 = 5 THEN -2 WHEN tx % 4 = 0 THEN -1
  ELSE origin END AS sender, CASE WHEN tx % 6 = 5 THEN -3 WHEN tx % 4 = 0 THEN origin ELSE tx % 50 END AS recipient,
  CASE WHEN tx % 17 = 0 THEN total_cents + 1 ELSE total_cents END AS gas_used, CAST(3 AS BIGINT) AS gas_price,
  CASE WHEN status_code = 'P' THEN 0 ELSE 1 END AS status FROM txs WHERE tx % 5 <> 0"""


@query("pip_14_explorer_crosscheck", f"""
 WITH h AS ({HISTORY}), r AS (SELECT *, NOT (wallet = sender OR wallet = recipient) AS internal FROM ({RECEIPTS}) x),
 j AS (SELECT coalesce(h.wallet, r.wallet) AS wallet, h.hash AS hh, r.hash AS rh, h.gas_used IS NOT DISTINCT FROM r.gas_used AS same
   FROM h FULL JOIN (SELECT * FROM r WHERE NOT internal) r ON h.wallet = r.wallet AND h.hash = r.hash),
 s AS (SELECT wallet, count(CASE WHEN hh IS NOT NULL AND rh IS NOT NULL AND same THEN 1 END) AS receipt_matches,
   count(CASE WHEN hh IS NULL THEN 1 END) AS missing, count(CASE WHEN hh IS NOT NULL AND rh IS NOT NULL AND NOT same THEN 1 END) AS mismatched
   FROM j GROUP BY wallet),
 tot AS (SELECT wallet, count(*) AS external_transactions, count(CASE WHEN sender = wallet AND failed THEN 1 END) AS outgoing_failed,
   CAST(sum(CASE WHEN sender = wallet THEN gas_used * gas_price ELSE 0 END) AS BIGINT) AS outgoing_fees,
   count(CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.wallet = h.wallet AND r.hash = h.hash) THEN 1 END) AS without_token_events FROM h GROUP BY wallet),
 i AS (SELECT wallet, count(*) AS internal_transactions FROM r WHERE internal GROUP BY wallet)
 SELECT wallet, receipt_matches, missing, mismatched, coalesce(external_transactions, 0) AS external_transactions,
   coalesce(outgoing_failed, 0) AS outgoing_failed, coalesce(outgoing_fees, 0) AS outgoing_fees,
   coalesce(internal_transactions, 0) AS internal_transactions, coalesce(without_token_events, 0) AS without_token_events,
   CASE WHEN missing = 0 AND mismatched = 0 THEN 'matched' ELSE 'disagreement' END AS status
 FROM s LEFT JOIN tot USING (wallet) LEFT JOIN i USING (wallet)""")
def explorer_crosscheck(t):
    return pf.explorer_crosscheck(t.sql(HISTORY), t.sql(RECEIPTS))


# all transfers, whose senders mostly never received anything, and as tokens of their own the minted part, which adds up
LEDGER_MOVES = """SELECT token, sender, recipient, amount FROM atomic_transfers
  UNION ALL SELECT 'm' || token, sender, recipient, amount FROM atomic_transfers WHERE sender = '0x0'"""
SUPPLY = f"""SELECT token, sum(amount) + CASE WHEN token LIKE '%5' THEN 1 ELSE 0 END AS supply FROM ({LEDGER_MOVES}) x WHERE sender = '0x0' GROUP BY token"""


@query("pip_15_holder_ledger", f"""
 WITH m AS ({LEDGER_MOVES}), su AS ({SUPPLY}),
 b AS (SELECT token, w, sum(a) AS amount FROM (SELECT token, recipient AS w, amount AS a FROM m UNION ALL SELECT token, sender, -amount FROM m)
   WHERE w <> '0x0' GROUP BY token, w),
 k AS (SELECT token, min(amount) AS low, sum(amount) AS total FROM b GROUP BY token),
 r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY amount DESC, w) AS rn FROM b WHERE amount > 0),
 h AS (SELECT token, count(*) AS holders, sum(CASE WHEN rn <= 10 THEN amount END)::DOUBLE / sum(amount)::DOUBLE AS share FROM r GROUP BY token),
 j AS (SELECT su.token, CASE WHEN low < 0 THEN 'negative_balance' WHEN total <> supply THEN 'supply_mismatch' END AS reason, holders, share
   FROM su JOIN k USING (token) LEFT JOIN h USING (token))
 SELECT token, CASE WHEN reason IS NULL THEN 'reconciled' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NULL THEN holders END AS holders,
   CASE WHEN reason IS NULL THEN share END AS top10_share FROM j""")
def holder_ledger(t):
    return pf.holder_ledger(t.sql(LEDGER_MOVES), t.sql(SUPPLY))


# balances someone observed: one in a hundred wallets is missing, another is off by one atomic unit
NET = """SELECT token, wallet, sum(amount) AS amount FROM (SELECT token, recipient AS wallet, amount FROM atomic_transfers
  UNION ALL SELECT token, sender, -amount FROM atomic_transfers) x WHERE wallet <> '0x0' GROUP BY token, wallet"""
OBSERVED = f"SELECT token, wallet, amount + CASE WHEN wallet LIKE '%77' THEN 1 ELSE 0 END AS amount FROM ({NET}) y WHERE wallet NOT LIKE '%99'"


@query("pip_16_balance_reconcile", f"""
 WITH ob AS ({OBSERVED}), l AS ({NET})
 SELECT l.token, l.wallet, CASE WHEN ob.amount IS NULL THEN 'left_only' WHEN ob.amount <> l.amount THEN 'mismatched' ELSE 'matched' END AS status
 FROM l LEFT JOIN ob USING (token, wallet)""")
def balance_reconcile(t):
    moves = amounts.exact(t.atomic_transfers.select("token", "sender", "recipient", "amount"), ("amount",))
    ledger = net_deltas(moves, ["token"]).withColumnRenamed("delta", "amount")
    observed = amounts.exact(t.sql(OBSERVED), ("amount",))
    return joins.reconcile(ledger, observed, ["token", "wallet"], ["amount"]).select("token", "wallet", "status")


POOLS = """SELECT p_partkey AS pool, (p_partkey % 97) * CAST(1000000000000000 AS BIGINT) AS quote_reserve, (p_partkey % 89) * CAST(10000000000 AS BIGINT)
  AS token_reserve, p_partkey % 19 AS decimals, 1500 + p_size * 1.0E0 AS rate, p_partkey % 7 AS lp_supply, p_partkey % 3 AS lp_burned,
  p_retailprice * 1.0E24 - 1000.0E24 AS sqrt_price, p_partkey % 2 AS quote_index, p_size AS amount FROM part"""


@query("pip_17_pool_state", f"""
 WITH p AS ({POOLS})
 SELECT pool, CASE WHEN quote_reserve <> 0 AND token_reserve <> 0 THEN quote_reserve::DOUBLE * rate * CAST('1e' || decimals AS DOUBLE)
     / (token_reserve::DOUBLE * 1e18::DOUBLE) END AS price, quote_reserve::DOUBLE * rate * 2 / 1e18::DOUBLE AS liquidity,
   CASE WHEN lp_supply <> 0 THEN lp_burned::DOUBLE / lp_supply::DOUBLE END AS lp_burned_fraction,
   CASE WHEN lp_supply <> 0 THEN 'measured' ELSE 'undefined' END AS lp_burn_status FROM p""")
def pool_state(t):
    return pf.v2_state_metrics(t.sql(POOLS)).select("pool", "price", "liquidity", "lp_burned_fraction", "lp_burn_status")


@query("pip_18_concentrated_price", f"""
 WITH p AS (SELECT *, sqrt_price * sqrt_price / 6277101735386680763835789423207666416102355444464034512896.0::DOUBLE AS ratio FROM ({POOLS}) x)
 SELECT pool, CASE WHEN sqrt_price > 0 THEN CASE WHEN quote_index = 0 THEN 1 / ratio ELSE ratio END * CAST('1e' || decimals AS DOUBLE)
   / 1e18::DOUBLE * rate END AS price FROM p""")
def concentrated_price(t):
    price = pf.concentrated_price(C("sqrt_price"), C("quote_index"), C("decimals"), C("rate"))
    return t.sql(POOLS).select("pool", price.alias("price"))


# reserves of 10**18 to 10**29 atomic units; the products have more digits than any SQL type, so the check divides digit by digit
QUOTES = """SELECT p_partkey AS pool, ATOMIC(p_size) + p_partkey AS a, ATOMIC((p_partkey % 97) * 50000000) + p_partkey AS rq,
  ATOMIC((p_partkey % 89) * 900000000) + CASE WHEN p_partkey % 89 = 0 THEN 0 ELSE p_partkey END AS rt FROM part"""


def divided(rows: str, name: str, amount: str, reserve_in: str, reserve_out: str) -> str:
    """Long division to the base 10**5 of amount * 997 * reserve_out by reserve_in * 1000 + amount * 997."""
    out = f"SELECT *, 0::HUGEINT AS q, 0::HUGEINT AS r, {amount} * 997 AS n, {reserve_in} * 1000 + {amount} * 997 AS d FROM ({rows}) x0"
    for k in reversed(range(6)):
        now = f"(r * 100000 + n * ({reserve_out} // {10 ** (5 * k)}::HUGEINT % 100000))"
        out = f"SELECT * EXCLUDE (q, r), q * 100000 + {now} // d AS q, {now} % d AS r FROM ({out}) x{k + 1}"
    return f"SELECT * EXCLUDE (q, r, n, d), CASE WHEN {reserve_in} > 0 AND {reserve_out} > 0 THEN q END AS {name} FROM ({out}) x"


@query("pip_19_constant_product_quote", f"""
 SELECT pool, TEXT(bought) AS bought, TEXT(back) AS back, round(1 - back::DOUBLE / a::DOUBLE, 9) AS loss
 FROM ({divided(divided(QUOTES, "bought", "a", "rq", "rt"), "back", "bought", "rt", "rq")}) y""")
def constant_product_quote(t):
    rows = amounts.exact(t.sql(QUOTES), ("a", "rq", "rt"))
    rows = pinned(rows, "bought", pf.constant_product_quote(C("a"), C("rq"), C("rt")))
    rows = pinned(rows, "back", pf.constant_product_quote(C("bought"), C("rt"), C("rq")))
    loss = 1 - wide.to_double(C("back")) / wide.to_double(C("a"))
    return rows.select("pool", wide.to_text(C("bought")).alias("bought"), wide.to_text(C("back")).alias("back"), F.round(loss, 9).alias("loss"))


FILLS = """SELECT pool % 3 AS arm, token, tx * 10000000 + log_index * 1000000 + pool * 100 + wallet AS fill_id, ts, side, token_amount AS quantity,
  quote_amount AS amount, gas AS fee FROM swaps"""
FILLS_SQL = f""" fl AS (SELECT *, CASE WHEN side = 'buy' THEN -amount - fee ELSE amount - fee END AS cash_flow,
   row_number() OVER (ORDER BY arm, token, ts, fill_id, side, amount, fee) AS u FROM ({FILLS}) x),
 c AS (SELECT *, sum(cash_flow) OVER (PARTITION BY arm ORDER BY ts, fill_id, token, side, amount, fee, quantity) AS cash,
   sum(CASE WHEN side = 'buy' THEN -cash_flow ELSE 0 END) OVER (PARTITION BY arm, token ORDER BY ts, fill_id, side, amount, fee, quantity
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM fl),
 d AS (SELECT *, coalesce(max(CASE WHEN side = 'sell' THEN spent END) OVER (PARTITION BY arm, token ORDER BY ts, fill_id, side, amount, fee, quantity
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM c),
 ledger AS (SELECT *, CASE WHEN side = 'buy' THEN spent - closed ELSE 0 END AS position_cost,
   CASE WHEN side = 'sell' THEN cash_flow - (spent - closed) END AS pnl FROM d)"""
FILL_ORDER = ("ts", "fill_id", "token", "side", "amount", "fee", "quantity")


def stored_swaps(t):
    """The joined swaps, written once for the scans that read them."""
    return materialize(t.swaps.select("tx", "log_index", "pool", "token", "wallet", "side", "token_amount", "quote_amount", "gas", "ts"), "swaps")


@query("pip_39_trade_ledger", "WITH" + FILLS_SQL + """
 SELECT arm, token, fill_id, ts, side, CAST(cash AS BIGINT) AS cash, CAST(position_cost AS BIGINT) AS position_cost, CAST(pnl AS BIGINT) AS pnl FROM ledger""")
def trade_ledger(t):
    return pf.trade_ledger(t.sql(FILLS, swaps=stored_swaps(t)), order=FILL_ORDER).select(
        "arm", "token", "fill_id", "ts", "side", "cash", "position_cost", "pnl")


MARKS = "SELECT token, max_by(quote_amount, ts * 100000 + tx) % 5000 AS mark, max(ts) AS marked_at, max(tx) AS mark_id FROM swaps GROUP BY token"


@query("pip_38_portfolio_report", "WITH" + FILLS_SQL + f""",
 mk AS ({MARKS}),
 pt AS (SELECT arm, token, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS held, sum(cash_flow) AS flow, sum(fee) AS fees,
   count(*) AS fills, coalesce(sum(pnl), 0) AS pnl FROM ledger GROUP BY arm, token),
 vl AS (SELECT pt.*, held > 0 AND NOT coalesce((SELECT max(ts) FROM swap_keys) - marked_at <= 864000, false) AS stale,
   CASE WHEN held > 0 THEN held * mark ELSE 0 END AS value FROM pt LEFT JOIN mk USING (token))
 SELECT arm, CAST(sum(flow) + 4000 AS BIGINT) AS cash, CAST(sum(flow) + 4000 + sum(value) AS BIGINT) AS equity,
   CAST(sum(flow) + 4000 + coalesce(sum(CASE WHEN NOT stale THEN value END), 0) AS BIGINT) AS stressed_equity, CAST(sum(pnl) AS BIGINT) AS realized_pnl,
   CAST(sum(fees) AS BIGINT) AS fees, CAST(sum(fills) AS BIGINT) AS fills, count(CASE WHEN held > 0 THEN 1 END) AS open_positions,
   count(CASE WHEN stale THEN 1 END) AS stale_positions FROM vl GROUP BY arm""")
def portfolio_report(t):
    swaps = stored_swaps(t)
    ledger = pf.trade_ledger(t.sql(FILLS, swaps=swaps), order=FILL_ORDER)
    now = t.swap_keys.select(F.max("ts")).scalar()
    return pf.portfolio_report(ledger, t.sql(MARKS, swaps=swaps), 4000, now, 864000)
