"""Wallet results: FIFO matching, open lots, profiles."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.functions import amounts, wide
from onledger.operators import lots
from onledger.plans import wallets
from onledger.session import materialize

# The check matches pairs of overlapping intervals, a different method from the job's lookups along the position line.
FIFO_CTES = """
 o AS (SELECT *, row_number() OVER (PARTITION BY wallet, token
         ORDER BY ts, tx, log_index, pool, origin, quantity, quote, gas, side) AS rn FROM atomic_flows),
 r AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER w AS s,
         sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS bought
       FROM o WINDOW w AS (PARTITION BY wallet, token ORDER BY rn)),
 mm AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY wallet, token ORDER BY rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m FROM r),
 k AS (SELECT *, s - (CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) - m AS held FROM mm),
 p AS (SELECT *, side = 'sell' AND quantity > held AS unknown FROM k),
 ep AS (SELECT *, coalesce(sum(CASE WHEN unknown THEN 1 ELSE 0 END) OVER (PARTITION BY wallet, token ORDER BY rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM p),
 fb AS (SELECT *, side = 'buy' AND row_number() OVER (PARTITION BY wallet, token, side
         ORDER BY ts, tx, log_index, pool, origin, quantity, quote, gas, side) = 1 AS first_buy FROM atomic_flows),
 er AS (SELECT *, 1 + coalesce(sum(CASE WHEN first_buy THEN 1 ELSE 0 END) OVER (PARTITION BY token
         ORDER BY ts, tx, log_index, pool, origin, quantity, quote, gas, side, wallet
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry_rank FROM fb),
 q AS (SELECT ep.*, CAST(er.entry_rank AS BIGINT) AS entry_rank,
         sum(CASE WHEN ep.side = 'buy' THEN ep.quantity ELSE 0 END) OVER e AS eb,
         sum(CASE WHEN ep.side = 'sell' AND NOT ep.unknown THEN ep.quantity ELSE 0 END) OVER e AS es
       FROM ep JOIN er USING (wallet, token, ts, tx, log_index, pool, origin, quantity, quote, gas, side)
       WINDOW e AS (PARTITION BY ep.wallet, ep.token, ep.epoch ORDER BY ep.rn)),
 b AS (SELECT *, eb - quantity AS lo, eb AS hi FROM q WHERE side = 'buy'),
 sl AS (SELECT *, es - quantity AS lo, es AS hi FROM q WHERE side = 'sell' AND NOT unknown),
 last_epoch AS (SELECT wallet, token, max(epoch + CASE WHEN unknown THEN 1 ELSE 0 END) AS final FROM ep
                GROUP BY wallet, token),
 mt AS (SELECT b.wallet, b.token, b.rn, b.ts AS opened_at, b.entry_rank, b.quantity, b.quote + b.gas AS cost, b.epoch,
          sum(CASE WHEN sl.rn IS NOT NULL THEN least(b.hi, sl.hi) - greatest(b.lo, sl.lo) END) AS used,
          sum((least(b.hi, sl.hi) - greatest(b.lo, sl.lo)) * (sl.quote - sl.gas) / sl.quantity) AS got,
          max(sl.ts) AS closed_at
        FROM b LEFT JOIN sl ON b.wallet = sl.wallet AND b.token = sl.token AND b.epoch = sl.epoch
          AND sl.lo < b.hi AND b.lo < sl.hi
        GROUP BY ALL),
 lots AS (SELECT mt.*, CASE WHEN coalesce(used, 0) = quantity THEN 'closed' WHEN mt.epoch = final THEN 'open'
          ELSE 'dropped' END AS state FROM mt JOIN last_epoch USING (wallet, token)),
 outcomes AS (SELECT wallet, token, opened_at, CAST(closed_at AS BIGINT) AS closed_at, got - cost AS pnl,
          (got - cost) / cost * 100 AS return_pct, CAST(closed_at - opened_at AS BIGINT) AS hold_seconds, entry_rank,
          quantity FROM lots WHERE state = 'closed')
"""


def texts(*names):
    return [wide.to_text(F.col(n)).alias(n) for n in names]


@query("win_06_running_inventory", """
 WITH """ + FIFO_CTES + """
 SELECT wallet, token, ts, tx, log_index, pool, origin, side, TEXT(quantity) AS quantity, TEXT(bought) AS bought,
   TEXT(held) AS held_before, unknown FROM p""")
def running_inventory(t):
    placed = lots.positions(amounts.exact(t.atomic_flows))
    return placed.select("wallet", "token", "ts", "tx", "log_index", "pool", "origin", "side", *texts("quantity", "bought", "held_before"),
                         (F.col("short") > wide.zero()).alias("unknown"))


@query("win_03_entry_rank", """
 WITH """ + FIFO_CTES + """
 SELECT token, wallet, ts, tx, log_index, pool, origin, side, CAST(entry_rank AS BIGINT) AS entry_rank FROM er""")
def entry_rank(t):
    flows = materialize(t.atomic_flows.select("wallet", "token", *lots.FLOW_ORDER), "flows")
    return lots.entry_ranks(flows).select("token", "wallet", "ts", "tx", "log_index", "pool", "origin", "side",
                                            "entry_rank")


@query("jon_14_fifo_match", """
 WITH """ + FIFO_CTES + """
 SELECT wallet, token, state, CAST(count(*) AS BIGINT) AS lots, TEXT(sum(quantity)) AS units,
   CAST(sum(cost) AS BIGINT) AS cost FROM lots GROUP BY wallet, token, state""")
def fifo_match(t):
    all_lots, _ = wallets.fifo(t.spread().atomic_flows, narrow=True)
    return all_lots.groupBy("wallet", "token", "state").agg(
        F.count("*").alias("lots"), amounts.of_column(all_lots, "quantity").total(F.col("quantity")).alias("units"),
        F.sum("cost").cast("bigint").alias("cost")).transform(lambda rows: rows.withColumn("units", amounts.text(rows, "units")))


@query("pip_08_fifo_outcomes", """
 WITH """ + FIFO_CTES + """
 SELECT wallet, token, opened_at, closed_at, round(pnl, 6) AS pnl, round(return_pct, 6) AS return_pct, hold_seconds,
   entry_rank, TEXT(quantity) AS quantity FROM outcomes""")
def fifo_outcomes(t):
    all_lots, _ = wallets.fifo(t.spread().atomic_flows, narrow=True)
    return wallets.fifo_outcomes(all_lots).withColumns(
        {"pnl": F.round("pnl", 6), "return_pct": F.round("return_pct", 6), "quantity": amounts.text(all_lots, "quantity")})


@query("pip_08_unknown_basis", """
 WITH """ + FIFO_CTES + """
 SELECT wallet, token, tx, log_index, ts, TEXT(quantity) AS quantity, TEXT(held) AS held, 'unmatched_sell_basis' AS reason
 FROM p WHERE unknown""")
def unknown_basis(t):
    return lots.unknown_basis(lots.positions(amounts.exact(t.atomic_flows))).select(
        "wallet", "token", "tx", "log_index", "ts", *texts("quantity"), wide.to_text(F.col("held_before")).alias("held"), "reason")


@query("pip_09_open_lots", """
 WITH """ + FIFO_CTES + """
 SELECT wallet, token, opened_at, TEXT(quantity) AS quantity, TEXT(quantity - coalesce(used, 0)) AS remaining,
   round(cost * (quantity - coalesce(used, 0)) / quantity, 6) AS remaining_cost,
   round(coalesce(got, 0) - cost * coalesce(used, 0) / quantity, 6) AS realized, entry_rank
 FROM lots WHERE state = 'open'""")
def open_lots(t):
    all_lots, _ = wallets.fifo(t.spread().atomic_flows, narrow=True)
    return wallets.open_lots(all_lots).withColumns(
        {"remaining_cost": F.round("remaining_cost", 6), "realized": F.round("realized", 6),
         "quantity": amounts.text(all_lots, "quantity"), "remaining": amounts.text(all_lots, "remaining")})


@query("pip_10_wallet_profile", """
 WITH """ + FIFO_CTES + """,
 res AS (SELECT wallet, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, count(DISTINCT token) AS toks,
           median(return_pct) AS med, median(entry_rank) AS med_rank, avg(hold_seconds) AS hold, sum(pnl) AS pnl
         FROM outcomes GROUP BY wallet),
 op AS (SELECT wallet, count(*) AS opens FROM lots WHERE state = 'open' GROUP BY wallet),
 un AS (SELECT wallet, count(*) AS unk FROM p WHERE unknown GROUP BY wallet),
 en AS (SELECT wallet, count(DISTINCT CASE WHEN side = 'buy' THEN token END) AS entered FROM atomic_flows GROUP BY wallet),
 j AS (SELECT en.wallet, entered, coalesce(n, 0) AS n, coalesce(wins, 0) AS wins, coalesce(toks, 0) AS toks, med,
         med_rank, hold, coalesce(pnl, 0) AS pnl, coalesce(opens, 0) AS opens, coalesce(unk, 0) AS unk
       FROM en LEFT JOIN res USING (wallet) LEFT JOIN op USING (wallet) LEFT JOIN un USING (wallet)),
 sc AS (SELECT *, round(greatest(0, least(100, 100.0::DOUBLE * (wins + 2) / (n + 4)
          + CASE WHEN med IS NULL THEN 0 ELSE greatest(-15, least(15, med / 2)) END - least(20, unk * 2))), 2) AS score FROM j)
 SELECT wallet, entered AS tokens_entered, n AS closed_lots, toks AS closed_tokens, wins, n - wins AS losses,
   round(med, 6) AS median_return_pct, med_rank AS median_entry_rank, round(hold, 6) AS mean_hold_seconds,
   round(pnl, 4) AS realized_pnl, opens AS open_lots, unk AS unknown_basis, score,
   n >= 10 AND toks >= 5 AND score >= 70 AND coalesce(med > 0, false) AND unk = 0 AS eligible FROM sc""")
def wallet_profile(t):
    all_lots, unknown = wallets.fifo(t.spread().atomic_flows, narrow=True)
    out = wallets.wallet_profile(t.atomic_flows, all_lots, unknown)
    return out.withColumns({
        "median_return_pct": F.round("median_return_pct", 6), "mean_hold_seconds": F.round("mean_hold_seconds", 6),
        "realized_pnl": F.round("realized_pnl", 4)})
