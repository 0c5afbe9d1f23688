"""Window operators."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.operators import joins, scan, windows
from onledger.operators.aggregates import earliest
from onledger.params import ScanRules

ORDER = "ts, tx, log_index, pool, origin, quantity, quote, gas, side"


@query("win_01_first_buy", f"""
 SELECT wallet, token, ts, tx, pool FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY {ORDER}) AS rn
   FROM flows WHERE side = 'buy') WHERE rn = 1""")
def first_buy(t):
    buys = t.flows.filter("side = 'buy'")
    return earliest(buys, ["wallet", "token"], ORDER.split(", ")).select("wallet", "token", "ts", "tx", "pool")


@query("win_02_priority_rank", """
 SELECT token, tx, log_index, pool, wallet, side, ts, row_number() OVER (PARTITION BY token
   ORDER BY CASE side WHEN 'buy' THEN 0 ELSE 1 END, ts DESC, tx, log_index, pool, wallet, origin, quantity, quote, gas) AS rank
 FROM flows""")
def priority_rank(t):
    rows = t.flows.withColumns({"_sell": F.when(F.col("side") == "buy", 0).otherwise(1), "_newest": -F.col("ts")})
    bucket = scan.width_bucket("_newest", ScanRules().bucket_seconds) + F.col("_sell") * 1_000_000_000
    ranked = scan.row_numbers(rows, ["token"], ["_sell", "_newest", "tx", "log_index", "pool", "wallet", "origin",
                                                "quantity", "quote", "gas"], bucket, "rank")
    return ranked.select("token", "tx", "log_index", "pool", "wallet", "side", "ts", "rank")


@query("win_04_candle_trend", """
 WITH g AS (SELECT start, close_cents, count(*) OVER s20 AS n, start - min(start) OVER s20 AS span,
     sum(close_cents) OVER (ORDER BY start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f,
     sum(close_cents) OVER s20 AS s, min(close_cents) OVER s20 AS low,
     CASE WHEN close_cents > lag(close_cents) OVER (ORDER BY start) THEN 1 ELSE 0 END AS up FROM candles
   WINDOW s20 AS (ORDER BY start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  h AS (SELECT *, sum(up) OVER (ORDER BY start ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS ups,
     n = 20 AND span = 19 * 3600 AND low > 0 AS whole FROM g)
 SELECT start, close_cents, CASE WHEN whole THEN f / 5.0::DOUBLE END AS sma_fast,
   CASE WHEN whole THEN s / 20.0::DOUBLE END AS sma_slow, CASE WHEN whole THEN ups / 19.0::DOUBLE END AS rising_fraction,
   CASE WHEN whole THEN start + 3600 END AS candle_end FROM h""")
def candle_trend(t):
    return windows.candle_trend(t.candles.select("start", "close_cents"), [], 3600, block=64)


@query("win_05_cooldown", """
 SELECT quote_id, user_id, ts, prev AS last_sell, coalesce(ts - prev < 21600, false) AS cooling FROM (
   SELECT *, max(CASE WHEN token = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, quote_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM quotes)""")
def cooldown(t):
    out = windows.previous_of_kind(t.quotes, ["user_id"], ["ts", "quote_id"], "ts", F.col("token") == "error", "last_sell")
    return out.select("quote_id", "user_id", "ts", "last_sell",
                      F.coalesce(F.col("ts") - F.col("last_sell") < 21600, F.lit(False)).alias("cooling"))


@query("win_07_first_touch", """
 WITH p AS (SELECT *, IDIV(ts, 86400) AS day, first_value(cents) OVER w AS entry, first_value(ts) OVER w AS entry_ts
   FROM quotes WINDOW w AS (PARTITION BY user_id, IDIV(ts, 86400) ORDER BY ts, quote_id)),
  k AS (SELECT *, CASE WHEN cents * 100 <= entry * 92 THEN 'stop_loss' WHEN cents * 100 >= entry * 120 THEN 'take_profit'
     WHEN ts - entry_ts >= 43200 THEN 'time_exit' END AS trigger FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, quote_id) AS rn FROM k WHERE trigger IS NOT NULL)
 SELECT user_id, day, trigger, quote_id, ts, cents FROM r WHERE rn = 1""")
def first_touch(t):
    rows = t.quotes.withColumn("day", F.floor(F.col("ts") / 86400).cast("bigint"))
    entry = rows.groupBy("user_id", "day").agg(
        F.min_by(F.struct(F.col("cents").alias("entry"), F.col("ts").alias("entry_ts")),
                 F.struct("ts", "quote_id")).alias("e")).select("user_id", "day", "e.*")
    path = rows.join(entry, ["user_id", "day"])
    trigger = (F.when(F.col("cents") * 100 <= F.col("entry") * 92, "stop_loss")
               .when(F.col("cents") * 100 >= F.col("entry") * 120, "take_profit")
               .when(F.col("ts") - F.col("entry_ts") >= 43200, "time_exit"))
    return windows.first_touch(path, ["user_id", "day"], trigger, ["ts", "quote_id"], ["quote_id", "ts", "cents"])


@query("win_08_greedy_pairs", """
 WITH RECURSIVE d AS (SELECT token, IDIV(block, 30) AS span, wallet, origin % 40 AS origin,
     min([ts, tx, log_index, pool, quantity, quote]) AS place
   FROM flows WHERE side = 'buy' GROUP BY 1, 2, 3, 4),
  n AS (SELECT *, row_number() OVER (PARTITION BY token, span ORDER BY place) AS i FROM d),
  f AS (SELECT token, span, i, wallet, origin, true AS ok, [wallet] AS ws, [origin] AS os FROM n WHERE i = 1
   UNION ALL
   SELECT n.token, n.span, n.i, n.wallet, n.origin, NOT list_contains(f.ws, n.wallet) AND NOT list_contains(f.os, n.origin),
     CASE WHEN NOT list_contains(f.ws, n.wallet) AND NOT list_contains(f.os, n.origin) THEN list_append(f.ws, n.wallet)
       ELSE f.ws END,
     CASE WHEN NOT list_contains(f.ws, n.wallet) AND NOT list_contains(f.os, n.origin) THEN list_append(f.os, n.origin)
       ELSE f.os END
   FROM f JOIN n ON n.token = f.token AND n.span = f.span AND n.i = f.i + 1)
 SELECT f.token, f.span, f.wallet, f.origin, n.place[1] AS ts, n.place[2] AS tx FROM f JOIN n USING (token, span, i)
 WHERE f.ok""")
def greedy_pairs(t):
    buys = t.flows.filter("side = 'buy'").withColumns(
        {"span": F.floor(F.col("block") / 30).cast("bigint"), "origin": F.col("origin") % 40})
    out = windows.greedy_pairs(buys, ["token", "span"], "wallet", "origin",
                               ["ts", "tx", "log_index", "pool", "quantity", "quote"])
    return out.select("token", "span", "wallet", "origin", "ts", "tx")


@query("win_09_trailing_counts", """
 SELECT a.token, a.quote_id, a.ts, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT f.user_id) AS BIGINT) AS users
 FROM quotes a JOIN quotes f ON f.token = a.token AND f.ts BETWEEN a.ts - 43200 AND a.ts
 GROUP BY a.token, a.quote_id, a.ts""")
def trailing_counts(t):
    one = F.lit(1).cast("bigint")
    n = joins.range_totals(t.quotes, t.quotes, ["token"], ["quote_id"], "ts", "ts", 43200, {"n": one})
    users = joins.trailing_distinct(t.quotes, t.quotes, ["token"], ["quote_id"], "ts", "user_id", "quote_id", 43200, "users")
    return n.join(users, ["token", "quote_id", "ts"])


@query("win_10_schedule_gaps", """
 WITH c AS (SELECT token, IDIV(ts, 86400) AS day FROM quotes GROUP BY 1, 2),
  due AS (SELECT token, day, unnest(generate_series(day * 86400, day * 86400 + 82800, 3600)) AS step_at FROM c),
  seen AS (SELECT DISTINCT token, IDIV(ts, 86400) AS day, IDIV(ts, 3600) * 3600 AS step_at FROM quotes)
 SELECT token, day, CAST(count(*) AS BIGINT) AS steps, CAST(count(*) - count(s.step_at) AS BIGINT) AS missing,
   min(CASE WHEN s.step_at IS NULL THEN due.step_at END) AS first_gap, count(*) > count(s.step_at) AS has_gaps
 FROM due LEFT JOIN seen s USING (token, day, step_at) GROUP BY token, day""")
def schedule_gaps(t):
    rows = t.quotes.withColumns({"day": F.floor(F.col("ts") / 86400).cast("bigint"),
                                 "step_at": (F.floor(F.col("ts") / 3600) * 3600).cast("bigint")})
    cases = rows.select("token", "day").distinct().withColumns(
        {"first": F.col("day") * 86400, "last": F.col("day") * 86400 + 82800})
    return windows.schedule_gaps(cases, rows, ["token", "day"], "first", "last", 3600)
