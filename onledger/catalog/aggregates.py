"""Aggregation operators."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.catalog.joins import CASES, LOGS, logs
from onledger.functions import bigint
from onledger.operators import aggregates as agg
from onledger.plans import quality, signals
from onledger.operators.scan import same_keys


@query("agg_01_status_counts", """
 SELECT version, status, CAST(count(*) AS BIGINT) AS n, CAST(count(return_bp) AS BIGINT) AS measured,
   CAST(count(stress_bp) AS BIGINT) AS stressed FROM samples GROUP BY version, status""")
def status_counts(t):
    return t.samples.groupBy("version", "status").agg(
        F.count("*").alias("n"), F.count("return_bp").alias("measured"), F.count("stress_bp").alias("stressed"))


@query("agg_02_conditional", """
 SELECT token, CAST(count(*) AS BIGINT) AS swaps, CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buys,
   CAST(sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS BIGINT) AS sells,
   CAST(sum(CASE WHEN side = 'buy' THEN quote_amount ELSE 0 END) AS BIGINT) AS buy_quote,
   CAST(sum(CASE WHEN side = 'sell' THEN quote_amount ELSE 0 END) AS BIGINT) AS sell_quote,
   CAST(count(CASE WHEN gas > 0 THEN gas END) AS BIGINT) AS paid_gas FROM swaps GROUP BY token""")
def conditional(t):
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    return t.swaps.groupBy("token").agg(
        F.count("*").alias("swaps"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"),
        F.sum(F.when(buy, F.col("quote_amount")).otherwise(0)).alias("buy_quote"),
        F.sum(F.when(sell, F.col("quote_amount")).otherwise(0)).alias("sell_quote"),
        F.count(F.when(F.col("gas") > 0, F.col("gas"))).alias("paid_gas"))


@query("agg_03_distinct", """
 SELECT token, CAST(count(DISTINCT tx) AS BIGINT) AS txs, CAST(count(DISTINCT wallet) AS BIGINT) AS wallets,
   CAST(count(DISTINCT CASE WHEN side = 'buy' THEN origin END) AS BIGINT) AS buyers FROM swaps GROUP BY token""")
def distinct(t):
    # One distinct stage per column: several distinct counts in one aggregate would copy every row once for each of them.
    buyer = F.when(F.col("side") == "buy", F.col("origin"))
    out = t.swaps.select("token").distinct()
    for name, column in (("txs", F.col("tx")), ("wallets", F.col("wallet")), ("buyers", buyer)):
        counted = t.swaps.select("token", column.alias("_v")).distinct().groupBy("token").agg(F.count("_v").alias(name))
        out = same_keys(out, counted, ["token"])
    return out


@query("agg_04_having", """
 SELECT wallet, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT token) AS BIGINT) AS tokens FROM samples
 WHERE status = 'complete' GROUP BY wallet HAVING count(*) >= 5 AND count(DISTINCT token) >= 4""")
def having(t):
    return (t.samples.filter("status = 'complete'").groupBy("wallet")
            .agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens")).filter("n >= 5 AND tokens >= 4"))


@query("agg_05_first_last_seen", """
 WITH u AS (SELECT token, block, 'swap' AS kind FROM swaps
   UNION ALL SELECT token, IDIV(ts - 788918400, 86400), 'transfer' FROM transfers WHERE sender = '0x0')
 SELECT token, min(block) AS first_block, max(block) AS last_block,
   CASE WHEN min(CASE WHEN kind = 'transfer' THEN block END) <= min(CASE WHEN kind = 'swap' THEN block END)
     THEN 'transfer' ELSE 'swap' END AS first_kind FROM u GROUP BY token""")
def first_last_seen(t):
    seen = t.swaps.select("token", "block", F.lit("swap").alias("kind")).unionByName(
        t.sql("SELECT token, IDIV(ts - 788918400, 86400) AS block, 'transfer' AS kind FROM transfers WHERE sender = '0x0'"))
    rank = F.struct("block", (F.col("kind") != "transfer").alias("later"))
    return seen.groupBy("token").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"),
                                     F.min_by("kind", rank).alias("first_kind"))


@query("agg_06_mean_median_wins", """
 SELECT wallet, CAST(count(*) AS BIGINT) AS n, CAST(sum(return_bp) AS BIGINT) AS total_bp,
   CAST(sum(return_bp) AS DOUBLE) / count(*) AS mean_bp, median(return_bp) AS median_bp,
   CAST(sum(CASE WHEN return_bp > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins
 FROM samples WHERE return_bp IS NOT NULL GROUP BY wallet""")
def mean_median_wins(t):
    rows = t.samples.filter("return_bp IS NOT NULL")
    base = rows.groupBy("wallet").agg(F.count("*").alias("n"), F.sum("return_bp").alias("total_bp"),
                                      F.count_if(F.col("return_bp") > 0).alias("wins"))
    med = agg.exact_median(rows, ["wallet"], "return_bp", "median_bp")
    return base.join(med, "wallet").withColumn("mean_bp", F.col("total_bp") / F.col("n"))


SHIFT = 79228162514264337593543950336  # 2**96


@query("agg_07_exact_256_bit_sum", f"""
 WITH d AS (SELECT token, recipient AS holder, amount FROM transfers
   UNION ALL SELECT token, sender, -amount FROM transfers WHERE sender <> '0x0')
 SELECT token, holder, CAST(CAST(sum(amount) AS HUGEINT) * {SHIFT}::HUGEINT AS VARCHAR) AS balance
 FROM d GROUP BY token, holder""")
def exact_sum(t):
    """Amounts shifted left by 96 bits and rendered as 32-byte words, then summed with sign."""
    word = F.concat(F.lpad(F.hex("amount"), 40, "0"), F.repeat(F.lit("0"), F.lit(24)))
    moves = t.transfers.select("token", "sender", "recipient", word.alias("word"))
    return signals.signed_word_balances(moves).select(
        "token", "holder", bigint.to_decimal(F.col("total")).cast("string").alias("balance"))


@query("agg_08_top_ten_share", """
 WITH b AS (SELECT token, recipient AS holder, sum(amount) AS amount FROM transfers GROUP BY token, recipient),
  r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY amount DESC, holder) AS rn FROM b)
 SELECT token, CAST(count(*) AS BIGINT) AS holders,
   CAST(sum(CASE WHEN rn <= 10 THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS top10_share
 FROM r GROUP BY token""")
def top_ten_share(t):
    balances = t.transfers.groupBy("token", F.col("recipient").alias("holder")).agg(F.sum("amount").alias("amount"))
    return agg.top_share(balances, ["token"], "amount", "holder", 10, "top10_share").select(
        "token", "holders", "top10_share")


@query("agg_09_minute_activity", """
 SELECT pool, token, IDIV(ts, 60) * 60 AS bucket_start, CAST(count(*) AS BIGINT) AS swaps,
   CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buys,
   CAST(sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS BIGINT) AS sells,
   CAST(sum(CASE WHEN side = 'buy' THEN quote_amount ELSE 0 END) AS BIGINT) AS buy_quote,
   CAST(sum(CASE WHEN side = 'sell' THEN quote_amount ELSE 0 END) AS BIGINT) AS sell_quote,
   min(ts) AS first_ts, max(ts) AS last_ts FROM swaps GROUP BY pool, token, IDIV(ts, 60) * 60""")
def minute_activity(t):
    return signals.activity(t.swaps, 60)


@query("agg_10_dense_histogram", """
 WITH c AS (SELECT max(block) AS finish, greatest(0, max(block) - 1199) AS begin FROM txs),
  bins AS (SELECT unnest(generate_series(0, CAST((finish - begin) // 50 AS BIGINT))) AS i, begin, finish FROM c),
  counts AS (SELECT (block - begin) // 50 AS i, count(*) AS n FROM txs, c WHERE block BETWEEN begin AND finish GROUP BY 1)
 SELECT begin + i * 50 AS block_from, least(finish, begin + (i + 1) * 50 - 1) AS block_to,
   CAST(coalesce(n, 0) AS BIGINT) AS n FROM bins LEFT JOIN counts USING (i)""")
def dense_histogram(t):
    return quality.block_histogram(t.txs, width=50, span=1200)


@query("agg_11_null_rates", """
 WITH s AS (SELECT * FROM samples), a AS (SELECT * FROM assessments)
 SELECT 'samples' AS table_name, 'return_bp' AS column_name, CAST(count(*) AS BIGINT) AS denominator,
   CAST(count(*) - count(return_bp) AS BIGINT) AS nulls FROM s
 UNION ALL SELECT 'samples', 'stress_bp', count(*), count(*) - count(stress_bp) FROM s
 UNION ALL SELECT 'samples', 'completed_at', count(*), count(*) - count(completed_at) FROM s
 UNION ALL SELECT 'assessments', 'liquidity', count(*), count(*) - count(liquidity) FROM a
 UNION ALL SELECT 'assessments', 'price', count(*), count(*) - count(price) FROM a
 UNION ALL SELECT 'assessments', 'top10_share', count(*), count(*) - count(top10_share) FROM a""")
def null_rates(t):
    return agg.null_profile(t.samples, "samples", ["return_bp", "stress_bp", "completed_at"]).unionByName(
        agg.null_profile(t.assessments, "assessments", ["liquidity", "price", "top10_share"]))


@query("agg_12_time_ranges", """
 SELECT 'swaps' AS table_name, min(ts) AS min_ts, max(ts) AS max_ts,
   strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%dT%H:%M:%S') AS min_utc,
   strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%S') AS max_utc FROM swap_keys
 UNION ALL SELECT 'quotes', min(ts), max(ts), strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%dT%H:%M:%S'),
   strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%S') FROM quotes
 UNION ALL SELECT 'samples', min(leader_ts), max(leader_ts),
   strftime(make_timestamp(min(leader_ts) * 1000000), '%Y-%m-%dT%H:%M:%S'),
   strftime(make_timestamp(max(leader_ts) * 1000000), '%Y-%m-%dT%H:%M:%S') FROM samples""")
def time_ranges(t):
    return quality.time_ranges([("swaps", t.swap_keys, "ts"), ("quotes", t.quotes, "ts"),
                                ("samples", t.samples, "leader_ts")])


# --- fixed value: pieces of moves per input split, which Spark bounds in bytes -----------------------------------------------
PIECES_PER_SPLIT = 16


@query("agg_13_net_deltas", """
 WITH d AS (SELECT tx, token, recipient AS wallet, amount FROM transfers
   UNION ALL SELECT tx, token, sender, -amount FROM transfers)
 SELECT tx, token, wallet, CAST(sum(amount) AS BIGINT) AS delta FROM d WHERE wallet <> '0x0' GROUP BY tx, token, wallet""")
def net_deltas(t):
    return signals.net_deltas(t.transfers, ["tx", "token"], PIECES_PER_SPLIT * t.lineitem.rdd.getNumPartitions())


COVERAGE = """ w AS (SELECT tx, CASE WHEN status_code = 'F' THEN 'complete' WHEN status_code = 'P' THEN 'ambiguous' END
   AS review FROM txs)"""


@query("agg_14_coverage", "WITH" + COVERAGE + """
 SELECT s.token, CAST(count(DISTINCT s.tx) AS BIGINT) AS observed,
   CAST(count(DISTINCT CASE WHEN w.review IS NOT NULL THEN s.tx END) AS BIGINT) AS reviewed,
   CAST(count(DISTINCT s.tx) - count(DISTINCT CASE WHEN w.review IS NOT NULL THEN s.tx END) AS BIGINT) AS pending,
   CAST(count(DISTINCT CASE WHEN w.review = 'ambiguous' THEN s.tx END) AS BIGINT) AS ambiguous,
   CAST(count(DISTINCT CASE WHEN w.review IS NOT NULL AND s.side = 'sell' THEN s.tx END) AS DOUBLE)
     / nullif(count(DISTINCT CASE WHEN s.side = 'sell' THEN s.tx END), 0) AS sell_coverage
 FROM swaps s LEFT JOIN w USING (tx) GROUP BY s.token""")
def coverage(t):
    reviews = t.sql("WITH" + COVERAGE + " SELECT * FROM w")
    return signals.coverage(t.swaps.join(reviews, "tx", "left"))


REASONS = """ a AS (SELECT id, token, ts, list_filter([
    CASE WHEN liquidity IS NULL THEN 'liquidity_unknown' WHEN liquidity < 25000 THEN 'liquidity_low' END,
    CASE WHEN top10_share IS NULL THEN 'holders_unknown' WHEN top10_share > 0.5 THEN 'holders_concentrated' END,
    CASE WHEN NOT deployment_confirmed THEN 'deployment_unconfirmed' END,
    CASE WHEN observed_at IS NULL OR ts - observed_at > 120 THEN 'quote_stale' END], lambda x: x IS NOT NULL) AS reasons
  FROM assessments)"""


def reasons(t):
    return signals.basic_reasons(t.assessments).select("id", "token", "ts", "reasons")


@query("agg_15_reason_frequency", "WITH" + REASONS + """
 SELECT reason, CAST(count(*) AS BIGINT) AS assessments, CAST(count(DISTINCT token) AS BIGINT) AS tokens
 FROM (SELECT token, unnest(reasons) AS reason FROM a) GROUP BY reason ORDER BY assessments DESC, reason LIMIT 4""")
def reason_frequency(t):
    return signals.reason_frequency(reasons(t), top=4)


@query("agg_16_spend_by_day", """
 SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month,
   CAST(count(*) AS BIGINT) AS calls, CAST(sum(cents) AS BIGINT) AS reserved_cents,
   CAST(coalesce(sum(CASE WHEN token <> 'error' THEN cents END), 0) AS BIGINT) AS actual_cents,
   CAST(sum(CASE WHEN token = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS unknown_cost_calls
 FROM quotes GROUP BY 1, 2""")
def spend_by_day(t):
    calls = t.quotes.withColumn("cost", F.when(F.col("token") != "error", F.col("cents")))
    return signals.spend(calls, "ts", "cents", "cost")


@query("agg_17_latest_quality", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY id DESC) AS rn FROM assessments)
 SELECT CASE priority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'unverified' ELSE 'unavailable' END AS source_status,
   CAST(count(*) AS BIGINT) AS tokens, CAST(sum(CASE WHEN top10_share IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS holders_known,
   CAST(sum(CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS quoted, max(ts) AS latest_at
 FROM l WHERE rn = 1 GROUP BY 1""")
def latest_quality(t):
    status = (F.when(F.col("priority") == "1-URGENT", "verified").when(F.col("priority") == "2-HIGH", "unverified")
              .otherwise("unavailable"))
    newest = agg.latest(t.assessments, ["token"], ["id"])
    return newest.groupBy(status.alias("source_status")).agg(
        F.count("*").alias("tokens"), F.count("top10_share").alias("holders_known"), F.count("price").alias("quoted"),
        F.max("ts").alias("latest_at"))


@query("agg_18_entity_counters", """
 SELECT 'swaps' AS entity, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN block > 1800 THEN 1 END) AS BIGINT) AS pending
   FROM swap_keys
 UNION ALL SELECT 'wallets', count(DISTINCT wallet), count(DISTINCT CASE WHEN block > 1800 THEN wallet END) FROM swap_keys
 UNION ALL SELECT 'pools', count(DISTINCT pool), count(DISTINCT CASE WHEN block > 1800 THEN pool END) FROM swap_keys
 UNION ALL SELECT 'transactions', count(*), count(CASE WHEN block > 1800 THEN 1 END) FROM txs""")
def entity_counters(t):
    return quality.entity_counters(t.swap_keys, t.txs, cursor=1800)


@query("agg_19_members_per_case", "WITH" + CASES + """
 , keys AS (SELECT DISTINCT case_key FROM members)
 SELECT k.case_key, CAST(count(m.tx) AS BIGINT) AS members FROM keys k
 LEFT JOIN (SELECT * FROM members WHERE status = 'complete') m USING (case_key) GROUP BY k.case_key""")
def members_per_case(t):
    rows = t.samples.withColumn("case_key", F.col("token") * 1000000000000 + F.col("leader_ts"))
    members = rows.filter("status = 'complete'").groupBy("case_key").agg(F.count("*").alias("members"))
    return rows.select("case_key").distinct().join(members, "case_key", "left").fillna(0, ["members"])


@query("agg_20_leaderboard", """
 SELECT origin AS wallet, CAST(count(*) AS BIGINT) AS n FROM swaps GROUP BY origin ORDER BY n DESC, wallet LIMIT 50""")
def leaderboard(t):
    return (t.swaps.groupBy(F.col("origin").alias("wallet")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "wallet").limit(50))
