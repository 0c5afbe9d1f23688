"""Streaming operators over the supplied tables, each run to the end of the available input."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from onledger.bindings import VIEWS, _expand
from onledger.catalog import query
from onledger.catalog.wallets import FIFO_CTES
from onledger.session import work_dir
from onledger.streaming import jobs, stateful

C = F.col
DELAY = 3600


def source(t, name):
    return jobs.read_stream(t.spark, t.dir, getattr(t, name).schema, f"{name}.parquet")


def quotes(t):
    """The quotes view as a stream, with its event time."""
    rows = source(t, "events")
    return rows.select(C("event_id").alias("quote_id"), C("event_type").alias("token"), C("ts").cast("timestamp").alias("at"),
                       F.unix_seconds(C("ts").cast("timestamp")).alias("ts"),
                       F.round(C("value") * 100).cast("bigint").alias("cents"), "user_id")


def swap_keys(t):
    return t.spark.sql(_expand(VIEWS["swap_keys"], True).replace("FROM lineitem", "FROM {lineitem}"), lineitem=source(t, "lineitem"))


def txs(t):
    return t.spark.sql(_expand(VIEWS["txs"], True).replace("FROM orders", "FROM {orders}"), orders=source(t, "orders"))


def finished(t, rows, label):
    root = work_dir(t.spark, label)
    jobs.run_to_files(rows, root)
    return jobs.output(t.spark, root, rows.schema)


@contextmanager
def state_store(spark):
    """Keyed state needs the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(stateful.STORE_CONF)
    spark.conf.set(stateful.STORE_CONF, stateful.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(stateful.STORE_CONF, before)


CLOSED = f"(SELECT CAST(floor(epoch(max(ts)) - {DELAY}) AS BIGINT) FROM events)"


@query("src_07_incremental_source", "SELECT quote_id, user_id, ts, cents FROM quotes")
def incremental_source(t):
    folder = work_dir(t.spark, "pieces")
    t.quotes.repartitionByRange(6, "ts").write.parquet(folder)
    rows = jobs.read_stream(t.spark, folder, t.quotes.schema, files_per_trigger=2)
    return finished(t, rows.select("quote_id", "user_id", "ts", "cents"), "incremental")


@query("str_01_confirmed_ingestion", """
 SELECT tx, log_index, pool, wallet, block FROM swap_keys WHERE block <= (SELECT max(block) FROM swap_keys) - 12""")
def confirmed_ingestion(t):
    root = work_dir(t.spark, "confirmed")
    rows = swap_keys(t).select("tx", "log_index", "pool", "wallet", "block")
    jobs.confirmed_ingestion(rows, root, "block", 12)
    return t.spark.read.parquet(f"{root}/out").drop("batch")


@query("str_02_dedupe", "SELECT DISTINCT tx, log_index FROM swap_keys")
def dedupe(t):
    rows = swap_keys(t).select("tx", "log_index", F.timestamp_seconds("ts").alias("at"))
    return finished(t, jobs.dedupe_keys(rows, "at", ["tx", "log_index"], "4000 days").select("tx", "log_index"), "dedupe")


@query("str_03_reorganisation", """
 SELECT number, CAST(count(DISTINCT hash) AS BIGINT) AS hashes FROM (SELECT block AS number, block * 31 + CASE WHEN tx % 53 = 0 THEN 1 ELSE 0 END
   AS hash FROM txs) x GROUP BY number HAVING count(DISTINCT hash) > 1""")
def reorganisation(t):
    root = work_dir(t.spark, "headers")
    headers = txs(t).select(C("block").alias("number"), (C("block") * 31 + F.when(C("tx") % 53 == 0, 1).otherwise(0)).alias("hash"))
    jobs.watch_headers(headers, root, stop=False)
    return t.spark.read.parquet(f"{root}/conflicts").drop("batch")


@query("str_04_sliding_flow", f"""
 WITH w AS (SELECT token, cents, user_id, unnest(generate_series(IDIV(ts, 7200) * 7200 - 36000, IDIV(ts, 7200) * 7200, 7200)) AS window_start FROM quotes)
 SELECT window_start, token, CAST(sum(CASE WHEN user_id % 2 = 0 THEN cents ELSE -cents END) AS BIGINT) AS net, CAST(count(*) AS BIGINT) AS n FROM w
 WHERE window_start + 43200 <= {CLOSED} GROUP BY window_start, token""")
def sliding_flow(t):
    amount = F.when(C("user_id") % 2 == 0, C("cents")).otherwise(-C("cents"))
    return finished(t, jobs.sliding_flow(quotes(t), "at", ["token"], amount, "12 hours", "2 hours", f"{DELAY} seconds"), "sliding")


@query("str_04_sliding_members", f"""
 WITH w AS (SELECT token, user_id, unnest(generate_series(IDIV(ts, 7200) * 7200 - 36000, IDIV(ts, 7200) * 7200, 7200)) AS window_start FROM quotes)
 SELECT window_start, token, CAST(count(DISTINCT user_id) AS BIGINT) AS members FROM w
 WHERE window_start + 43200 <= {CLOSED} GROUP BY window_start, token""")
def sliding_members(t):
    return finished(t, jobs.sliding_members(quotes(t), "at", ["token"], "user_id", "12 hours", "2 hours", f"{DELAY} seconds"), "members")


@query("str_05_tumbling_activity", f"""
 SELECT IDIV(ts, 3600) * 3600 AS bucket_start, token, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS buys,
   CAST(sum(CASE WHEN user_id % 2 = 0 THEN cents ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE cents END) AS BIGINT) AS sold
 FROM quotes WHERE IDIV(ts, 3600) * 3600 + 3600 <= {CLOSED} GROUP BY 1, 2""")
def tumbling_activity(t):
    return finished(t, jobs.activity(quotes(t), "at", ["token"], C("user_id") % 2 == 0, C("cents"), "1 hour", f"{DELAY} seconds"), "tumbling")


@query("str_06_stream_match", """
 WITH l AS (SELECT * FROM quotes WHERE token = 'view'), r AS (SELECT * FROM quotes WHERE token = 'purchase'),
  m AS (SELECT max(ts) - 259200 AS settled FROM quotes)
 SELECT l.quote_id, l.user_id, l.ts, r.quote_id AS match_id FROM l LEFT JOIN (SELECT e.*, q.quote_id FROM events e JOIN r q ON q.quote_id = e.event_id) r
   ON r.user_id = l.user_id AND r.ts >= (SELECT e.ts FROM events e WHERE e.event_id = l.quote_id)
   AND r.ts <= (SELECT e.ts FROM events e WHERE e.event_id = l.quote_id) + INTERVAL 6 HOUR, m WHERE l.ts <= settled""".replace(", m WHERE", " CROSS JOIN m WHERE"))
def stream_match(t):
    left = quotes(t).filter("token = 'view'").select("quote_id", "user_id", "ts", C("at").alias("left_at"))
    right = quotes(t).filter("token = 'purchase'").select(C("quote_id").alias("match_id"), "user_id", C("at").alias("right_at"))
    rows = jobs.match_within(left, right, "user_id", "left_at", "right_at", "6 HOURS", f"{DELAY} seconds")
    out = finished(t, rows.select("quote_id", "user_id", "ts", "match_id"), "match")
    settled = t.quotes.select(F.max("ts") - 259200).scalar()
    return out.filter(C("ts") <= settled)


@query("str_07_refresh_requests", """
 WITH RECURSIVE f AS (SELECT user_id AS token, token AS action, ts FROM quotes),
  r AS (SELECT token, action, min(ts) AS requested_at, CAST(1 AS BIGINT) AS attempt FROM f GROUP BY token, action
   UNION ALL SELECT r.token, r.action, (SELECT min(f.ts) FROM f WHERE f.token = r.token AND f.action = r.action AND f.ts >= r.requested_at + 300), attempt + 1
   FROM r WHERE attempt < 3 AND requested_at IS NOT NULL)
 SELECT token, action, requested_at, attempt FROM r WHERE requested_at IS NOT NULL""")
def refresh_requests(t):
    findings = quotes(t).select(C("user_id").alias("token"), C("token").alias("action"), "ts")
    with state_store(t.spark):
        return finished(t, stateful.stream_requests(findings), "requests")


@query("str_08_fifo_state", "WITH" + FIFO_CTES + """
 SELECT wallet, token, opened_at, closed_at, CAST(quantity // 1000000000000000000 AS BIGINT) AS quantity, round(pnl, 6) AS pnl, 'closed' AS kind
 FROM outcomes WHERE closed_at < (SELECT max(ts) - 8640000 FROM swap_keys)
 UNION ALL SELECT wallet, token, ts, ts, CAST(quantity // 1000000000000000000 AS BIGINT), NULL, 'unknown_basis'
 FROM p WHERE unknown AND ts < (SELECT max(ts) - 8640000 FROM swap_keys)""")
def fifo_state(t):
    part = t.part.select(C("p_partkey").alias("pool"), C("p_brand").alias("token"))
    orders = t.orders.select(C("o_orderkey").alias("tx"), C("o_custkey").alias("origin"))
    gas = F.round(C("l_extendedprice") * C("l_tax")).cast("bigint")
    base = source(t, "lineitem").select(
        C("l_orderkey").alias("tx"), C("l_linenumber").cast("bigint").alias("log_index"), C("l_partkey").alias("pool"),
        C("l_suppkey").alias("wallet"), F.when(C("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.round("l_quantity").cast("bigint").alias("quantity"),
        F.round(C("l_extendedprice") * (1 - C("l_discount")) * 100).cast("bigint").alias("quote"), gas.alias("gas"),
        C("l_shipdate").cast("timestamp").alias("at"), F.unix_seconds(C("l_shipdate").cast("timestamp")).alias("ts"))
    flows = base.join(part, "pool").join(orders, "tx")
    limit = t.flows.select(F.max("ts") - 8640000).scalar()
    with state_store(t.spark):
        out = finished(t, stateful.stream_fifo(flows, "at", "100 days"), "fifo")
    return out.filter(C("closed_at") < limit).withColumn("pnl", F.round("pnl", 6))


@query("str_09_late_data", """
 SELECT quote_id, CASE WHEN ts - 1706600000 > 15 THEN 'invalid_future_time' WHEN user_id > 120 THEN 'observed_after_entry_deadline'
   ELSE 'accepted' END AS label FROM quotes""")
def late_data(t):
    root = work_dir(t.spark, "late")
    rows = jobs.label_lateness(quotes(t), C("ts"), C("ts") + C("user_id"), F.lit(1706600000), 120)
    jobs.split_labels(rows.select("quote_id", "label"), root)
    return t.spark.read.parquet(f"{root}/out").unionByName(t.spark.read.parquet(f"{root}/rejected")).select("quote_id", "label")


@query("str_10_feed_gauge", """
 SELECT max(ts) AS indexed_through, max(quote_id) AS head, CAST(count(*) AS BIGINT) AS rows,
   CASE WHEN max(quote_id) % 7 = 3 THEN 'error' WHEN 1706659200 - max(ts) < 45 AND max(quote_id) - max(CASE WHEN quote_id % 50 <> 0 THEN quote_id END) <= 22
     THEN 'live' ELSE 'catching_up' END AS state FROM quotes""")
def feed_gauge(t):
    from onledger.plans.scoring import feed_status

    root = work_dir(t.spark, "gauge")
    jobs.freshness_gauge(quotes(t), root, "ts", "quote_id")
    # The cursor is what a second job has taken over so far, which leaves some rows out.
    behind = work_dir(t.spark, "cursor")
    jobs.freshness_gauge(quotes(t).filter("quote_id % 50 <> 0"), behind, "ts", "quote_id")
    cursor = jobs.newest_gauge(t.spark, behind).select(F.col("head").alias("cursor"))
    both = jobs.newest_gauge(t.spark, root).unionByName(cursor, allowMissingColumns=True)
    both = both.agg(*[F.max(n).alias(n) for n in ("indexed_through", "head", "rows", "cursor")])
    error = F.when(C("head") % 7 == 3, "source failed")
    state = feed_status(C("head"), C("cursor"), C("indexed_through"), F.lit(1706659200), error)
    return both.withColumn("state", state).drop("cursor")


@query("str_11_incremental_normalisation", "SELECT tx, block, origin, CASE WHEN tx % 3 <> 0 THEN total_cents END AS total_cents FROM txs")
def incremental_normalisation(t):
    root = work_dir(t.spark, "normalised")
    rows = txs(t).select("tx", "block", "origin", F.when(C("tx") % 3 != 0, C("total_cents")).alias("total_cents"), C("ts").alias("seq"))
    jobs.normalise_incrementally(rows, root, ["tx"], ["block"], ["origin", "total_cents"], "seq")
    return jobs.known_values(t.spark, root, ["tx"], ["block", "origin", "total_cents"], "seq")
