"""Sorting, top-k and set operators."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.catalog.aggregates import REASONS, reasons
from onledger.operators import rules, scan



@query("srt_01_priority_top", """
 SELECT id, token, ts, launch_age FROM assessments
 ORDER BY deployment_confirmed DESC, CASE status_code WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END,
   coalesce(qualified_buys, 0) DESC, coalesce(distinct_buyers, 0) DESC, ts DESC, id LIMIT 40""")
def priority_top(t):
    return t.assessments.orderBy(
        F.desc("deployment_confirmed"),
        F.when(F.col("status_code") == "F", 0).when(F.col("status_code") == "P", 1).otherwise(2),
        F.coalesce("qualified_buys", F.lit(0)).desc(), F.coalesce("distinct_buyers", F.lit(0)).desc(),
        F.desc("ts"), "id").limit(40).select("id", "token", "ts", "launch_age")


@query("srt_02_chain_order", """
 SELECT row_number() OVER (ORDER BY block, tx, log_index, pool, wallet, token_amount, quote_amount, side, line_status)
   AS position, block, tx, log_index, pool FROM swap_keys""")
def chain_order(t):
    """Position of every log in chain order, numbered without a one-task sort."""
    order = ["block", "tx", "log_index", "pool", "wallet", "token_amount", "quote_amount", "side", "line_status"]
    numbered = scan.row_numbers(t.swap_keys, [], order, scan.width_bucket("block", 30), "position")
    return numbered.select("position", "block", "tx", "log_index", "pool")


@query("srt_03_ranking_with_sentinel", """
 WITH w AS (SELECT wallet, count(return_bp) >= 4 AS qualified, CAST(count(*) AS BIGINT) AS samples,
   CAST(sum(return_bp) AS DOUBLE) / nullif(count(return_bp), 0) AS mean_bp FROM samples GROUP BY wallet)
 SELECT wallet, qualified, samples, mean_bp FROM w
 ORDER BY qualified DESC, samples DESC, coalesce(mean_bp, -100000) DESC, wallet LIMIT 25""")
def ranking(t):
    w = t.samples.groupBy("wallet").agg(
        (F.count("return_bp") >= 4).alias("qualified"), F.count("*").alias("samples"),
        F.try_divide(F.sum("return_bp"), F.count("return_bp")).alias("mean_bp"))
    return w.orderBy(F.desc("qualified"), F.desc("samples"), F.coalesce("mean_bp", F.lit(-100000.0)).desc(),
                     "wallet").limit(25)


@query("srt_04_recent_rows", """
 SELECT * FROM (SELECT 'samples' AS source, tx AS id, completed_at AS at FROM samples WHERE completed_at IS NOT NULL
   ORDER BY completed_at DESC, tx LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 'assessments' AS source, id, ts AS at FROM assessments ORDER BY ts DESC, id LIMIT 100)
 UNION ALL SELECT * FROM (SELECT 'quotes' AS source, quote_id AS id, ts AS at FROM quotes ORDER BY ts DESC, quote_id LIMIT 30)""")
def recent_rows(t):
    parts = [("samples", t.samples.filter("completed_at IS NOT NULL"), "tx", "completed_at", 20),
             ("assessments", t.assessments, "id", "ts", 100), ("quotes", t.quotes, "quote_id", "ts", 30)]
    tops = [rows.select(F.lit(name).alias("source"), F.col(i).alias("id"), F.col(at).alias("at"))
            .orderBy(F.desc("at"), "id").limit(n) for name, rows, i, at, n in parts]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


@query("set_01_union_distinct", """
 SELECT tx, wallet, token, ts FROM flows WHERE side = 'buy'
 UNION SELECT tx, wallet, token, ts FROM flows WHERE quantity > 25 AND side = 'buy'""")
def union_distinct(t):
    cols = ["tx", "wallet", "token", "ts"]
    buys = t.flows.filter("side = 'buy'")
    return buys.select(cols).union(buys.filter("quantity > 25").select(cols)).distinct()


@query("set_02_difference_intersection", """
 SELECT 'difference' AS part, origin AS wallet FROM (SELECT origin FROM txs WHERE status_code = 'F'
   EXCEPT SELECT origin FROM txs WHERE status_code = 'P' AND priority = '1-URGENT')
 UNION ALL SELECT 'intersection', origin FROM (SELECT origin FROM txs WHERE status_code = 'F'
   INTERSECT SELECT origin FROM txs WHERE status_code = 'P' AND priority = '1-URGENT')""")
def difference_intersection(t):
    a = t.txs.filter("status_code = 'F'").select(F.col("origin").alias("wallet"))
    b = t.txs.filter("status_code = 'P' AND priority = '1-URGENT'").select(F.col("origin").alias("wallet"))
    return a.subtract(b).select(F.lit("difference").alias("part"), "wallet").unionByName(
        a.intersect(b).select(F.lit("intersection").alias("part"), "wallet"))


@query("set_03_evidence_union", """
 SELECT DISTINCT token, buyer FROM (
   SELECT token, wallet AS buyer FROM swaps WHERE side = 'buy' AND pool % 3 = 0
   UNION ALL SELECT token, CASE WHEN origin % 5 <> 0 THEN origin END FROM swaps WHERE side = 'buy')
 WHERE buyer IS NOT NULL""")
def evidence_union(t):
    buys = t.swaps.filter("side = 'buy'")
    a = buys.filter("pool % 3 = 0").select("token", F.col("wallet").alias("buyer"))
    b = buys.select("token", F.when(F.col("origin") % 5 != 0, F.col("origin")).alias("buyer"))
    return a.unionByName(b).filter("buyer IS NOT NULL").distinct()


@query("set_04_reason_union", "WITH" + REASONS + """
 SELECT id, array_to_string(list_sort(list_distinct(list_concat(reasons,
   CASE WHEN id % 3 = 0 THEN ['quote_stale', 'cooldown'] ELSE ['position_limit'] END))), ',') AS reasons FROM a""")
def reason_union(t):
    extra = F.when(F.col("id") % 3 == 0, F.array(F.lit("quote_stale"), F.lit("cooldown"))).otherwise(
        F.array(F.lit("position_limit")))
    return reasons(t).select("id", F.array_join(rules.merged(F.col("reasons"), extra), ",").alias("reasons"))
