import re

from conftest import rows_of
from pyspark.sql import functions as F

from onledger.operators import scan




def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=4000):
    return spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias("ts"), F.lit(1).cast("bigint").alias("v"))


def test_hot_keys_are_shuffled_by_bucket_and_once(spark):
    out = scan.running(hot(spark), ["k"], ["ts"], scan.width_bucket("ts", 100), max_rows=1000,
                       sums={"s": (F.col("v"), True)}, nexts={"n": (F.col("ts"), False)})
    text = plan(out)
    assert "SortMergeJoin" not in text and len(re.findall(r"Exchange hashpartitioning\(k#\d+L, _bucket#\d+L", text)) == 1
    assert text.count("Exchange hashpartitioning") == 1
    got = {r.ts: (r.s, r.n) for r in out.collect()}
    assert got == {i: (i // 3 + 1, i + 3 if i + 3 < 4000 else None) for i in range(4000)}


def test_hot_inventories_too(spark):
    out = scan.inventory(hot(spark), ["k"], ["ts"], scan.width_bucket("ts", 100), F.col("v"), F.col("ts") % 2 == 0, max_rows=1000)
    text = plan(out)
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
    plain = scan.inventory(hot(spark), ["k"], ["ts"], scan.width_bucket("ts", 100), F.col("v"), F.col("ts") % 2 == 0)
    assert rows_of(out, *out.columns) == rows_of(plain, *out.columns)


def test_sums_since_marks_in_one_scan(spark):
    rows = spark.range(900).select((F.col("id") % 2).alias("k"), F.col("id").alias("ts"), F.col("id").alias("v"))
    mark, want, run = F.col("ts") % 7 == 3, {}, {0: 0, 1: 0}
    for i in range(900):
        run[i % 2] += i
        want[i] = run[i % 2]
        run[i % 2] = 0 if i % 7 == 3 else run[i % 2]
    for most in (100, 10_000):
        out = scan.since_marks(rows, ["k"], ["ts"], scan.width_bucket("ts", 5), F.col("v"), mark, "s", most)
        assert plan(out).count("Exchange hashpartitioning") == 1
        assert {r.ts: r.s for r in out.collect()} == want


def test_ledger_and_report_join_the_swaps_once(spark, monkeypatch):
    from onledger import catalog
    from onledger.bindings import Tables
    from onledger.catalog import portfolio

    items = catalog.load()
    for name in ("pip_39_trade_ledger", "pip_38_portfolio_report"):
        made = []
        monkeypatch.setattr(portfolio, "materialize", lambda rows, label: made.append(label) or rows.limit(0))
        out = items[name].job(Tables(spark, "/root/testdata/sf0.001"))
        assert made == ["swaps"] and "orders.parquet" not in plan(out)


def test_entry_ranks_join_the_flows_once(spark):
    from onledger import catalog
    from onledger.bindings import Tables

    out = catalog.load()["win_03_entry_rank"].job(Tables(spark, "/root/testdata/sf0.001"))
    assert "orders.parquet" not in plan(out) and "/flows-" in plan(out) and "/first-buys-" in plan(out)


def test_audit_joins_the_flows_once(spark, monkeypatch):
    from onledger.bindings import Tables
    from onledger.catalog import portfolio

    monkeypatch.setattr(portfolio.pf, "place_audit_events", lambda *tables: tables)
    t = Tables(spark, "/root/testdata/sf0.001")
    for rows in portfolio.placed(t, portfolio.stored_flows(t)):
        assert "orders.parquet" not in plan(rows) and "/flows-" in plan(rows)
