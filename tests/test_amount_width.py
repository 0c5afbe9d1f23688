from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from onledger.functions import amounts, wide
from onledger.params import ScanRules
from onledger.plans import portfolio, wallets

FLOW = "wallet long, token string, ts long, tx long, log_index long, pool long, origin long, quantity decimal(38,0), quote long, gas long, side string"
TINY = ScanRules(max_rows=3, bucket_seconds=2, bucket_units=1)
HUGE = 9 * 10 ** 37


def flow(token, ts, side, quantity, quote):
    return (1, token, ts, ts, 0, 0, 0, Decimal(quantity), quote, 0, side)


def flows(size):
    return [flow("t", 1, "buy", 2 * size, 10), flow("t", 2, "buy", 2 * size, 30), flow("t", 3, "sell", 3 * size, 60), flow("t", 4, "sell", size, 5)]


@pytest.mark.parametrize("scan", [TINY, ScanRules()])
def test_ordinary_tokens_run_on_decimals(table, scan):
    lots, unknown = wallets.fifo(table(FLOW, flows(10 ** 18)), scan, narrow=True)
    assert lots.schema["quantity"].dataType == amounts.NARROW == unknown.schema["short"].dataType
    assert rows_of(wallets.fifo_outcomes(lots), "opened_at", "closed_at", "pnl") == [(1, 3, 30.0), (2, 4, -5.0)]
    for rows in wallets.fifo(table(FLOW, flows(10 ** 18)), scan):
        assert all(amounts.is_wide_column(rows, name) for name in amounts.QUANTITIES if name in rows.columns)


@pytest.mark.parametrize("scan", [TINY, ScanRules()])
def test_tokens_beyond_38_digits_stay_exact_beside_others(table, scan):
    rows = flows(10 ** 18) + [flow("big", 1, "buy", HUGE, 10), flow("big", 2, "buy", HUGE, 30), flow("big", 3, "sell", HUGE, 60),
                              flow("big", 4, "sell", HUGE - 1, 50), flow(None, 1, "buy", 5, 7)]
    lots, unknown = wallets.fifo(table(FLOW, rows), scan, narrow=True)
    assert rows_of(wallets.fifo_outcomes(lots), "token", "opened_at", "closed_at", "pnl") == [
        ("big", 1, 3, 50.0), ("t", 1, 3, 30.0), ("t", 2, 4, -5.0)]
    left = wallets.open_lots(lots).withColumn("remaining", amounts.text(lots, "remaining"))
    assert rows_of(left, "token", "opened_at", "remaining") == [("big", 2, "1"), (None, 1, "5")]
    assert unknown.count() == 0


def test_positions_beyond_a_bigint_keep_their_order(table):
    rows = table("p decimal(38,0)", [(Decimal(n),) for n in (0, 10 ** 18, 10 ** 25, 10 ** 26, 10 ** 27, 9 * 10 ** 36)])
    got = [r.b for r in rows.orderBy("p").select(amounts.of_column(rows, "p").bucket(F.col("p"), 10_000_000).alias("b")).collect()]
    assert got == sorted(got) and None not in got


def test_audits_of_ordinary_tokens_too(table):
    schema = "wallet long, token string, ts long, tx long, log_index long, pool long, origin long, side string, quantity decimal(38,0), cost long, proceeds long, gas long"
    events = table(schema, [(w, "t", 1, 1, 0, 0, 0, "buy", Decimal(100 * size), 210, None, 0) for w, size in ((1, 1), (2, 10 ** 18))]
                   + [(w, "t", 2, 2, 0, 0, 0, "sell", Decimal(60 * size), None, 180, 0) for w, size in ((1, 1), (2, 10 ** 18))])
    opening = table("wallet long, token string, quantity decimal(38,0)", [(2, "t", Decimal(5))])
    placed = portfolio.place_audit_events(events, opening, TINY)
    assert placed.schema["bought"].dataType == amounts.NARROW
    sales = portfolio.audit_fifo(placed, TINY)
    sales = sales.withColumn("u", wide.to_text(F.col("unknown_quantity")))
    assert rows_of(sales, "wallet", "u", "cost", "pnl") == [(1, "0", 126.0, 54.0), (2, "5", None, None)]
    balances = table("wallet long, token string, opening decimal(38,0), ending decimal(38,0)", [(1, "t", Decimal(0), Decimal(40)), (2, "t", Decimal(5), Decimal(40 * 10 ** 18 + 5))])
    assert rows_of(portfolio.wallet_audit(placed, sales, balances), "wallet", "tokens_reconciled", "open_positions") == [(1, 1, 1), (2, 1, 1)]
