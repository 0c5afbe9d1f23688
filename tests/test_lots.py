"""FIFO matching: fixed cases and random histories against a sequential model."""

import random
from fractions import Fraction

import pytest

from conftest import rows_of
from pyspark.sql import functions as F

from onledger.functions import wide
from onledger.operators import lots
from onledger.params import ScanRules
from onledger.plans import portfolio, wallets

FLOW = ("wallet long, token string, ts long, tx long, log_index long, pool long, origin long, side string, quantity long, "
        "quote long, gas long")
TINY = ScanRules(max_rows=4, bucket_seconds=7, bucket_units=5)


def flow(wallet, token, ts, side, quantity, quote, gas=0, tx=None):
    return (wallet, token, ts, ts if tx is None else tx, 0, 0, 0, side, quantity, quote, gas)


def test_partial_close_then_close(table):
    rows = [flow(1, "t", 1, "buy", 100, 100, 1), flow(1, "t", 2, "sell", 50, 70, 1), flow(1, "t", 3, "sell", 50, 70, 1)]
    all_lots, unknown = wallets.fifo(table(FLOW, rows), TINY)
    assert rows_of(all_lots, "state", "pnl", "closed_at", "hold_seconds") == [("closed", 37.0, 3, 2)]
    assert unknown.count() == 0


def test_sale_without_stock_is_unknown_and_never_wins(table):
    flows = table(FLOW, [flow(1, "t", 1, "sell", 5, 100)])
    all_lots, unknown = wallets.fifo(flows, TINY)
    assert unknown.count() == 1 and all_lots.count() == 0
    profile = wallets.wallet_profile(flows, all_lots, unknown).collect()[0]
    assert (profile.wins, profile.unknown_basis, profile.eligible) == (0, 1, False)
    assert profile.score == 48.0 and profile.median_return_pct is None


def test_qualified_wallet(table):
    rows = []
    for i in range(10):
        rows += [flow(1, f"t{i}", 10 * i + 1, "buy", 10, 100), flow(1, f"t{i}", 10 * i + 2, "sell", 10, 150)]
    flows = table(FLOW, rows)
    profile = wallets.wallet_profile(flows, *wallets.fifo(flows, TINY)).collect()[0]
    assert (profile.closed_lots, profile.wins, profile.eligible, profile.median_return_pct) == (10, 10, True, 50.0)


def model(events):
    """Sequential matching with exact fractions: (closed, open, unknown)."""
    stock, closed, unknown = [], [], 0
    for ts, side, quantity, quote, gas in events:
        if side == "buy":
            stock.append([quantity, quantity, Fraction(quote + gas), ts, Fraction(0)])
            continue
        if sum(x[1] for x in stock) < quantity:
            unknown += 1
            stock = []
            continue
        need = quantity
        for lot in stock:
            used = min(need, lot[1])
            lot[1] -= used
            lot[4] += Fraction(used * (quote - gas), quantity)
            need -= used
            if not lot[1]:
                closed.append((lot[3], ts, float(lot[4] - lot[2])))
        stock = [x for x in stock if x[1]]
    return closed, [(x[3], x[1], float(x[2] * x[1] / x[0]), float(x[4] - x[2] * (x[0] - x[1]) / x[0])) for x in stock], unknown


@pytest.mark.parametrize("seed,scan", [(1, TINY), (2, ScanRules(max_rows=0, bucket_seconds=3, bucket_units=2)), (3, ScanRules())])
def test_random_histories_equal_the_sequential_model(table, seed, scan):
    rng, rows, want_closed, want_open, want_unknown = random.Random(seed), [], [], [], 0
    for wallet in range(40):
        events = []
        for ts in range(rng.choice([0, 1, 5, 60])):
            events.append((ts, rng.choice(["buy", "buy", "sell"]), rng.randint(1, 9), rng.randint(1, 500), rng.randint(0, 3)))
        rows += [flow(wallet, "t", ts, side, q, v, g) for ts, side, q, v, g in events]
        closed, opened, unknown = model(events)
        want_closed += [(wallet, *x) for x in closed]
        want_open += [(wallet, *x) for x in opened]
        want_unknown += unknown
    all_lots, unknown = wallets.fifo(table(FLOW, rows), scan)
    got = [(r.wallet, r.opened_at, r.closed_at, r.pnl) for r in wallets.fifo_outcomes(all_lots).collect()]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want_closed)]
    assert [x[3] for x in sorted(got)] == pytest.approx([x[3] for x in sorted(want_closed)], abs=1e-6)
    held = [(r.wallet, r.opened_at, int(r.remaining), r.remaining_cost, r.realized)
            for r in wallets.open_lots(all_lots).withColumn("remaining", wide.to_text(F.col("remaining"))).collect()]
    assert [x[:3] for x in sorted(held)] == [x[:3] for x in sorted(want_open)]
    assert [x[3:] for x in sorted(held)] == [pytest.approx(x[3:], abs=1e-6) for x in sorted(want_open)]
    assert unknown.count() == want_unknown


def test_audit_keeps_unknown_stock_apart(table):
    events = table("wallet long, token string, ts long, tx long, log_index long, pool long, origin long, side string, quantity long, "
                   "cost long, proceeds long, gas long",
                   [(1, "t", 1, 1, 0, 0, 0, "buy", 100, 210, None, 0), (1, "t", 2, 2, 0, 0, 0, "sell", 40, None, None, 0),
                    (1, "t", 3, 3, 0, 0, 0, "sell", 60, None, 180, 0), (2, "t", 1, 4, 0, 0, 0, "buy", 10, 50, None, 0),
                    (2, "t", 2, 5, 0, 0, 0, "sell", 12, None, 90, 0), (3, "t", 2, 6, 0, 0, 0, "sell", 9, None, 90, 0)])
    opening = table("wallet long, token string, quantity long", [(2, "t", 5)])
    sales = portfolio.audit_fifo(portfolio.place_audit_events(events, opening, TINY), TINY)
    sales = sales.withColumn("unknown_quantity", wide.to_text(F.col("unknown_quantity")))
    assert rows_of(sales, "wallet", "unknown_quantity", "cost", "pnl") == [
        (1, "0", 126.0, 54.0), (2, "5", None, None), (3, "9", None, None)]


def test_entry_rank_counts_distinct_earlier_buyers(table):
    rows = [flow(1, "t", 1, "buy", 1, 1), flow(1, "t", 2, "buy", 1, 1), flow(2, "t", 3, "buy", 1, 1), flow(3, "t", 9, "buy", 1, 1)]
    assert rows_of(lots.entry_ranks(table(FLOW, rows), TINY), "ts", "entry_rank") == [(1, 1), (2, 2), (3, 2), (9, 3)]
