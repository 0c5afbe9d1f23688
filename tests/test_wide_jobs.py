"""Jobs over token amounts that no SQL integer holds."""

import random

import pytest
from pyspark.sql import functions as F

from onledger.functions import wide
from onledger.params import ScanRules
from onledger.plans import portfolio, wallets
from test_lots import FLOW, TINY, flow, model

UNIT = 2**200


def widened(rows, name):
    return rows.withColumn(name, wide.of_text(F.col(name)))


@pytest.mark.parametrize("scan", [TINY, ScanRules()])
def test_fifo_at_two_to_the_200(table, scan):
    rng, rows, want_closed, want_open, want_unknown = random.Random(5), [], [], [], 0
    for wallet in range(20):
        events = [(ts, rng.choice(["buy", "buy", "sell"]), rng.randint(1, 9) * UNIT, rng.randint(1, 500), rng.randint(0, 3)) for ts in range(25)]
        rows += [flow(wallet, "t", ts, side, str(q), v, g) for ts, side, q, v, g in events]
        closed, opened, unknown = model(events)
        want_closed += [(wallet, *x) for x in closed]
        want_open += [(wallet, *x) for x in opened]
        want_unknown += unknown
    all_lots, unknown = wallets.fifo(widened(table(FLOW.replace("quantity long", "quantity string"), rows), "quantity"), scan)
    got = sorted((r.wallet, r.opened_at, r.closed_at, r.pnl) for r in wallets.fifo_outcomes(all_lots).collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want_closed)]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in sorted(want_closed)], abs=1e-6)
    held = wallets.open_lots(all_lots).withColumn("remaining", wide.to_text(F.col("remaining"))).collect()
    assert sorted((r.wallet, r.opened_at, int(r.remaining)) for r in held) == [x[:3] for x in sorted(want_open)]
    assert unknown.count() == want_unknown


def test_two_buys_of_five_units_with_18_decimals(table):
    rows = [flow(1, "t", 1, "buy", 5 * 10**18, 10), flow(1, "t", 2, "buy", 5 * 10**18, 10), flow(1, "t", 3, "sell", 8 * 10**18, 40)]
    all_lots, _ = wallets.fifo(table(FLOW, rows))
    assert [(r.pnl, r.hold_seconds) for r in wallets.fifo_outcomes(all_lots).collect()] == [(15.0, 2)]


def test_ledger_and_audit_at_two_to_the_200(table):
    moves = widened(table("token string, sender string, recipient string, amount string", [
        ("t", "0x0", "a", str(60 * UNIT)), ("t", "0x0", "b", str(40 * UNIT)), ("t", "a", "b", str(10 * UNIT)), ("u", "0x0", "a", str(UNIT)), ("v", "x", "y", "1")]), "amount")
    supply = widened(table("token string, supply string", [("t", str(100 * UNIT)), ("u", str(UNIT + 1)), ("v", "1")]), "supply")
    out = portfolio.holder_ledger(moves, supply).orderBy("token").collect()
    assert [(r.status, r.reason, r.holders, r.top10_share) for r in out] == [
        ("reconciled", None, 2, 1.0), ("rejected", "supply_mismatch", None, None), ("rejected", "negative_balance", None, None)]
    schema = "wallet long, token string, ts long, tx long, log_index long, pool long, origin long, side string, quantity string, cost long, proceeds long, gas long"
    events = widened(table(schema, [(1, "t", 1, 1, 0, 0, 0, "buy", str(100 * UNIT), 210, None, 0), (1, "t", 2, 2, 0, 0, 0, "sell", str(40 * UNIT), None, None, 0),
                                    (1, "t", 3, 3, 0, 0, 0, "sell", str(60 * UNIT), None, 180, 0), (2, "t", 1, 4, 0, 0, 0, "sell", str(UNIT + 1), None, 9, 0)]), "quantity")
    opening = widened(table("wallet long, token string, quantity string", [(2, "t", str(UNIT))]), "quantity")
    placed = portfolio.place_audit_events(events, opening, TINY)
    sales = portfolio.audit_fifo(placed, TINY)
    got = {r.wallet: (r.u, r.cost, r.pnl) for r in sales.withColumn("u", wide.to_text(F.col("unknown_quantity"))).collect()}
    assert got == {1: ("0", pytest.approx(126.0), pytest.approx(54.0)), 2: (str(UNIT + 1), None, None)}
    balances = widened(widened(table("wallet long, token string, opening string, ending string", [(1, "t", "0", "0"), (2, "t", str(UNIT), "-1")]), "opening"), "ending")
    audit = {r.wallet: (r.tokens_reconciled, r.open_positions, r.pnl) for r in portfolio.wallet_audit(placed, sales, balances).collect()}
    assert audit == {1: (1, 0, pytest.approx(54.0)), 2: (1, 0, None)}


def test_exact_quotes(table):
    cases = [(10**18, 5 * 10**18, 9 * 10**26), (1, 10**27, 10**18), (2**200, 2**250, 2**250 - 7), (10**18, 0, 5), (0, 7, 9)]
    rows = table("a string, i string, o string", [tuple(map(str, c)) for c in cases])
    for name in ("a", "i", "o"):
        rows = widened(rows, name)
    got = [r.q for r in rows.select(wide.to_text(portfolio.constant_product_quote(F.col("a"), F.col("i"), F.col("o"))).alias("q")).collect()]
    assert got == [str(a * 997 * o // (i * 1000 + a * 997)) if i and o else None for a, i, o in cases]
