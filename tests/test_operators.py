"""Scans, joins and windows against brute force on small skewed inputs."""

import random
import statistics

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from onledger.operators import aggregates, joins, scan, windows
from onledger.params import ScanRules

TINY = ScanRules(max_rows=4, bucket_seconds=5, bucket_units=5)


def skewed(n=300, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randint(0, 60), i, rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 50, 10**6])
def test_running_sum_last_and_next(table, limit):
    data = skewed()
    df = table("k string, ts long, id long, v long", data)
    out = scan.running(df, ["k"], ["ts", "id"], scan.width_bucket("ts", 4), max_rows=limit, sums={"s": (F.coalesce("v", F.lit(0)), True)},
                       lasts={"p": (F.col("v"), False)}, nexts={"n": (F.col("v"), True)})
    want = []
    for k in {x[0] for x in data}:
        rows, total = sorted(x for x in [(d[1], d[2], d[3]) for d in data if d[0] == k]), 0
        for i, (ts, id_, v) in enumerate(rows):
            total += v or 0
            last = next((x[2] for x in reversed(rows[:i]) if x[2] is not None), None)
            nxt = next((x[2] for x in rows[i:] if x[2] is not None), None)
            want.append((id_, total, last, nxt))
    assert sorted(tuple(r) for r in out.select("id", "s", "p", "n").collect()) == sorted(want)


def test_range_totals_and_trailing_distinct(table):
    rng = random.Random(5)
    data = [(rng.choice("xy"), rng.randint(0, 80), i, rng.randint(0, 6), rng.randint(1, 9)) for i in range(200)]
    df = table("k string, ts long, id long, member long, v long", data)
    n = joins.range_totals(df, df, ["k"], ["id"], "ts", "ts", 10, {"n": F.lit(1).cast("bigint"), "v": F.col("v")}, TINY)
    d = joins.trailing_distinct(df, df, ["k"], ["id"], "ts", "member", "id", 10, "d", TINY)
    near = {x[2]: [y for y in data if y[0] == x[0] and x[1] - 10 <= y[1] <= x[1]] for x in data}
    assert rows_of(n, "id", "n", "v") == sorted((i, len(y), sum(z[4] for z in y)) for i, y in near.items())
    assert rows_of(d, "id", "d") == sorted((i, len({z[3] for z in y})) for i, y in near.items())


def test_asof_never_looks_ahead(table):
    facts = table("k string, at long, price long, fid long", [("a", 10, 1, 1), ("a", 20, 2, 2), ("a", 20, 3, 3), ("a", 99, 9, 4)])
    looks = table("k string, t long, id long", [("a", 9, 0), ("a", 10, 1), ("a", 20, 2), ("a", 31, 3), ("b", 50, 4)])
    back = joins.asof_backward(looks, facts, ["k"], ["id"], "t", "at", ["price"], ["fid"], 10, TINY)
    assert [tuple(r) for r in back.orderBy("id").select("found_at", "price").collect()] == [
        (None, None), (10, 1), (20, 3), (None, None), (None, None)]
    ahead = joins.asof_forward(looks, facts, ["k"], ["id"], "t", "at", ["price"], ["fid"], 5, TINY)
    assert [tuple(r) for r in ahead.orderBy("id").select("found_at", "price").collect()] == [
        (10, 1), (10, 1), (20, 2), (None, None), (None, None)]


def test_last_closed_candle_skips_the_open_one(table):
    candles = table("start long, close long", [(0, 5), (60, 6), (120, 7)])
    looks = table("t long", [(59,), (60,), (119,), (120,), (400,)])
    out = joins.last_closed(looks, candles, "t", 60, 120, ["close"]).orderBy("t")
    assert [r.close for r in out.collect()] == [None, 5, 5, 6, None]


def test_not_in_follows_the_null_rule(table):
    left = table("x long", [(1,), (2,), (None,)])
    assert [r.x for r in joins.not_in(left, table("x long", [(1,)]), "x").collect()] == [2]
    assert joins.not_in(left, table("x long", [(1,), (None,)]), "x").count() == 0
    assert joins.not_in(left, table("x long", []), "x").count() == 3
    assert {r.x for r in joins.anti(left, table("x long", [(1,), (None,)]), ["x"]).collect()} == {2, None}


def test_exact_median_of_many_sizes(table):
    rng, data, want = random.Random(9), [], {}
    for k, n in enumerate([1, 2, 3, 10, 11, 4000]):
        values = [round(rng.choice([rng.gauss(0, 1), 0.5]), 3) for _ in range(n)]
        data += [(k, v) for v in values]
        want[k] = statistics.median(values)
    got = aggregates.exact_median(table("k long, v double", data), ["k"], "v", "m")
    assert {r.k: round(r.m, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_greedy_pairs_keeps_the_origin_of_an_accepted_wallet_free(table):
    # the second row of w1 is refused and must not claim o2, so w2 may still use it
    data = [("g", 1, "w1", "o1"), ("g", 2, "w1", "o2"), ("g", 3, "w2", "o2"), ("g", 4, "w3", "o1"), ("h", 1, "w1", "o9")]
    out = windows.greedy_pairs(table("g string, ts long, w string, o string", data), ["g"], "w", "o", ["ts"])
    assert rows_of(out, "g", "w", "o") == [("g", "w1", "o1"), ("g", "w2", "o2"), ("h", "w1", "o9")]


def test_greedy_pairs_random(table):
    rng = random.Random(11)
    data = [(rng.choice("gh"), i, rng.randint(0, 12), rng.randint(0, 12)) for i in range(150)]
    want = []
    for g in "gh":
        ws, os_ = set(), set()
        for _, ts, w, o in [x for x in data if x[0] == g]:
            if w not in ws and o not in os_:
                ws.add(w), os_.add(o), want.append((g, ts, w, o))
    out = windows.greedy_pairs(table("g string, ts long, w long, o long", data), ["g"], "w", "o", ["ts"])
    assert rows_of(out, "g", "ts", "w", "o") == sorted(want)


def test_candle_trend_needs_twenty_gap_free_candles(table):
    rows = [(60 * i, 100 + i) for i in range(21)] + [(60 * 30, 5)]
    out = windows.candle_trend(table("start long, close_cents long", rows), [], 60, block=20).orderBy("start").collect()
    assert [r.start for r in out if r.sma_slow is not None] == [60 * 19, 60 * 20]
    last = out[20]
    assert (last.sma_fast, last.sma_slow, last.rising_fraction, last.candle_end) == (118.0, 110.5, 1.0, 60 * 21)


def test_reconcile_states(table):
    a = table("k long, v long", [(1, 1), (2, 2), (3, None), (4, 4)])
    b = table("k long, v long", [(1, 1), (2, 9), (3, None), (5, 5)])
    out = joins.reconcile(a, b, ["k"], ["v"])
    assert rows_of(out, "k", "status", "differing") == [
        (1, "matched", None), (2, "mismatched", "v"), (3, "matched", None), (4, "left_only", None), (5, "right_only", None)]
