"""Wide integers against Python's own."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from onledger.functions import wide

EDGES = [0, 1, -1, 10**18 - 1, 10**18, -10**18, 10**36, -10**36 - 1, 2**62, 2**63, 2**64 - 1, -2**63, 2**126, 2**127, 10**38, 2**200, -2**200, 2**255 - 1, -2**255, 2**255, 2**256 - 1]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(1)
    values = EDGES + [rng.randrange(-2**b, 2**b) for b in (8, 60, 64, 90, 130, 200, 255) for _ in range(6)]
    rows = [(a, b) for a in values for b in rng.sample(values, 12)]
    return rows, spark.createDataFrame([(str(a), str(b)) for a, b in rows], "a string, b string").repartition(2)


def test_sums_signs_and_order(pairs):
    rows, frame = pairs
    f = frame.withColumns({"x": wide.of_text(F.col("a")), "y": wide.of_text(F.col("b"))})
    out = f.select("a", "b", *[wide.to_text(c).alias(n) for n, c in {
        "plus": wide.plus(F.col("x"), F.col("y")), "minus": wide.minus(F.col("x"), F.col("y")), "neg": wide.negate(F.col("x")),
        "size": wide.magnitude(F.col("x")), "low": F.least("x", "y"), "same": F.col("x")}.items()],
        wide.sign(F.col("x")).alias("sign"), (F.col("x") < F.col("y")).alias("less"), (F.col("x") == F.col("y")).alias("equal"), wide.to_double(F.col("x")).alias("d")).collect()
    assert len(out) == len(rows)
    for r in out:
        a, b = int(r.a), int(r.b)
        assert (int(r.plus), int(r["minus"]), int(r.neg), int(r.size), int(r.low), int(r.same)) == (a + b, a - b, -a, abs(a), min(a, b), a)
        assert r.sign == (a > 0) - (a < 0) and r.less == (a < b) and r.equal == (a == b)
        assert r.d == pytest.approx(float(a), rel=1e-15)


def test_words(spark):
    values = [v for v in EDGES if v >= 0] + [2**60 - 1, 2**60]
    frame = spark.createDataFrame([(f"{v:064x}",) for v in values], "w string")
    assert [int(r.t) for r in frame.select(wide.to_text(wide.of_word(F.col("w"))).alias("t")).collect()] == values
    signed = [v for v in EDGES if -2**255 <= v < 2**255]
    frame = spark.createDataFrame([(f"{v % 2**256:064x}",) for v in signed], "w string")
    assert [int(r.t) for r in frame.select(wide.to_text(wide.of_signed_word(F.col("w"))).alias("t")).collect()] == signed
    bad = spark.createDataFrame([("0" * 63,), ("g" * 64,), (None,)], "w string")
    assert all(r.t is None for r in bad.select(wide.of_signed_word(F.col("w")).alias("t")).collect())


def test_totals_running_and_grouped(pairs):
    rows, frame = pairs
    f = frame.withColumns({"x": wide.of_text(F.col("a")), "g": F.abs(F.hash("b")) % 3})
    w = Window.partitionBy("g").orderBy("a", "b")
    got = f.select("g", "a", "b", wide.to_text(wide.total(F.col("x"), w.rowsBetween(Window.unboundedPreceding, 0))).alias("t")).collect()
    want, groups = {}, {}
    for r in sorted(got, key=lambda r: (r.g, r.a, r.b)):
        want[r.g] = want.get(r.g, 0) + int(r.a)
        groups[r.g] = want[r.g]
        assert int(r.t) == want[r.g]
    assert {r.g: int(r.t) for r in f.groupBy("g").agg(wide.to_text(wide.total(F.col("x"))).alias("t")).collect()} == groups
    assert f.filter("false").agg(wide.total(F.col("x")).alias("t")).first().t is None


def test_decimals_and_nulls(spark):
    from decimal import Decimal

    values = [v for v in EDGES if abs(v) < 10**38]
    frame = spark.createDataFrame([(Decimal(v),) for v in values] + [(None,)], "d decimal(38,0)")
    got = frame.select(wide.to_text(wide.of(F.col("d"))).alias("t"), wide.to_decimal(wide.of(F.col("d"))).alias("d")).collect()
    assert [r.t for r in got] == [str(v) for v in values] + [None] and [r.d for r in got][:-1] == values
    none = spark.sql("select cast(null as string) s").select(wide.plus(wide.of_text(F.col("s")), wide.zero()).alias("p")).first()
    assert none.p is None


def test_product_and_division(pairs):
    rows, frame = pairs
    f = frame.withColumns({"x": wide.magnitude(wide.of_text(F.col("a"))), "y": wide.magnitude(wide.of_text(F.col("b")))}).select("*", F.explode(F.array(F.lit(7))).alias("_"))
    out = f.select("a", "b", wide.product(F.col("x"), F.col("y")).alias("p"),
                   wide.to_text(wide.floor_divide(wide.product(F.col("x"), wide.of(F.lit(997))), F.col("y"))).alias("q")).collect()
    for r in out:
        a, b = abs(int(r.a)), abs(int(r.b))
        assert sum(d * 10 ** (18 * i) for i, d in enumerate(r.p)) == a * b
        assert r.q == (str(a * 997 // b) if b else None)
