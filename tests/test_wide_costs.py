"""Wide sums and readings: right at every edge, and without decimal division per row."""

import itertools
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from onledger.catalog import rawlogs as raw
from onledger.functions import wide

EDGES = [0, 1, -1, 10**18 - 1, 10**18, -10**18, 2**60 - 1, 2**60, -2**60, -2**60 - 1, 2**63, -2**63, 2**64, 2**120 - 1, 2**120,
         -2**120, -2**120 - 1, 2**255 - 1, -2**255]


def values():
    rng = random.Random(5)
    return EDGES + [rng.choice([1, -1]) * rng.getrandbits(rng.randint(1, 255)) for _ in range(60)]


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_decimals_at_the_edges(spark):
    rows = [(str(v), format(v % 2**256, "064x"), Decimal(v) if abs(v) < 2**127 and abs(v) < 10**38 else None) for v in values()]
    c = F.col
    out = spark.createDataFrame(rows, "text string, word string, dec decimal(38,0)").select(
        "*", wide.to_text(wide.of_signed_word(c("word"))).alias("read"), wide.to_text(wide.of(c("dec"))).alias("cut"),
        raw.wide_word(c("dec")).alias("written")).collect()
    assert all(r.read == r.text for r in out)
    assert all(r.cut == r.text and r.written == r.word for r in out if r.dec is not None)


def test_sums_add_bigints_only(spark):
    rows = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values())], "i int, text string").select("i", wide.of_text(F.col("text")).alias("x"))
    over = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("i", wide.total(F.col("x"), over).alias("s"))
    got = [r.s for r in running.select("i", wide.to_text(F.col("s")).alias("s")).orderBy("i").collect()]
    assert got == [str(v) for v in itertools.accumulate(values())]
    assert "decimal" not in plan(running).lower()
