"""Decoding, exact integers, guards and redaction."""

import random

from pyspark.sql import functions as F

from onledger.functions import bigint
from onledger.functions import decode as d
from onledger.functions import wide
from onledger.functions.guards import clamp, finite, fraction, freshness
from onledger.plans.redaction import redact
from onledger.plans.signals import net_deltas


def word(n):
    return format(n % (1 << 256), "064x")


def test_three_swap_layouts_agree(table):
    rows = [(d.TOPIC_SWAP_V2, "0x" + word(100) + word(0) + word(0) + word(20)),
            (d.TOPIC_SWAP_V3, "0x" + word(100) + word(-20) + word(0) * 3),
            (d.TOPIC_SWAP_V4, "0x" + word(-100) + word(20) + word(0) * 4),
            (d.TOPIC_SWAP_V3, "0x" + word(100))]
    df = table("topic string, data string", rows).withColumn("w", d.words(F.col("data")))
    out = df.select(d.swap_amounts(F.array("topic"), F.col("w")).alias("p")).select(*[wide.to_text(F.col(f"p.{c}")).alias(c) for c in ("amount0", "amount1")]).collect()
    assert [(r.amount0, r.amount1) for r in out] == [("100", "-20")] * 3 + [(None, None)]


def test_no_swap_of_wide_words_is_lost(table):
    values = [2**126, 2**255 - 1, -2**255, -2**126 - 1, 2**200]
    rows = [(d.TOPIC_SWAP_V3, "0x" + word(v) + word(-1 if v > 0 else 1) + word(0) * 3, v) for v in values] + [
        (d.TOPIC_SWAP_V2, "0x" + word(2**256 - 1) + word(0) + word(0) + word(2**256 - 2), 2**256 - 1)]
    df = table("topic string, data string, v string", [(t, x, str(v)) for t, x, v in rows]).withColumn("w", d.words(F.col("data")))
    df = df.select("v", d.swap_amounts(F.array("topic"), F.col("w")).alias("p"))
    made = d.direction(F.lit(d.NATIVE[1]), F.lit("0xt"), F.col("p.amount0"), F.col("p.amount1"))
    out = df.select("v", made.alias("m")).select("v", "m.side", wide.to_text(F.col("m.quote_amount")).alias("q")).collect()
    assert [(r.side, int(r.q)) for r in out] == [("buy" if v > 0 else "sell", abs(v)) for *_, v in rows]
    nets = df.select(F.lit("t").alias("token"), F.lit("0x0").alias("sender"), F.lit("w").alias("recipient"), F.col("p.amount0").alias("amount"))
    assert int(net_deltas(nets, ["token"]).select(wide.to_text(F.col("delta")).alias("d")).first().d) == sum(v for *_, v in rows)


def test_spoofed_emitter_creates_no_pool(table):
    data = "0x" + word(7) + word(0)
    rows = [(d.FACTORY_V2, data), ("0x" + "1" * 40, data)]
    df = table("emitter string, data string", rows).withColumn("w", d.words(F.col("data")))
    topics = F.array(F.lit(d.TOPIC_PAIR_CREATED_V2), F.lit("0x" + word(1)), F.lit("0x" + word(2)))
    made = df.select(d.pool_created(F.col("emitter"), topics, F.col("w")).alias("c")).collect()
    assert made[0].c.pool == "0x" + word(7)[24:] and made[0].c.fee == 3000 and made[1].c is None


def test_token_id_transfer_is_ignored_and_addresses_are_checked(table):
    t = "0x" + word(5)
    rows = [([d.TOPIC_TRANSFER, t, t], "0x" + word(50)), ([d.TOPIC_TRANSFER, t, t, t], "0x"),
            ([d.TOPIC_TRANSFER, "0x" + "f" * 64, t], "0x" + word(50))]
    df = table("topics array<string>, data string", rows).withColumn("w", d.words(F.col("data")))
    out = [r.m for r in df.select(d.transfer(F.lit("0xAB"), F.col("topics"), F.col("w")).alias("m")).collect()]
    assert out[0].token == "0xab" and out[0].recipient == "0x" + word(5)[24:] and out[1] is None and out[2].sender is None


def test_signed_and_unsigned_limits(table):
    values = [0, 1, -1, 2**60, -(2**60), -(2**60) - 1, 2**63, -(2**63), 2**64 - 1, -(2**64), 2**125, -(2**125), 2**126, 2**200, 2**255 - 1, -(2**255)]
    df = table("w string", [(word(v),) for v in values])
    assert [int(r.v) for r in df.select(wide.to_text(d.signed(F.col("w"))).alias("v")).collect()] == values


def test_quantity_and_words_reject_malformed(table):
    df = table("x string", [("0x10",), ("12",), (None,), ("0xzz",), ("0x" + "f" * 17,), ("0x000000000000000000001f",)])
    assert [r.v for r in df.select(d.quantity(F.col("x")).alias("v")).collect()] == [16, 12, None, None, None, 31]
    w = table("x string", [("0x",), ("0x" + "0" * 63,), ("nope",), ("0x" + "g" * 64,)])
    assert [r.v for r in w.select(d.words(F.col("x")).alias("v")).collect()] == [[], None, None, None]


def test_text_decoding(table):
    fixed = "0x" + b"WETH".hex().ljust(64, "0")
    dynamic = "0x" + word(32) + word(5) + "héy!".encode().hex().ljust(64, "0")
    broken = "0x" + "ff" * 32
    df = table("x string", [(fixed,), (dynamic,), (broken,), ("0x" + word(64) + word(4) + word(0),)])
    assert [r.v for r in df.select(d.text(F.col("x")).alias("v")).collect()] == ["WETH", "héy!", None, None]


def test_limb_sums_equal_python_integers(table):
    rng = random.Random(4)
    data = [(i % 3, rng.randrange(2**250), rng.random() < 0.5) for i in range(200)] + [(3, 5, True), (3, 7, False)]
    df = table("k long, w string, plus boolean", [(k, word(v), p) for k, v, p in data])
    limbs = bigint.from_hex(F.col("w"))
    signed = F.when(F.col("plus"), limbs).otherwise(F.transform(limbs, lambda x: -x))
    out = df.select("k", signed.alias("l")).groupBy("k").agg(*bigint.limb_sums(F.col("l"), "s")).select(
        "k", bigint.settle(bigint.gather("s")).alias("t")).select(
        "k", bigint.to_hex(F.col("t")).alias("h"), bigint.to_decimal(F.col("t")).alias("d"), "t.overflow")
    for r in out.collect():
        want = sum(v if p else -v for k, v, p in data if k == r.k)
        if abs(want) < 2**256:
            assert int(r.h, 16) == want
        else:
            assert r.overflow != 0
        assert r.d == want if abs(want) < 10**38 else r.d is None


def test_guards_keep_unknown_unknown(table):
    df = table("x string, n double", [("NaN", None), ("Infinity", 3.0), ("abc", -99.0), ("0.5", 99.0), ("1.5", 0.0)])
    out = df.select(finite(F.col("x")).alias("f"), fraction(F.col("x")).alias("s"), clamp(F.col("n"), -15.0, 15.0).alias("c")).collect()
    assert [r.f for r in out] == [None, None, None, 0.5, 1.5] and [r.s for r in out] == [None, None, None, 0.5, None]
    assert [r.c for r in out] == [None, 3.0, -15.0, 15.0, 0.0]
    t = table("at long", [(100,), (115,), (116,), (-21,), (None,)])
    assert [r.s for r in t.select(freshness(F.lit(100), F.col("at"), 120).alias("s")).collect()] == [
        "fresh", "fresh", "stale", "stale", "unknown"]


def test_redaction(table):
    rows = [("see https://a.b/c?d=1 now", 'Bearer abc.DEF', "plain"), ('{"api_key": "x\\"y", "n": 5}', "password = hunter2, ok", None),
            ("sk-proj-" + "a" * 20, "0x" + "1" * 40, "s")]
    out = redact(table("a string, b string, secret string", rows), ["a", "b", "secret"]).collect()
    assert (out[0].a, out[0].b, out[0].secret) == ("see [REDACTED_URL] now", "[REDACTED_CREDENTIAL]", "[REDACTED_CREDENTIAL]")
    assert out[1].a == '{"api_key": "[REDACTED_CREDENTIAL]", "n": 5}' and out[1].b == "[REDACTED_CREDENTIAL], ok"
    assert out[2].a == "[REDACTED_CREDENTIAL]" and out[2].b == "0x" + "1" * 40
    assert out[1].redactions.credential_fields == 1 and out[1].secret is None and out[0].redactions.urls == 1
