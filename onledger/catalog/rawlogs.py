"""Raw chain documents rendered by Spark from the supplied tables, so decoding can be checked by round trip."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions import decode as d
from onledger.functions.pin import pinned


def word(value: Column) -> Column:
    """BIGINT as a 32-byte two's-complement word without prefix."""
    plain = F.lower(F.hex(value))
    return F.when(value < 0, F.lpad(plain, 64, "f")).otherwise(F.lpad(plain, 64, "0"))


def wide_word(value: Column) -> Column:
    """DECIMAL(38,0) below 2**127 as a 32-byte two's-complement word: its two low halves, as BIGINT each."""
    half = 1 << 64
    dec = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    low = F.pmod(value, dec(half))
    high = ((value - low).cast("decimal(38,0)") / dec(half)).cast("bigint")
    signed = F.when(low >= dec(half // 2), low - dec(half)).otherwise(low).cast("bigint")
    part = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    wide = F.concat(F.when(value < 0, "f" * 32).otherwise("0" * 32), part(high), part(signed))
    return F.when(value.between(dec(-half // 2), dec(half // 2 - 1)), word(value.cast("bigint"))).otherwise(wide)


def hexq(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def addr(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 40, "0"))


def hash32(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 64, "0"))


def data(*ws: Column) -> Column:
    return F.concat(F.lit("0x"), *ws)


def token_number(token: Column) -> Column:
    return F.regexp_extract(token, r"(\d+)$", 1).cast("bigint")


def swap_logs(swaps: DataFrame) -> DataFrame:
    """Swap logs in three layouts (by pool number), with pool and quote side known from the pool number. Token amounts are in
    atomic units of 18 decimals, beyond 64 bits."""
    c = F.col
    sign = F.when(c("side") == "buy", 1).otherwise(-1)
    native0 = c("pool") % 2 == 0
    base = swaps.withColumns({"dq": c("quote_amount") * sign, "dt": (c("token_amount").cast("decimal(19,0)") * F.lit(10 ** 18) * -sign).cast("decimal(38,0)"), "version": 2 + c("pool") % 3})
    base = base.withColumns({"a0": F.when(native0, c("dq").cast("decimal(38,0)")).otherwise(c("dt")),
                             "a1": F.when(native0, c("dt")).otherwise(c("dq").cast("decimal(38,0)"))})
    z = word(F.lit(0).cast("bigint"))
    who = hash32(c("wallet"))
    none = F.lit(0).cast("decimal(38,0)")
    minus = lambda x: (none - x).cast("decimal(38,0)")
    pick = lambda a, b, e: F.when(c("version") == 2, a).when(c("version") == 3, b).otherwise(e)
    base = pinned(base, "_a", F.struct("a0", "a1"))
    a0, a1 = c("_a.a0"), c("_a.a1")
    base = pinned(base, "_x", F.struct(
        pick(F.greatest(a0, none), a0, minus(a0)).alias("x0"), pick(F.greatest(a1, none), a1, minus(a1)).alias("x1"),
        F.greatest(minus(a0), none).alias("x2"), F.greatest(minus(a1), none).alias("x3")))
    x = [wide_word(c(f"_x.x{i}")) for i in range(4)]
    body = F.concat(x[0], x[1], pick(F.concat(x[2], x[3]), F.concat(z, z, z), F.concat(z, z, z, z)))
    topics = pick(F.array(F.lit(d.TOPIC_SWAP_V2), who, who), F.array(F.lit(d.TOPIC_SWAP_V3), who, who),
                  F.array(F.lit(d.TOPIC_SWAP_V4), hash32(c("pool")), who))
    out = base.withColumns({
        "address": pick(addr(c("pool")), addr(c("pool")), F.lit(d.SINGLETON_V4)), "topics": topics,
        "data": data(body),
        "token0": F.when(native0, d.WRAPPED_NATIVE).otherwise(addr(token_number(c("token")))),
        "token1": F.when(native0, addr(token_number(c("token")))).otherwise(F.lit(d.WRAPPED_NATIVE)),
    })
    return out.withColumn("raw", F.to_json(F.struct(
        "address", "topics", "data", hash32(c("tx")).alias("transactionHash"), hash32(c("block")).alias("blockHash"),
        hexq(c("block")).alias("blockNumber"), hexq(c("log_index")).alias("logIndex"),
        hexq(c("wallet")).alias("transactionIndex"), hexq(c("ts")).alias("blockTimestamp"),
        F.lit(False).alias("removed")))).drop("_a", "_x")


def creation_logs(part: DataFrame) -> DataFrame:
    """Pool-creation logs of three shapes; every tenth has an emitter that is not the factory."""
    c = F.col
    pool = c("p_partkey")
    base = part.withColumns({"version": 2 + pool % 3, "n0": pool % 50 + 1, "n1": pool % 70 + 100})
    t0, t1 = hash32(c("n0")), hash32(c("n1"))
    fee = (pool % 5 + 1) * 500
    pick = lambda a, b, e: F.when(c("version") == 2, a).when(c("version") == 3, b).otherwise(e)
    emitter = F.when(pool % 10 == 0, addr(pool)).otherwise(
        pick(F.lit(d.FACTORY_V2), F.lit(d.FACTORY_V3), F.lit(d.SINGLETON_V4)))
    z = word(F.lit(0).cast("bigint"))
    return base.select(
        pool.alias("pool"), "version", fee.alias("fee"), (pool % 7 - 3).alias("tick_spacing"), emitter.alias("address"),
        pick(F.array(F.lit(d.TOPIC_PAIR_CREATED_V2), t0, t1),
             F.array(F.lit(d.TOPIC_POOL_CREATED_V3), t0, t1, hash32(fee)),
             F.array(F.lit(d.TOPIC_INITIALIZE_V4), hash32(pool), t0, t1)).alias("topics"),
        pick(data(word(pool), z), data(word(fee), word(pool)),
             data(word(fee), word(pool % 7 - 3), word(pool + 7), z, z)).alias("data"))


def transfer_logs(transfers: DataFrame) -> DataFrame:
    """Transfer logs; every ninth transaction carries a token-id transfer (four topics, no data) instead."""
    c = F.col
    sender = F.when(c("sender") == "0x0", F.lit(0)).otherwise(c("sender").try_cast("bigint")).cast("bigint")
    special = c("tx") % 9 == 0
    base = transfers.withColumns({"s": sender, "r": c("recipient").cast("bigint"), "special": special})
    three = F.array(F.lit(d.TOPIC_TRANSFER), hash32(c("s")), hash32(c("r")))
    return base.withColumns({
        "address": addr(token_number(c("token"))),
        "topics": F.when(special, F.concat(three, F.array(hash32(c("amount"))))).otherwise(three),
        "data": F.when(special, F.lit("0x")).otherwise(data(word(c("amount")))),
    })
