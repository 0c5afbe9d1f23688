"""Decoding scalars, checked by round trip against the rows they were rendered from."""

from pyspark.sql import functions as F

from onledger.catalog import query
from onledger.catalog import rawlogs as raw
from onledger.functions import decode as d
from onledger.functions import timing, wide
from onledger.functions.pin import pinned
from onledger.functions.guards import clamp, finite, fraction
from onledger.sources.readers import parse_logs

C = F.col
KEY = ["tx", "log_index", "pool", "wallet"]


def parsed(t):
    return parse_logs(raw.swap_logs(t.spread().swaps))


@query("dec_01_hex_quantity", """
 SELECT tx, log_index, pool, wallet, block AS block_number, log_index AS log_number, wallet AS tx_index,
   token_amount AS from_text FROM swaps""")
def hex_quantity(t):
    return parsed(t).select(*KEY, "block_number", "log_number", "tx_index",
                            d.quantity(C("token_amount").cast("string")).alias("from_text"))


@query("dec_02_words", """
 SELECT tx, log_index, pool, wallet, CASE WHEN tx % 50 <> 0 THEN CASE pool % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 6 END END
   AS n_words FROM swaps""")
def words(t):
    rows = parsed(t)
    broken = F.when(C("tx") % 50 == 0, F.concat(C("log_data"), F.lit("ab"))).otherwise(C("log_data"))
    w = d.words(broken)
    return rows.select(*KEY, F.when(w.isNotNull(), F.size(w)).alias("n_words"))


@query("dec_03_address", """
 SELECT tx, log_index, token, CASE WHEN CAST(recipient AS BIGINT) % 40 <> 0
   THEN '0x' || lpad(lower(to_hex(CAST(recipient AS BIGINT))), 40, '0') END AS address FROM transfers""")
def address(t):
    w = raw.word(C("recipient").cast("bigint"))
    dirty = F.when(C("recipient").cast("bigint") % 40 == 0, F.concat(F.lit("01"), F.substring(w, 3, 62))).otherwise(w)
    return t.transfers.select("tx", "log_index", "token", d.address(dirty).alias("address"))


@query("dec_04_signed_word", """
 SELECT tx, log_index, pool, wallet, TEXT(CASE WHEN side = 'buy' THEN quote_amount ELSE -quote_amount END) AS amount FROM swaps""")
def signed_word(t):
    value = F.when(C("side") == "buy", C("quote_amount")).otherwise(-C("quote_amount"))
    return t.spread().swaps.select(*KEY, wide.to_text(d.signed(raw.word(value))).alias("amount"))


@query("dec_05_event_kind", """
 SELECT CASE tx % 5 WHEN 0 THEN 'pool_created' WHEN 1 THEN 'token_mint' WHEN 2 THEN 'swap' WHEN 3 THEN 'liquidity_change' END
   AS kind, CAST(count(*) AS BIGINT) AS n FROM swap_keys GROUP BY 1""")
def event_kind(t):
    who = raw.hash32(C("wallet"))
    k = C("tx") % 5
    topics = (F.when(k == 0, F.array(F.lit(d.TOPIC_POOL_CREATED_V3), who, who, who))
              .when(k == 1, F.array(F.lit(d.TOPIC_TRANSFER), F.lit(d.ZERO_TOPIC), who))
              .when(k == 2, F.array(F.lit(d.TOPIC_SWAP_V3), who, who))
              .when(k == 3, F.array(F.lit(d.TOPIC_BURN_V2), who)).otherwise(F.array(who)))
    return t.swap_keys.groupBy(d.event_kind(topics).alias("kind")).agg(F.count("*").alias("n"))


@query("dec_06_pool_created", f"""
 SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN 2 + p_partkey % 3 END AS version,
   CASE WHEN p_partkey % 10 <> 0 THEN '0x' || lpad(lower(to_hex(p_partkey)), CASE WHEN p_partkey % 3 = 2 THEN 64 ELSE 40 END, '0')
     END AS pool, CASE WHEN p_partkey % 10 <> 0 THEN '0x' || lpad(lower(to_hex(p_partkey % 50 + 1)), 40, '0') END AS token0,
   CASE WHEN p_partkey % 10 <> 0 THEN '0x' || lpad(lower(to_hex(p_partkey % 70 + 100)), 40, '0') END AS token1,
   CASE WHEN p_partkey % 10 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 3000 ELSE (p_partkey % 5 + 1) * 500 END END AS fee,
   CASE WHEN p_partkey % 10 <> 0 THEN CASE WHEN p_partkey % 3 = 2
     THEN '0x' || lpad(lower(to_hex(p_partkey + 7)), 40, '0') ELSE '{d.ZERO_ADDRESS}' END END AS hooks FROM part""")
def pool_created(t):
    rows = raw.creation_logs(t.part.select("p_partkey")).withColumn("w", d.words(C("data")))
    made = d.pool_created(C("address"), C("topics"), C("w"))
    return rows.withColumn("c", made).select(
        C("pool").alias("id"), C("c.version").cast("bigint").alias("version"), C("c.pool").alias("pool"), "c.token0",
        "c.token1", "c.fee", "c.hooks")


@query("dec_07_pool_key", """
 SELECT '0x' || lpad(lower(to_hex(pool)), CASE WHEN pool % 3 = 2 THEN 64 ELSE 40 END, '0') AS pool_key,
   CAST(count(*) AS BIGINT) AS n FROM swaps GROUP BY 1""")
def pool_key(t):
    return parsed(t).groupBy(d.pool_key(C("emitter"), C("log_topics")).alias("pool_key")).agg(F.count("*").alias("n"))


@query("dec_08_swap_amounts", """
 WITH s AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sgn FROM swaps)
 SELECT tx, log_index, pool, wallet, TEXT(CASE WHEN pool % 2 = 0 THEN quote_amount * sgn ELSE -ATOMIC(token_amount) * sgn END) AS amount0,
   TEXT(CASE WHEN pool % 2 = 0 THEN -ATOMIC(token_amount) * sgn ELSE quote_amount * sgn END) AS amount1 FROM s""")
def swap_amounts(t):
    pair = d.swap_amounts(C("log_topics"), C("words"))
    return pinned(parsed(t), "p", pair).select(
        *KEY, wide.to_text(C("p.amount0")).alias("amount0"), wide.to_text(C("p.amount1")).alias("amount1"))


@query("dec_09_transfer", """
 SELECT tx, log_index, '0x' || lpad(lower(to_hex(CAST(regexp_extract(token, '(\\d+)$', 1) AS BIGINT))), 40, '0') AS token,
   '0x' || lpad(lower(to_hex(CASE WHEN sender = '0x0' THEN 0 ELSE CAST(sender AS BIGINT) END)), 40, '0') AS sender,
   '0x' || lpad(lower(to_hex(CAST(recipient AS BIGINT))), 40, '0') AS recipient, TEXT(amount) AS amount
 FROM transfers WHERE tx % 9 <> 0""")
def transfer(t):
    rows = raw.transfer_logs(t.spread().transfers)
    rows = rows.withColumn("words", d.words(C("data")))
    moved = d.transfer(C("address"), C("topics"), C("words"))
    return rows.withColumn("m", moved).filter("m IS NOT NULL").select(
        "tx", "log_index", "m.token", "m.sender", "m.recipient", wide.to_text(d.unsigned(C("m.word"))).alias("amount"))


@query("dec_10_text", """
 SELECT p_partkey AS id, p_name AS fixed, CASE WHEN p_partkey % 6 <> 0 THEN p_name END AS dynamic FROM part""")
def text(t):
    body = F.lower(F.hex(F.encode("p_name", "utf-8")))
    size = F.octet_length("p_name").cast("bigint")
    start = F.when(C("p_partkey") % 6 == 0, 64).otherwise(32).cast("bigint")
    return t.part.select(
        C("p_partkey").alias("id"), d.text(raw.data(F.rpad(body, 64, "0"))).alias("fixed"),
        d.text(raw.data(raw.word(start), raw.word(size), F.rpad(body, 64, "0"))).alias("dynamic"))


@query("dec_11_digests", """
 SELECT p_partkey AS id, sha256(p_name) AS code_hash, sha256(p_brand || ':' || p_name) AS log_digest FROM part""")
def digests(t):
    code = F.concat(F.lit("0x"), F.lower(F.hex(F.encode("p_name", "utf-8"))))
    return t.part.select(C("p_partkey").alias("id"), d.digest_of_hex(code).alias("code_hash"),
                         F.sha2(F.concat("p_brand", F.lit(":"), "p_name"), 256).alias("log_digest"))


@query("dec_12_units", """
 SELECT tx, log_index, pool, wallet, CASE WHEN pool % 41 BETWEEN 0 AND 36 AND pool % 41 <> 20
   THEN CAST(quote_amount AS DOUBLE) / CAST('1e' || pool % 41 AS DOUBLE) END AS quote_units FROM swaps""")
def units(t):
    decimals = F.when(C("pool") % 41 != 20, C("pool") % 41)
    return t.swaps.select(*KEY, d.units(C("quote_amount"), decimals).alias("quote_units"))


@query("dec_13_direction", """
 SELECT tx, log_index, pool, wallet, '0x' || lpad(lower(to_hex(CAST(regexp_extract(token, '(\\d+)$', 1) AS BIGINT))), 40, '0')
   AS token, side, TEXT(ATOMIC(token_amount)) AS token_amount, TEXT(quote_amount) AS quote_amount FROM swaps""")
def direction(t):
    # amounts within 120 bits run on decimals; the wide columns are worked out for the other rows only
    rows = pinned(parsed(t), "n", d.narrow_swap_amounts(C("log_topics"), C("words")))
    rows = pinned(rows, "m", d.direction(C("token0"), C("token1"), C("n.amount0"), C("n.amount1"), narrow=True))
    large = C("n").isNull()
    rows = rows.withColumn("p", F.when(large, d.swap_amounts(C("log_topics"), C("words"))))
    rows = rows.withColumn("w", F.when(large, d.direction(C("token0"), C("token1"), C("p.amount0"), C("p.amount1"))))
    digits = lambda name: F.when(large, wide.to_text(C(f"w.{name}"))).otherwise(C(f"m.{name}").cast("string")).alias(name)
    return rows.select(*KEY, F.coalesce("m.token", "w.token").alias("token"), F.coalesce("m.side", "w.side").alias("side"),
                       digits("token_amount"), digits("quote_amount"))


@query("dec_14_json_paths", """
 SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.none') AS VARCHAR)
   AS missing, CAST(2 + event_id % 2 AS BIGINT) AS items, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS second_item
 FROM events""")
def json_paths(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    items = F.to_json(F.when(C("event_id") % 2 == 0, F.array(k, k + 1)).otherwise(F.array(k, k + 1, k)))
    rows = t.events.select(
        "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"),
        F.get_json_object("props", "$.none").alias("missing"), items.alias("items_json"))
    return rows.select(
        "event_id", "k", "missing", F.json_array_length("items_json").cast("bigint").alias("items"),
        F.element_at(F.from_json("items_json", "array<bigint>"), 2).alias("second_item"))


@query("dec_15_canonical_hash", """
 SELECT tx, sha256('{"pool":' || tx % 200 || ',"target":' || (leader_ts + 30) || ',"version":2}') AS case_key FROM samples""")
def canonical_hash(t):
    return t.samples.select("tx", d.canonical_hash(
        version=F.lit(2), pool=C("tx") % 200, target=C("leader_ts") + 30).alias("case_key"))


@query("dec_16_time_scalars", """
 SELECT quote_id, IDIV(ts, 60) * 60 AS minute, IDIV(ts, 60) * 60 - 60 AS closed_minute, CAST(ceil(ts + 0.25) AS BIGINT)
   AS next_second, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso,
   strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month,
   1706745600 - ts AS age FROM quotes""")
def time_scalars(t):
    ts = C("ts")
    return t.quotes.select(
        "quote_id", timing.floor_to(ts, 60).alias("minute"), timing.last_closed_start(ts).alias("closed_minute"),
        timing.ceil_second(ts + 0.25).alias("next_second"), timing.iso_utc(ts).alias("iso"), timing.day(ts).alias("day"),
        timing.month(ts).alias("month"), timing.age(F.lit(1706745600), ts).alias("age"))


GUARD_TEXT = """SELECT quote_id, CASE quote_id % 6 WHEN 0 THEN TEXT(cents / 100.0E0) WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity'
  WHEN 3 THEN 'n/a' WHEN 4 THEN '0.25' END AS value, cents FROM quotes"""


@query("dec_17_guards", """
 SELECT quote_id, CASE quote_id % 6 WHEN 0 THEN cents / 100.0::DOUBLE WHEN 4 THEN 0.25::DOUBLE END AS finite_value,
   CASE WHEN quote_id % 6 = 4 THEN 0.25::DOUBLE WHEN quote_id % 6 = 0 AND cents <= 100 THEN cents / 100.0::DOUBLE END AS share,
   greatest(-15.0::DOUBLE, least(15.0::DOUBLE, cents / 1000.0::DOUBLE)) AS clamped FROM quotes""")
def guards(t):
    rows = t.sql(GUARD_TEXT)
    return rows.select("quote_id", finite(C("value")).alias("finite_value"), fraction(C("value")).alias("share"),
                       clamp(C("cents") / 1000.0, -15.0, 15.0).alias("clamped"))


@query("dec_18_formats", """
 SELECT tx, log_index, pool, wallet, tx % 4 <> 0 AS address_ok, tx % 5 <> 0 AS hash_ok, true AS pool_ok, tx % 6 <> 0 AS atomic_ok
 FROM swap_keys""")
def formats(t):
    a, h = raw.addr(C("wallet")), raw.hash32(C("tx"))
    bad_a = F.when(C("tx") % 4 == 0, F.concat(a, F.lit("0"))).otherwise(a)
    bad_h = F.when(C("tx") % 5 == 0, F.substring(h, 1, 65)).otherwise(h)
    p = F.when(C("pool") % 3 == 2, raw.hash32(C("pool"))).otherwise(raw.addr(C("pool")))
    n = F.when(C("tx") % 6 == 0, F.concat(C("token_amount").cast("string"), F.lit(".0"))).otherwise(
        C("token_amount").cast("string"))
    return t.swap_keys.select(*KEY, bad_a.rlike(d.ADDRESS_FORMAT).alias("address_ok"), bad_h.rlike(d.HASH_FORMAT).alias(
        "hash_ok"), p.rlike(d.POOL_FORMAT).alias("pool_ok"), n.rlike(d.ATOMIC_FORMAT).alias("atomic_ok"))
