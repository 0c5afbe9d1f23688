"""Log and call-data decoding as column expressions. Malformed input decodes to NULL, it never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onledger.functions import amounts, wide

# --- fixed values: event signatures (hashes of the public event declarations) -----------------------------------------
TOPIC_PAIR_CREATED_V2 = "0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9"
TOPIC_POOL_CREATED_V3 = "0x783cca1c0412dd0d695e784568c96da2e9c22ff989357a2e8b1d9b2b4e6b7118"
TOPIC_INITIALIZE_V4 = "0xdd466e674ea557f56295e2d0218a125ea4b4f0f6f3307b95f85e6110838d6438"
TOPIC_TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TOPIC_SWAP_V2 = "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"
TOPIC_SWAP_V3 = "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
TOPIC_SWAP_V4 = "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f"
TOPIC_MINT_V2 = "0x4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f"
TOPIC_BURN_V2 = "0xdccd412f0b1252819cb1fd330b93224ca42612892bb3f4f789976e6d81936496"
TOPIC_MINT_V3 = "0x7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde"
TOPIC_BURN_V3 = "0x0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c"
TOPIC_MODIFY_V4 = "0xf208f4912782fd25c7f114ca3723a2d5dd6f3bcc3ac8db5af63baa85f711d5ec"

# --- fixed values: deployed contracts and reserved addresses ----------------------------------------------------------
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
BURN_ADDRESS = "0x000000000000000000000000000000000000dead"
WRAPPED_NATIVE = "0x0bd7d308f8e1639fab988df18a8011f41eacad73"
FACTORY_V2 = "0x8bceaa40b9acdfaedf85adf4ff01f5ad6517937f"
FACTORY_V3 = "0x1f7d7550b1b028f7571e69a784071f0205fd2efa"
SINGLETON_V4 = "0x8366a39cc670b4001a1121b8f6a443a643e40951"

ZERO_TOPIC = "0x" + "0" * 64
NATIVE = (ZERO_ADDRESS, WRAPPED_NATIVE)
SWAP_TOPICS = (TOPIC_SWAP_V2, TOPIC_SWAP_V3, TOPIC_SWAP_V4)
LIQUIDITY_TOPICS = (TOPIC_MINT_V2, TOPIC_BURN_V2, TOPIC_MINT_V3, TOPIC_BURN_V3, TOPIC_MODIFY_V4)
V2_DEFAULT_FEE = 3000
MAX_TEXT = 120
MAX_TEXT_BYTES = 4096

# --- fixed values: accepted formats -----------------------------------------------------------------------------------
ADDRESS_FORMAT = r"\A0x[0-9a-f]{40}\z"
HASH_FORMAT = r"\A0x[0-9a-fA-F]{64}\z"
POOL_FORMAT = r"\A0x(?:[0-9a-f]{40}|[0-9a-f]{64})\z"
ATOMIC_FORMAT = r"\A[0-9]+\z"
BASE58_FORMAT = r"\A[1-9A-HJ-NP-Za-km-z]{32,44}\z"


def quantity(text: Column) -> Column:
    """``0x`` hex or decimal text to BIGINT; wider values are NULL here (use ``word`` for those)."""
    digits = F.regexp_replace(F.substring(text, 3, 1 << 30), "^0+(?=.)", "")
    hexed = F.when((F.length(digits) < 16) | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8")),
                   F.when(digits.rlike("^[0-9a-fA-F]+$"), F.conv(digits, 16, 10).try_cast("bigint")))
    return F.when(text.startswith("0x"), hexed).otherwise(text.try_cast("bigint"))


def wide_quantity(text: Column) -> Column:
    """``0x`` hex (up to 256 bits) or decimal text as a wide value; NULL only for malformed text."""
    digits = F.regexp_replace(F.substring(text, 3, 1 << 30), "^0+(?=.)", "")
    word = F.lpad(F.when(digits.rlike("^[0-9a-fA-F]{1,64}$"), digits), 64, "0")
    return F.when(text.startswith("0x"), wide.of_word(word)).otherwise(wide.of_text(text))


def narrow_quantity(text: Column) -> Column:
    """``0x`` hex of up to 22 digits or decimal text of up to 28 as DECIMAL(28,0); anything else is NULL here (see ``wide_quantity``)."""
    digits = F.lpad(F.substring(text, 3, 22), 24, "0")
    part = lambda at: F.conv(F.substring(digits, at, 12), 16, 10).cast("decimal(15,0)")
    hexed = (part(1) * F.lit(1 << 48).cast("decimal(15,0)") + part(13)).cast("decimal(28,0)")
    return F.when(text.rlike(r"\A-?[0-9]{1,28}\z"), text.cast("decimal(28,0)")).when(text.rlike(r"\A0x[0-9a-fA-F]{1,22}\z"), hexed)


def words(data: Column) -> Column:
    """The 32-byte words of call data, or NULL when it is not ``0x`` followed by whole words of hex."""
    body = F.substring(data, 3, 1 << 30)
    n = F.floor(F.length(body) / 64).cast("int")
    ok = data.startswith("0x") & (F.length(body) % 64 == 0) & body.rlike("^[0-9a-fA-F]*$")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * 64 + 3, F.lit(64)))
    return F.when(ok, F.when(n > 0, cut).otherwise(F.array().cast("array<string>")))


def bare(topic: Column) -> Column:
    """A 32-byte topic without its prefix, NULL unless it is exactly 64 hex digits."""
    body = F.regexp_replace(topic, "^0x", "")
    return F.when(body.rlike("^[0-9a-fA-F]{64}$"), body)


def address(word: Column) -> Column:
    """Right-aligned address in a word; NULL when the upper twelve bytes are not zero."""
    return F.when(F.substring(word, 1, 24) == "0" * 24, F.concat(F.lit("0x"), F.lower(F.substring(word, 25, 40))))


def unsigned(word: Column) -> Column:
    """Word as a wide value; NULL unless it is 64 hex digits."""
    return wide.of_word(word)


def signed(word: Column) -> Column:
    """Two's-complement word as a wide value."""
    return wide.of_signed_word(word)


def _narrow(word: Column, negative: Column) -> Column:
    """Low 120 bits of a word as DECIMAL(38,0), less 2**120 where ``negative``."""
    part = lambda at: F.conv(F.substring(word, at, 15), 16, 10).cast("decimal(19,0)")
    low = (part(35) * F.lit(1 << 60).cast("decimal(19,0)") + part(50)).cast(amounts.NARROW)
    return F.when(negative, (low - F.lit(str(1 << 120)).cast(amounts.NARROW)).cast(amounts.NARROW)).otherwise(low)


def narrow_unsigned(word: Column) -> Column:
    """Word below 2**120 as DECIMAL(38,0); anything else is NULL here (see ``unsigned``)."""
    return F.when(word.rlike(r"\A0{34}[0-9a-fA-F]{30}\z"), _narrow(word, F.lit(False)))


def narrow_signed(word: Column) -> Column:
    """Two's-complement word of at most 120 bits and a sign as DECIMAL(38,0); anything else is NULL here (see ``signed``)."""
    return F.when(word.rlike(r"\A(?:0{34}|[fF]{34})[0-9a-fA-F]{30}\z"), _narrow(word, ~word.startswith("0")))


def event_kind(topics: Column) -> Column:
    first = F.element_at(topics, 1)
    mint = (first == TOPIC_TRANSFER) & (F.size(topics) == 3) & (F.try_element_at(topics, F.lit(2)) == ZERO_TOPIC)
    return (F.when(first.isin(TOPIC_PAIR_CREATED_V2, TOPIC_POOL_CREATED_V3, TOPIC_INITIALIZE_V4), "pool_created")
            .when(mint, "token_mint").when(first.isin(*SWAP_TOPICS), "swap")
            .when(first.isin(*LIQUIDITY_TOPICS), "liquidity_change"))


def pool_key(emitter: Column, topics: Column) -> Column:
    """Pools of the singleton are named by an indexed id, others by their contract."""
    return F.when(F.lower(emitter) == SINGLETON_V4, F.lower(F.try_element_at(topics, F.lit(2)))).otherwise(F.lower(emitter))


def pool_created(emitter: Column, topics: Column, w: Column) -> Column:
    """Struct of a creation log, or NULL if layout and emitter do not belong together."""
    first, source = F.element_at(topics, 1), F.lower(emitter)

    def topic(i):
        return address(bare(F.try_element_at(topics, F.lit(i))))

    def word(i):
        return F.try_element_at(w, F.lit(i))

    def shape(pool, version, a, b, fee, hooks):
        return F.struct(pool.alias("pool"), F.lit(version).alias("version"), a.alias("token0"), b.alias("token1"),
                        fee.alias("fee"), hooks.alias("hooks"))

    none = F.lit(ZERO_ADDRESS)
    v2 = (first == TOPIC_PAIR_CREATED_V2) & (source == FACTORY_V2) & (F.size(topics) == 3) & (F.size(w) == 2)
    v3 = (first == TOPIC_POOL_CREATED_V3) & (source == FACTORY_V3) & (F.size(topics) == 4) & (F.size(w) == 2)
    v4 = (first == TOPIC_INITIALIZE_V4) & (source == SINGLETON_V4) & (F.size(topics) == 4) & (F.size(w) == 5)
    return (F.when(v2, shape(address(word(1)), 2, topic(2), topic(3), F.lit(V2_DEFAULT_FEE).cast("bigint"), none))
            .when(v3, shape(address(word(2)), 3, topic(2), topic(3), quantity(F.try_element_at(topics, F.lit(4))), none))
            .when(v4, shape(F.lower(F.try_element_at(topics, F.lit(2))), 4, topic(3), topic(4),
                            quantity(F.concat(F.lit("0x"), word(1))), address(word(3)))))


def swap_amounts(topics: Column, w: Column) -> Column:
    """(amount0, amount1) as seen by the pool, as wide values. The singleton reports the caller's side, so its signs are turned."""
    return _swap_amounts(topics, w, unsigned, signed, wide.minus, wide.negate)


def narrow_swap_amounts(topics: Column, w: Column) -> Column:
    """The same as DECIMAL(38,0), NULL where a word is larger: built of plain functions, several times cheaper than wide values."""
    of = amounts.of_type(amounts.NARROW)
    pair = _swap_amounts(topics, w, narrow_unsigned, narrow_signed, of.minus, of.negate)
    return F.when(pair["amount0"].isNotNull() & pair["amount1"].isNotNull(), pair)


def _swap_amounts(topics: Column, w: Column, unsigned, signed, minus, negate) -> Column:
    first = F.element_at(topics, 1)

    def at(i, read):
        return read(F.try_element_at(w, F.lit(i)))

    def pair(a, b):
        return F.struct(a.alias("amount0"), b.alias("amount1"))

    return (F.when((first == TOPIC_SWAP_V2) & (F.size(w) == 4),
                   pair(minus(at(1, unsigned), at(3, unsigned)), minus(at(2, unsigned), at(4, unsigned))))
            .when((first == TOPIC_SWAP_V3) & (F.size(w) == 5), pair(at(1, signed), at(2, signed)))
            .when((first == TOPIC_SWAP_V4) & (F.size(w) == 6), pair(negate(at(1, signed)), negate(at(2, signed)))))


def transfer(emitter: Column, topics: Column, w: Column) -> Column:
    """Fungible transfer: three topics and one word. Token-id transfers have four topics and are not recognised."""
    ok = (F.element_at(topics, 1) == TOPIC_TRANSFER) & (F.size(topics) == 3) & (F.size(w) == 1)
    return F.when(ok, F.struct(
        F.lower(emitter).alias("token"), address(bare(F.try_element_at(topics, F.lit(2)))).alias("sender"),
        address(bare(F.try_element_at(topics, F.lit(3)))).alias("recipient"), F.try_element_at(w, F.lit(1)).alias("word")))


def text(data: Column) -> Column:
    """Fixed 32-byte or dynamic string; invalid layout or encoding is NULL, at most 120 characters are kept."""
    body = F.substring(data, 3, 1 << 30)
    whole = data.startswith("0x") & body.rlike("^[0-9a-fA-F]+$") & (F.length(body) % 2 == 0)
    fixed = F.regexp_replace(body, "(00)+$", "")
    start, size = quantity(F.concat(F.lit("0x"), F.substring(body, 1, 64))), quantity(
        F.concat(F.lit("0x"), F.substring(body, 65, 64)))
    fits = (start == 32) & (size <= MAX_TEXT_BYTES) & (F.length(body) >= 128 + size * 2)
    dynamic = F.when(fits, F.substring(body, F.lit(129), (size * 2).cast("int")))
    raw = F.when(F.length(body) == 64, fixed).otherwise(dynamic)
    return F.when(whole, F.left(F.try_validate_utf8(F.unhex(raw).cast("string")), F.lit(MAX_TEXT)))


def digest_of_hex(code: Column) -> Column:
    """SHA-256 of the bytes a hex text stands for."""
    return F.sha2(F.unhex(F.substring(code, 3, 1 << 30)), 256)


def units(amount: Column, decimals: Column) -> Column:
    """Atomic amount in whole units; unknown or impossible decimals give NULL. The divisor is read, not computed, so it is
    the double nearest to the power of ten."""
    divisor = F.concat(F.lit("1e"), decimals.cast("string")).try_cast("double")
    return F.when(decimals.between(0, 36), amount.cast("double") / divisor)


def direction(token0: Column, token1: Column, amount0: Column, amount1: Column, quotes=NATIVE, narrow: bool = False) -> Column:
    """Which side is the quote currency, and whether the pool sold (buy) or took (sell) the token.

    Exactly one side must be a quote currency and the amounts, wide values or with ``narrow`` numbers, must have opposite signs.
    """
    sign, negative, size = (F.sign, lambda a: a < 0, F.abs) if narrow else (wide.sign, wide.negative, wide.magnitude)
    q0, q1 = token0.isin(*quotes), token1.isin(*quotes)
    token_amount = F.when(q0, amount1).otherwise(amount0)
    quote_amount = F.when(q0, amount0).otherwise(amount1)
    ok = (q0 != q1) & (sign(amount0) * sign(amount1) < 0)
    return F.when(ok, F.struct(
        F.when(q0, token1).otherwise(token0).alias("token"), F.when(negative(token_amount), "buy").otherwise("sell").alias("side"),
        size(token_amount).alias("token_amount"), size(quote_amount).alias("quote_amount")))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of a JSON object with its keys in order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
