"""Screens: score and reason codes as column expressions, interchangeable through a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions.guards import age_ok, holds, is_number
from onledger.operators.rules import classify, failed, screen
from onledger.params import ScreenRules

# --- fixed values: products the exchange screen accepts ---------------------------------------------------------------
EXCHANGE_PRODUCTS = ("BTC-USD", "ETH-USD", "SOL-USD")

# --- fixed values: message prefixes that prove an execution failed ----------------------------------------------------
EXECUTION_FAILURES = (
    "Pool has no reserves",
    "Pool quote returned zero output",
    "Round-trip simulation reverted",
    "Simulation buy delivered no tokens",
    "Simulation sell delivered no quote currency",
    "entry_simulation_costs_failed",
    "independent_exit_depth_failed",
    "entry_quantity_zero",
)

_C = F.col


def priced(rules, now: Column | None = None) -> Column:
    """A positive price observed recently enough."""
    now = _C("now") if now is None else now
    return (_C("token").isNotNull() & is_number(_C("price")) & holds(_C("price") > 0) & is_number(_C("observed_at"))
            & age_ok(now, _C("observed_at"), rules.max_age))


def at_least(name: str, floor: float) -> Column:
    return is_number(_C(name)) & holds(_C(name) >= floor)


@screen("token")
def token_screen(rows: DataFrame, rules: ScreenRules = ScreenRules(), chain: str = "solana") -> DataFrame:
    """Generic token screen. A momentum score is given only when the activity of the last minutes is known."""
    active = is_number(_C("buys_m5")) & is_number(_C("sells_m5")) & is_number(_C("change_m5"), -100)
    trades = (_C("buys_m5") + _C("sells_m5")).cast("double")
    ratio = F.when(trades == 0, 0.0).otherwise(F.try_divide(_C("buys_m5").cast("double"), trades))
    rising = (_C("change_m5") > 0) & (_C("change_m5") <= rules.max_change)
    score = F.round(40 * F.least(trades / 50, F.lit(1.0)) + 40 * ratio + F.when(rising, 20).otherwise(0), 2)
    base = failed([
        ("invalid_or_stale_quote", priced(rules)),
        ("unsupported_chain", _C("chain") == chain),
        ("unsupported_or_unknown_token_program", _C("standard_token")),
        ("mint_authority_active_or_unknown", _C("mint_known") & _C("mint_authority").isNull()),
        ("freeze_authority_active_or_unknown", _C("freeze_known") & _C("freeze_authority").isNull()),
        ("liquidity_low_or_unknown", at_least("liquidity", rules.min_liquidity)),
        ("volume_h24_low_or_unknown", at_least("volume_h24", rules.min_volume)),
        ("age_seconds_low_or_unknown", at_least("age_seconds", rules.min_age_seconds)),
        ("top10_concentration_high_or_unknown",
         is_number(_C("top10_share")) & (_C("top10_share") <= rules.max_top10_share)),
    ])
    momentum = failed([
        ("weak_or_overheated_momentum", (trades >= rules.min_trades) & (ratio >= rules.min_buy_ratio) & rising),
        ("score_below_threshold", score >= rules.min_score),
    ])
    return rows.withColumns({
        "score": F.when(active, score).otherwise(0.0),
        "reasons": F.concat(base, F.when(active, momentum).otherwise(F.array(F.lit("missing_activity")))),
    })


@screen("exchange")
def exchange_screen(rows: DataFrame, rules: ScreenRules = ScreenRules(), venue: str = "coinbase") -> DataFrame:
    """Trend screen of an exchange product."""
    known = (is_number(_C("sma_fast")) & is_number(_C("sma_slow")) & holds(_C("sma_slow") != 0)
             & is_number(_C("rising_fraction")) & holds(_C("rising_fraction") <= 1))
    score = F.round(50 + 50 * _C("rising_fraction"), 2)
    base = failed([
        ("unsupported_exchange_product", (_C("venue") == venue) & _C("token").isin(*EXCHANGE_PRODUCTS)),
        ("invalid_or_stale_quote", priced(rules)),
        ("spread_high_or_unknown", is_number(_C("spread_bps")) & (_C("spread_bps") <= rules.max_spread_bps)),
        ("volume_low_or_unknown", at_least("volume_h24", rules.min_volume)),
        ("stale_or_incomplete_candles",
         is_number(_C("candle_end")) & (_C("now") - _C("candle_end")).between(0, rules.max_candle_age)),
    ])
    trend = failed([
        ("weak_trend", (F.try_divide(_C("sma_fast"), _C("sma_slow")) >= rules.min_trend_ratio)
         & (_C("rising_fraction") >= rules.min_rising)),
        ("score_below_threshold", score >= rules.min_score),
    ])
    return rows.withColumns({
        "score": F.when(known, score).otherwise(0.0),
        "reasons": F.concat(base, F.when(known, trend).otherwise(F.array(F.lit("missing_trend")))),
    })


def failure_cause(message: Column) -> Column:
    """A message that proves the execution failed, against one that only says data was missing."""
    return F.when(message.isNotNull(), classify(message, {"execution_failure": EXECUTION_FAILURES}, "data_unavailable"))


def retain(seen: DataFrame, held: DataFrame, key: str, at: str, now: Column, window: int) -> DataFrame:
    """Entities seen within the window, or held whatever their age."""
    last = seen.groupBy(key).agg(F.max(at).alias("last_seen"))
    marked = last.join(held.select(key).distinct().withColumn("held", F.lit(True)), key, "left")
    return marked.filter((_C("last_seen") >= now - window) | _C("held")).select(
        key, "last_seen", F.coalesce("held", F.lit(False)).alias("held"))


def quarantine(rows: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with the reasons); nothing is dropped."""
    judged = rows.withColumn("rejected_for", failed(rules))
    return judged.filter(F.size("rejected_for") == 0).drop("rejected_for"), judged.filter(F.size("rejected_for") > 0)
