"""Frozen settings. Every job takes one of these instead of module globals, so results can be stamped with a hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# --- fixed values: thresholds and windows that define results ---------------------------------------------------------
CLOCK_SKEW_SECONDS = 15
MAX_AGE_SECONDS = 120
SOURCE_MAX_AGE_SECONDS = 3600
APPROVAL_MAX_AGE_SECONDS = 300
REFRESH_MAX_ATTEMPTS = 3
REFRESH_COOLDOWN_SECONDS = 300
REFRESH_RUNNING_TIMEOUT_SECONDS = 300
REFRESH_QUEUED_TIMEOUT_SECONDS = 600
FEED_MAX_AGE_SECONDS = 30


@dataclass(frozen=True)
class ScreenRules:
    """Generic token and exchange screens, and the paper cost model."""

    max_age: int = 120
    min_liquidity: float = 25000.0
    min_volume: float = 10000.0
    min_age_seconds: int = 3600
    max_top10_share: float = 0.5
    min_score: float = 65.0
    min_trades: int = 20
    min_buy_ratio: float = 0.55
    max_change: float = 30.0
    max_spread_bps: float = 20.0
    max_candle_age: int = 120
    min_trend_ratio: float = 1.0005
    min_rising: float = 0.5
    fee_bps: float = 30.0
    slippage_bps: float = 100.0
    network_fee: float = 0.005
    position_size: float = 2.0
    stop_loss: float = 0.15
    take_profit: float = 0.25
    max_hold_seconds: int = 3600
    cooldown_seconds: int = 3600


@dataclass(frozen=True)
class LaunchRules:
    max_age: int = 120
    min_liquidity: float = 25000.0
    max_top10_share: float = 0.5
    min_score: float = 65.0
    max_launch_age: int = 86400
    snipe_age: int = 300
    snipe_buyers: int = 3
    mirror_wallets: int = 1
    max_risk_age: int = 120
    max_tax: float = 0.03
    min_lp_burned: float = 0.95
    max_roundtrip_loss: float = 0.10


@dataclass(frozen=True)
class WalletRules:
    min_closed: int = 10
    min_tokens: int = 5
    min_score: float = 70.0


@dataclass(frozen=True)
class FollowerRules:
    window: int = 60
    delay: int = 30
    entry_deadline: int = 120
    exit_grace: int = 120
    step: int = 30
    max_entry_gap: int = 5
    max_hold: int = 900
    stop_loss: float = 0.08
    take_profit: float = 0.20
    slippage: float = 0.01
    network_fee: float = 0.005
    position_size: float = 2.0
    max_entry_premium: float = 0.02
    max_launch_age: int = 900
    max_transfer_tax: float = 0.03
    max_roundtrip_loss: float = 0.10
    min_exit_fraction: float = 0.9
    max_fx_age: int = 120
    stress_return: float = -1.0
    min_samples: int = 10
    min_tokens: int = 5
    min_coverage: float = 0.8
    min_win_rate: float = 0.55
    min_mean_return: float = 0.02
    min_median_return: float = 0.0
    measurement_version: int = 2


@dataclass(frozen=True)
class ScanRules:
    """When a group is cut into pieces, and how wide a piece is: seconds of history, or units of a lot position."""

    max_rows: int = 2_000_000
    bucket_seconds: int = 3600
    bucket_units: int = 10_000_000


def rules_hash(rules) -> str:
    """SHA-256 of the canonical JSON of a settings object."""
    return hashlib.sha256(json.dumps(asdict(rules), sort_keys=True).encode()).hexdigest()
