"""FIFO results and wallet profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onledger.functions import amounts
from onledger.functions.guards import clamp
from onledger.operators import lots
from onledger.operators.aggregates import exact_median
from onledger.params import ScanRules, WalletRules
from onledger.session import materialize


def fifo(flows: DataFrame, scan: ScanRules = ScanRules(), narrow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lots, sales of unknown basis) of a table of wallet cash flows.

    Quantities are exact whatever their size: DECIMAL(38,0) for tokens whose amounts add up to less than 10**37, wide values for the
    others (see ``amounts.by_width``). They are returned as wide values, with ``narrow`` as they were computed. Each scan reads its input twice (rows and bucket summaries), so stages are written once
    instead of recomputed.
    """
    flows = materialize(flows.select("wallet", "token", *lots.FLOW_ORDER), "flows")

    def matched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        ranked = materialize(lots.entry_ranks(rows, scan), "ranked-flows")
        placed = materialize(lots.positions(ranked, scan=scan), "placed-flows")
        return lots.fifo_lots(placed, scan), lots.unknown_basis(placed)

    all_lots, unknown = amounts.by_width(flows, "token", matched)
    return (all_lots, unknown) if narrow else (amounts.widened(all_lots), amounts.widened(unknown))


def fifo_outcomes(all_lots: DataFrame) -> DataFrame:
    return all_lots.filter("state = 'closed'").select(
        "wallet", "token", "opened_at", "closed_at", "pnl", "return_pct", "hold_seconds", "entry_rank", "quantity")


def open_lots(all_lots: DataFrame) -> DataFrame:
    return all_lots.filter("state = 'open'").select(
        "wallet", "token", "opened_at", "quantity", "remaining", "remaining_cost", "realized", "entry_rank")


def wallet_profile(flows: DataFrame, all_lots: DataFrame, unknown: DataFrame,
                   rules: WalletRules = WalletRules()) -> DataFrame:
    """One row per observed wallet; the score shrinks small samples toward neutral."""
    all_lots = materialize(all_lots, "lots")
    closed = all_lots.filter("state = 'closed'")
    by = ["wallet"]
    results = closed.groupBy(*by).agg(
        F.count("*").alias("closed_lots"), F.count_if(F.col("pnl") > 0).alias("wins"),
        F.countDistinct("token").alias("closed_tokens"), F.sum("hold_seconds").alias("hold_sum"),
        F.sum("pnl").alias("realized_pnl"))
    medians = exact_median(closed, by, "return_pct", "median_return_pct")
    rank_medians = exact_median(closed, by, "entry_rank", "median_entry_rank")
    opened = all_lots.filter("state = 'open'").groupBy(*by).agg(F.count("*").alias("open_lots"))
    unclear = unknown.groupBy(*by).agg(F.count("*").alias("unknown_basis"))
    seen = flows.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("side") == "buy", F.col("token"))).alias("tokens_entered"))
    out = seen
    for part in (results, medians, rank_medians, opened, unclear):
        out = out.join(part, by, "left")
    out = out.fillna(0, ["closed_lots", "wins", "closed_tokens", "open_lots", "unknown_basis"])
    lift = F.coalesce(clamp(F.col("median_return_pct") / 2, -15.0, 15.0), F.lit(0.0))
    raw = (100 * (F.col("wins") + 2) / (F.col("closed_lots") + 4) + lift
           - F.least(F.lit(20), F.col("unknown_basis") * 2))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)
    out = out.withColumn("score", score)
    eligible = ((F.col("closed_lots") >= rules.min_closed) & (F.col("closed_tokens") >= rules.min_tokens)
                & (F.col("score") >= rules.min_score) & F.coalesce(F.col("median_return_pct") > 0, F.lit(False))
                & (F.col("unknown_basis") == 0))
    return out.select(
        "wallet", "tokens_entered", "closed_lots", "closed_tokens", "wins",
        (F.col("closed_lots") - F.col("wins")).alias("losses"), "median_return_pct", "median_entry_rank",
        F.when(F.col("closed_lots") > 0, F.col("hold_sum") / F.col("closed_lots")).alias("mean_hold_seconds"),
        F.coalesce("realized_pnl", F.lit(0.0)).alias("realized_pnl"), "open_lots", "unknown_basis", "score",
        eligible.alias("eligible"))
