"""Row-relative operators over series and groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onledger.operators.scan import running, width_bucket
from onledger.params import ScanRules
from onledger.session import materialize


def candle_trend(candles: DataFrame, keys: Sequence[str], width: int, fast: int = 5, slow: int = 20,
                 block: int = 4096) -> DataFrame:
    """Moving averages and the share of rising closes over the last ``slow`` candles, NULL unless those are gap-free.

    The series is cut into blocks of candles; the last ``slow - 1`` slots of a block are also given to the next one, so a
    fixed look-back never needs a whole series in one task.
    """
    if block < slow:
        raise ValueError("a block must hold at least one look-back")
    span = width * block
    own = F.floor(F.col("start") / span).cast("bigint")
    tail = F.col("start") >= (own + 1) * span - (slow - 1) * width
    rows = candles.withColumn("_own", own).withColumn(
        "_blk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_blk").orderBy("start")
    last_fast, last_slow = w.rowsBetween(-(fast - 1), 0), w.rowsBetween(-(slow - 1), 0)
    rows = rows.withColumn("_up", F.when(F.col("close_cents") > F.lag("close_cents").over(w), 1).otherwise(0))
    whole = (F.count("*").over(last_slow) == slow) & (
        F.col("start") - F.min("start").over(last_slow) == (slow - 1) * width) & (
        F.min("close_cents").over(last_slow) > 0)
    # a rise is counted between neighbours inside the window only
    rises = F.sum("_up").over(w.rowsBetween(-(slow - 2), 0))
    out = rows.withColumns({
        "sma_fast": F.when(whole, F.sum("close_cents").over(last_fast) / float(fast)),
        "sma_slow": F.when(whole, F.sum("close_cents").over(last_slow) / float(slow)),
        "rising_fraction": F.when(whole, rises / float(slow - 1)),
        "candle_end": F.when(whole, F.col("start") + width),
    })
    return out.filter("_blk = _own").drop("_own", "_blk", "_up")


def previous_of_kind(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, is_kind, name: str,
                     scan: ScanRules = ScanRules()) -> DataFrame:
    """Time of the latest earlier row of a kind."""
    return running(rows, keys, order, width_bucket(at, scan.bucket_seconds), max_rows=scan.max_rows,
                   lasts={name: (F.when(is_kind, F.col(at)), False)})


def first_touch(path: DataFrame, keys: Sequence[str], trigger, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Earliest row of each path that triggers; ``trigger`` is a column holding the reason or NULL."""
    hit = path.withColumn("trigger", trigger).filter(F.col("trigger").isNotNull())
    return hit.groupBy(*keys).agg(
        F.min_by(F.struct("trigger", *payload), F.struct(*order)).alias("_h")).select(*keys, "_h.*")


def schedule_gaps(cases: DataFrame, observed: DataFrame, keys: Sequence[str], first: str, last: str, step: int) -> DataFrame:
    """Expected steps of every case against what was observed: how many are missing, and the first missing one.

    ``observed`` holds (keys, step_at). The schedule is fixed by the rules, so a case expands to a known few rows.
    """
    due = cases.select(*keys, F.explode(F.sequence(F.col(first), F.col(last), F.lit(step).cast("bigint"))).alias("step_at"))
    seen = observed.select(*keys, "step_at").distinct().withColumn("_seen", F.lit(True))
    joined = due.join(seen, [*keys, "step_at"], "left")
    missing = F.col("_seen").isNull()
    return joined.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.count_if(missing).alias("missing"),
        F.min(F.when(missing, F.col("step_at"))).alias("first_gap")).withColumn("has_gaps", F.col("missing") > 0)


def greedy_pairs(rows: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """Accept a row if neither its ``left`` nor its ``right`` value was accepted before, in ``order``.

    That is the first maximal matching in row order. Repeats of a (left, right) pair change nothing, so only the first of
    each is kept. Then rounds: a pair that comes first for both its ends is certainly accepted; everything sharing an end
    with it is out. Each round is two aggregations and two joins, whatever the size of a group.
    """
    place = F.struct(*order)
    pairs = rows.groupBy(*group, left, right).agg(F.min(place).alias("_at"))
    open_pairs, accepted = materialize(pairs, "pairs"), None
    while True:
        by_left = open_pairs.groupBy(*group, left).agg(F.min("_at").alias("_l"))
        by_right = open_pairs.groupBy(*group, right).agg(F.min("_at").alias("_r"))
        won = (open_pairs.join(by_left, [*group, left]).join(by_right, [*group, right])
               .filter("_at = _l AND _at = _r").select(*group, left, right, "_at"))
        won = materialize(won, "pairs-won")
        accepted = won if accepted is None else accepted.unionByName(won)
        rest = (open_pairs.join(won.select(*group, left), [*group, left], "left_anti")
                .join(won.select(*group, right), [*group, right], "left_anti"))
        open_pairs = materialize(rest, "pairs-open")
        if open_pairs.isEmpty():
            break
    return accepted.select(*group, left, right, "_at.*")
