"""First-in first-out matching without pairing rows.

Every unit ever bought by a (wallet, token) has a position: lots tile the line [0, bought). A sale consumes the interval
that starts at the oldest unit on hand. What a lot earned is then the difference of one cumulative function of position
("proceeds up to here") at the two ends of the lot, and what a sale cost is the same with "cost up to here". Both are
looked up by carrying the last marker forward along the position line, so rows are never multiplied.

Quantities are of any type ``functions.amounts`` knows: wide values hold every 256-bit amount and their sums. Money is a number;
what a part of a lot cost or earned is a DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.functions import amounts
from onledger.operators.scan import inventory, running, width_bucket
from onledger.params import ScanRules
from onledger.session import materialize

FLOW_KEYS = ["wallet", "token"]
FLOW_ORDER = ["ts", "tx", "log_index", "pool", "origin", "quantity", "quote", "gas", "side"]


def positions(flows: DataFrame, order: Sequence[str] = FLOW_ORDER, scan: ScanRules = ScanRules(),
              keys: Sequence[str] = FLOW_KEYS) -> DataFrame:
    """Stock columns for every flow (see ``scan.inventory``)."""
    return inventory(flows, keys, order, width_bucket("ts", scan.bucket_seconds), F.col("quantity"),
                     F.col("side") == "buy", scan.max_rows)


def unknown_basis(placed: DataFrame) -> DataFrame:
    """Sales above the known stock; they never count as a result and void the lots on hand."""
    return placed.filter((F.col("side") == "sell") & (F.col("short") > amounts.of_column(placed, "short").zero())).withColumn("reason", F.lit("unmatched_sell_basis"))


def _carry(markers: DataFrame, lookups: DataFrame, keys: Sequence[str], weight: str, scan: ScanRules) -> DataFrame:
    """For each lookup position: the last marker at or before it, and the running sum of ``weight`` up to it."""
    both = markers.unionByName(lookups, allowMissingColumns=True)
    bucket = amounts.of_column(both, "pos").bucket(F.col("pos"), scan.bucket_units)
    return running(
        both, keys, ["pos", "kind"], bucket, max_rows=scan.max_rows,
        sums={"cum": (F.coalesce(F.col(f"marker.{weight}"), F.lit(0).cast(both.schema["marker"].dataType[weight].dataType)), True)},
        lasts={"found": (F.col("marker"), True)},
    ).filter("marker IS NULL")


def fifo_lots(placed: DataFrame, scan: ScanRules = ScanRules(), keys: Sequence[str] = FLOW_KEYS) -> DataFrame:
    """One row per lot with ``state`` closed / open / dropped.

    closed: closing time, pnl, return percent, hold seconds. open: remaining quantity and cost, realised so far.
    """
    of = amounts.of_column(placed, "quantity")
    c, zero = F.col, of.zero()
    begin = of.minus(c("bought"), c("held_before"))
    sales = placed.filter((c("side") == "sell") & (c("short") == zero)).select(
        *keys,
        begin.alias("pos"),
        F.lit(1).alias("kind"),
        F.struct(
            begin.alias("start"),
            of.plus(begin, c("quantity")).alias("end"),
            c("quantity").alias("size"),
            (c("quote") - c("gas")).alias("proceeds"),
            c("ts").alias("ts"),
        ).alias("marker"),
    )
    start, end = of.minus(c("bought"), c("quantity")), c("bought")
    upto = F.least(end, F.greatest(start, c("head_final")))
    lots = placed.filter("side = 'buy'").select(
        *keys,
        start.alias("lot_start"), end.alias("lot_end"), upto.alias("used_end"),
        (c("quote") + c("gas")).alias("cost"), c("ts").alias("opened_at"), "entry_rank",
    )
    ends = F.array(
        F.struct(F.col("lot_start").alias("pos"), F.lit(2).alias("kind")),
        F.struct(F.col("used_end").alias("pos"), F.lit(0).alias("kind")),
    )
    lookups = lots.withColumn("e", F.explode(ends)).select("*", "e.pos", "e.kind").drop("e")
    hit = _carry(sales, lookups, keys, "proceeds", scan)

    covered = F.least(of.minus(c("pos"), c("found.start")), c("found.size"))
    proceeds = c("found.proceeds")
    hit = hit.withColumns({
        "whole": c("cum") - F.coalesce(proceeds, F.lit(0).cast(_kind(hit, "cum"))),
        "part": F.coalesce(proceeds.cast("double") * of.double(covered) / of.double(c("found.size")), F.lit(0.0)),
        "inside": c("found").isNotNull() & (c("pos") <= c("found.end")),
    })
    ident = [*keys, "lot_start", "lot_end", "used_end", "cost", "opened_at", "entry_rank"]
    lower, upper = F.col("kind") == 2, F.col("kind") == 0
    paired = hit.groupBy(*ident).agg(
        F.max(F.when(lower, F.col("whole"))).alias("whole_lo"), F.max(F.when(lower, F.col("part"))).alias("part_lo"),
        F.max(F.when(upper, F.col("whole"))).alias("whole_hi"), F.max(F.when(upper, F.col("part"))).alias("part_hi"),
        F.max(F.when(upper, F.col("inside"))).alias("ended"), F.max(F.when(upper, F.col("found.ts"))).alias("closed_at"),
    )
    got = (c("whole_hi") - c("whole_lo")).cast("double") + (c("part_hi") - c("part_lo"))
    size, left = of.minus(c("lot_end"), c("lot_start")), of.minus(c("lot_end"), c("used_end"))
    state = F.when(c("used_end") < c("lot_end"), "open").when(c("ended"), "closed").otherwise("dropped")
    out = paired.withColumns({"state": state, "got": got, "quantity": size, "remaining": left})
    out = out.withColumns({"_cost": c("cost").cast("double"), "_size": of.double(c("quantity")), "_left": of.double(c("remaining"))})
    closed, opened = c("state") == "closed", c("state") == "open"
    pnl = c("got") - c("_cost")
    return out.select(
        *keys, "state", "opened_at", "entry_rank", "quantity", "cost", "lot_start",
        F.when(closed, c("closed_at")).alias("closed_at"),
        F.when(closed, pnl).alias("pnl"),
        F.when(closed, F.when(c("cost") == 0, 0.0).otherwise(pnl / c("_cost") * 100)).alias("return_pct"),
        F.when(closed, c("closed_at") - c("opened_at")).alias("hold_seconds"),
        F.when(opened, c("remaining")).alias("remaining"),
        F.when(opened, c("_cost") * c("_left") / c("_size")).alias("remaining_cost"),
        F.when(opened, F.when(c("used_end") > c("lot_start"), c("got")).otherwise(0.0)
               - c("_cost") * of.double(of.minus(c("quantity"), c("remaining"))) / c("_size")).alias("realized"),
    )


def _kind(rows: DataFrame, column: str):
    return rows.schema[column].dataType


def audit_sales(placed: DataFrame, scan: ScanRules = ScanRules(), keys: Sequence[str] = FLOW_KEYS,
                carry_cols: Sequence[str] = ("tx", "ts", "log_index")) -> DataFrame:
    """Cost of each sale when some lots have no known cost (opening stock, transfers in).

    ``placed`` needs ``cost`` on buys (NULL = unknown) and ``proceeds`` on sales (NULL = transfer out, which consumes lots
    without a result). Surplus units and units of unknown cost make the result NULL.
    """
    of = amounts.of_column(placed, "quantity")
    c, zero = F.col, of.zero()
    money = placed.schema["cost"].dataType
    nothing = F.lit(0).cast(money)
    start = of.minus(c("bought"), c("quantity"))
    lots = placed.filter("side = 'buy'").select(
        *keys, start.alias("pos"), F.lit(1).alias("kind"),
        F.struct(start.alias("start"), c("quantity").alias("size"), F.coalesce(c("cost"), nothing).alias("cost"),
                 F.when(c("cost").isNull(), c("quantity")).otherwise(zero).alias("blind")).alias("marker"),
    )
    begin = of.minus(c("bought"), c("held_before"))
    sales = placed.filter("side = 'sell' AND proceeds IS NOT NULL").select(
        *keys, *carry_cols, c("quantity").alias("sold"), "proceeds", "short",
        begin.alias("sale_start"), of.plus(begin, c("taken")).alias("sale_end"))
    ends = F.array(F.struct(c("sale_start").alias("pos"), F.lit(2).alias("kind")),
                   F.struct(c("sale_end").alias("pos"), F.lit(0).alias("kind")))
    lookups = sales.withColumn("e", F.explode(ends)).select("*", "e.pos", "e.kind").drop("e")
    both = lots.unionByName(lookups, allowMissingColumns=True)
    hit = running(
        both, keys, ["pos", "kind", *carry_cols], of.bucket(c("pos"), scan.bucket_units), max_rows=scan.max_rows,
        sums={"cum_cost": (F.coalesce(c("marker.cost"), nothing), True),
              "cum_blind": (F.coalesce(c("marker.blind"), zero), True)},
        lasts={"found": (c("marker"), True)},
    ).filter("marker IS NULL")
    hit = hit.withColumn("covered", F.least(of.minus(c("pos"), c("found.start")), c("found.size")))
    beyond = F.when(F.coalesce(c("found.blind"), zero) > zero, of.minus(c("found.size"), c("covered"))).otherwise(zero)
    hit = hit.withColumns({
        "c_whole": c("cum_cost") - F.coalesce(c("found.cost"), F.lit(0).cast(_kind(hit, "cum_cost"))),
        "c_part": F.coalesce(c("found.cost").cast("double") * of.double(c("covered")) / of.double(c("found.size")), F.lit(0.0)),
        "u": of.minus(c("cum_blind"), beyond),
    })
    ident = [*keys, *carry_cols, "sold", "proceeds", "short", "sale_start", "sale_end"]
    lower, upper = c("kind") == 2, c("kind") == 0
    paired = hit.groupBy(*ident).agg(
        *[F.max(F.when(side, c(n))).alias(f"{n}_{tag}") for n in ("c_whole", "c_part", "u")
          for side, tag in ((lower, "lo"), (upper, "hi"))])
    used = c("sale_end") > c("sale_start")
    unknown = of.plus(c("short"), F.when(used, of.minus(c("u_hi"), c("u_lo"))).otherwise(zero))
    cost = F.when(used, (c("c_whole_hi") - c("c_whole_lo")).cast("double") + (c("c_part_hi") - c("c_part_lo"))).otherwise(0.0)
    out = paired.withColumns({"unknown_quantity": unknown, "_cost": cost})
    known = c("unknown_quantity") == zero
    return out.select(
        *keys, *carry_cols, "sold", "proceeds", "unknown_quantity",
        F.when(known, c("_cost")).alias("cost"),
        F.when(known, c("proceeds").cast("double") - c("_cost")).alias("pnl"),
    )


def entry_ranks(flows: DataFrame, scan: ScanRules = ScanRules(), order: Sequence[str] = FLOW_ORDER) -> DataFrame:
    """Adds ``entry_rank``: distinct wallets that bought the token before this row, plus one.

    A wallet counts from its first buy on, so the distinct count is a running count of first buys. ``flows`` are read several
    times, so costly ones should be written down.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("wallet", "token").orderBy(*order)
    firsts = (flows.filter("side = 'buy'").withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
              .select("token", *[c for c in order], "wallet").withColumn("_mark", F.lit(1).cast("bigint")))
    firsts = materialize(firsts, "first-buys")  # the scan reads its input for counts, summaries and rows
    marked = flows.withColumn("_mark", F.lit(0).cast("bigint")).unionByName(firsts, allowMissingColumns=True)
    ranked = running(marked, ["token"], [*order, "wallet", "_mark"], width_bucket("ts", scan.bucket_seconds),
                     max_rows=scan.max_rows, sums={"_seen": (F.col("_mark"), False)})
    return ranked.filter("_mark = 0").withColumn("entry_rank", F.col("_seen") + 1).drop("_mark", "_seen")
