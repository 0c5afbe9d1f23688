"""Bound inputs: the supplied tables seen as on-chain trading tables.

Each view is one SQL text that both Spark and DuckDB run, so a query and its check start from the same rows. Four macros
hide the dialect: ``EPOCH(ts)`` whole seconds since 1970, ``IDIV(a, b)`` integer quotient, ``TEXT(x)`` cast to text,
``ATOMIC(x)`` x times 10**18 in a type of 38 digits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from onledger.session import tune

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # one row per swap; full rows are unique, (tx, log_index) is not
    "swaps": """
      SELECT l.l_orderkey AS tx, CAST(l.l_linenumber AS BIGINT) AS log_index, l.l_partkey AS pool, p.p_brand AS token,
        l.l_suppkey AS wallet, o.o_custkey AS origin,
        CASE WHEN l.l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
        CAST(round(l.l_quantity) AS BIGINT) AS token_amount,
        CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT) AS quote_amount,
        CAST(round(l.l_extendedprice * l.l_tax) AS BIGINT) AS gas,
        EPOCH(l.l_shipdate) AS ts, IDIV(EPOCH(l.l_shipdate) - 788918400, 86400) AS block
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    # the same rows without the token lookup, for jobs that need no token
    "swap_keys": """
      SELECT l_orderkey AS tx, CAST(l_linenumber AS BIGINT) AS log_index, l_partkey AS pool, l_suppkey AS wallet,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
        CAST(round(l_quantity) AS BIGINT) AS token_amount,
        CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS quote_amount,
        EPOCH(l_shipdate) AS ts, IDIV(EPOCH(l_shipdate) - 788918400, 86400) AS block, l_linestatus AS line_status
      FROM lineitem""",
    # one signed wallet cash flow per swap
    "flows": """
      SELECT tx, log_index, pool, wallet, origin, token, ts, block, side, token_amount AS quantity,
        quote_amount AS quote, gas FROM swaps""",
    # the same in atomic units of a token with 18 decimals, beyond 64 bits
    "atomic_flows": """
      SELECT tx, log_index, pool, wallet, origin, token, ts, block, side, ATOMIC(token_amount) AS quantity,
        quote_amount AS quote, gas FROM swaps""",
    "transfers": """
      SELECT l.l_orderkey AS tx, CAST(l.l_linenumber AS BIGINT) AS log_index, p.p_brand AS token,
        CASE WHEN l.l_linenumber = 1 THEN '0x0' ELSE TEXT(l.l_suppkey) END AS sender,
        TEXT(o.o_custkey) AS recipient, CAST(round(l.l_quantity) AS BIGINT) AS amount, EPOCH(l.l_shipdate) AS ts
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "atomic_transfers": "SELECT tx, log_index, token, sender, recipient, ATOMIC(amount) AS amount, ts FROM transfers",
    # one row per order: transaction header
    "txs": """
      SELECT o_orderkey AS tx, o_custkey AS origin, o_orderstatus AS status_code, o_orderpriority AS priority,
        EPOCH(o_orderdate) AS ts, IDIV(EPOCH(o_orderdate) - 788918400, 86400) AS block,
        CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders""",
    # a price path per token
    "quotes": """
      SELECT event_id AS quote_id, event_type AS token, EPOCH(ts) AS ts,
        CAST(round(value * 100) AS BIGINT) AS cents, user_id FROM events""",
    # hourly candles
    "candles": """
      SELECT IDIV(EPOCH(ts), 3600) * 3600 AS start, CAST(count(*) AS BIGINT) AS n,
        min_by(CAST(round(value * 100) AS BIGINT), event_id) AS open_cents,
        max(CAST(round(value * 100) AS BIGINT)) AS high_cents, min(CAST(round(value * 100) AS BIGINT)) AS low_cents,
        max_by(CAST(round(value * 100) AS BIGINT), event_id) AS close_cents
      FROM events GROUP BY IDIV(EPOCH(ts), 3600) * 3600""",
    # follower samples, one per order
    "samples": """
      SELECT o_orderkey AS tx, o_custkey AS wallet, o_orderkey % 25 AS token, EPOCH(o_orderdate) AS leader_ts,
        EPOCH(o_orderdate) + 1000 AS queued_at,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'incomplete' ELSE 'queued' END AS status,
        CASE WHEN o_orderstatus <> 'O' THEN EPOCH(o_orderdate) + 930 END AS ended_at,
        CASE WHEN o_orderstatus <> 'O' THEN EPOCH(o_orderdate) + 2000 + (o_orderkey % 7) * 86400 END AS completed_at,
        CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) % 1500 - 500 END AS return_bp,
        CASE WHEN o_orderstatus = 'P' THEN -10000 END AS stress_bp,
        CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 2 END AS version FROM orders""",
    # one assessment per order; NULLs stand for values nobody observed
    "assessments": """
      SELECT o.o_orderkey AS id, o.o_custkey AS token, o.o_orderkey % 200 AS pool, EPOCH(o.o_orderdate) AS ts,
        CASE WHEN o.o_orderkey % 7 <> 1 THEN o.o_totalprice / 4 END AS liquidity,
        CASE WHEN o.o_orderkey % 7 <> 2 THEN (o.o_orderkey % 100) / 100.0E0 END AS top10_share,
        CASE WHEN o.o_orderkey % 7 <> 3 THEN o.o_totalprice / 1000 END AS price,
        CASE WHEN o.o_orderkey % 7 <> 4 THEN EPOCH(o.o_orderdate) - (o.o_orderkey % 140) END AS observed_at,
        CASE WHEN o.o_orderkey % 7 <> 5 THEN EPOCH(o.o_orderdate) - (o.o_orderkey % 130) END AS risk_checked_at,
        CASE WHEN o.o_orderkey % 7 <> 6 THEN (o.o_orderkey * 13) % 90000 END AS launch_age,
        CASE WHEN o.o_orderkey % 9 < 7 THEN o.o_orderkey % 6 END AS distinct_buyers,
        CASE WHEN o.o_orderkey % 9 < 6 THEN o.o_orderkey % 3 END AS qualified_buys,
        o.o_orderpriority AS priority, o.o_orderstatus AS status_code,
        o.o_orderkey % 10 <> 0 AS deployment_confirmed
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    # one observation of a token for the generic screen
    "snapshots": """
      SELECT o_orderkey AS id, o_custkey AS token, EPOCH(o_orderdate) AS now,
        CASE WHEN o_orderkey % 9 <> 0 THEN 'solana' ELSE 'other' END AS chain,
        CASE WHEN o_orderkey % 8 <> 1 THEN o_orderkey % 8 <> 2 END AS standard_token,
        o_orderkey % 13 <> 3 AS mint_known, CASE WHEN o_orderkey % 12 = 5 THEN 'key' END AS mint_authority,
        o_orderkey % 14 <> 3 AS freeze_known, CASE WHEN o_orderkey % 15 = 5 THEN 'key' END AS freeze_authority,
        CASE WHEN o_orderkey % 17 <> 3 THEN o_totalprice / 1000 END AS price,
        CASE WHEN o_orderkey % 19 <> 3 THEN EPOCH(o_orderdate) - (o_orderkey % 150) + 20 END AS observed_at,
        CASE WHEN o_orderkey % 21 <> 3 THEN o_totalprice / 4 END AS liquidity,
        CASE WHEN o_orderkey % 22 <> 3 THEN o_totalprice / 10 END AS volume_h24,
        CASE WHEN o_orderkey % 23 <> 3 THEN (o_orderkey * 37) % 90000 END AS age_seconds,
        CASE WHEN o_orderkey % 24 <> 3 THEN (o_orderkey % 100) / 100.0E0 END AS top10_share,
        CASE WHEN o_orderkey % 25 <> 3 THEN o_orderkey % 40 END AS buys_m5,
        CASE WHEN o_orderkey % 26 <> 3 THEN (o_orderkey * 3) % 30 END AS sells_m5,
        CASE WHEN o_orderkey % 27 <> 3 THEN o_orderkey % 60 - 20 END AS change_m5 FROM orders""",
    # one exchange ticker with its candle summary
    "tickers": """
      SELECT o_orderkey AS id, EPOCH(o_orderdate) AS now,
        CASE o_orderkey % 4 WHEN 0 THEN 'BTC-USD' WHEN 1 THEN 'ETH-USD' WHEN 2 THEN 'SOL-USD' ELSE 'DOGE-USD' END AS token,
        CASE WHEN o_orderkey % 10 <> 0 THEN 'coinbase' ELSE 'other' END AS venue, o_totalprice / 1000 AS price,
        EPOCH(o_orderdate) - (o_orderkey % 150) + 20 AS observed_at,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 30 END AS spread_bps,
        CASE WHEN o_orderkey % 12 <> 0 THEN o_totalprice / 10 END AS volume_h24,
        CASE WHEN o_orderkey % 13 <> 0 THEN EPOCH(o_orderdate) - (o_orderkey % 160) END AS candle_end,
        CASE WHEN o_orderkey % 14 <> 0 THEN o_totalprice END AS sma_fast,
        CASE WHEN o_orderkey % 15 <> 0 THEN o_totalprice * (0.999E0 + (o_orderkey % 5) * 0.0005E0) END AS sma_slow,
        CASE WHEN o_orderkey % 16 <> 0 THEN (o_orderkey % 20) / 19.0E0 END AS rising_fraction FROM orders""",
    "creators": """
      SELECT token, min(wallet) AS deployer, max(origin) AS initiator FROM swaps GROUP BY token""",
    # flat evidence collected for one assessment per order
    "observed": """
      SELECT id, ts, CASE WHEN id % 97 = 0 THEN 'bad' ELSE token END AS token, pool, block, observed_at, launch_age,
        deployment_confirmed, CASE WHEN id % 5 <> 0 THEN 2 + id % 3 END AS pool_version,
        CASE WHEN m THEN price END AS price, CASE WHEN m THEN liquidity END AS liquidity, m AS market_present,
        CASE WHEN m AND id % 31 <> 0 THEN CASE id % 3 WHEN 0 THEN 'v2_reserves' WHEN 1 THEN 'v3_slot0_and_pool_balances'
          ELSE 'v4_reserves_lens_core_tvl' END END AS market_source,
        CASE WHEN m AND id % 13 <> 0 THEN ts - id % 150 END AS market_at, CASE WHEN m THEN block END AS market_block,
        CASE WHEN m AND id % 101 = 0 THEN '0xzz' WHEN m THEN '0x' || lpad(TEXT(block), 64, '0') END AS market_hash,
        CASE WHEN m AND id % 3 = 0 THEN CASE WHEN id % 12 = 0 THEN '0' WHEN id % 43 = 0 THEN 'abc' ELSE TEXT(id * 1000) END END
          AS lp_supply,
        CASE WHEN m AND id % 3 = 0 THEN CASE WHEN id % 2 = 1 THEN 0.97E0 ELSE (id % 100) / 100.0E0 END END AS lp_burned,
        q AS quote_present, CASE WHEN q THEN CASE WHEN id % 6 <> 0 THEN 'quoted' ELSE 'unavailable' END END AS quote_status,
        CASE WHEN q AND id % 6 <> 0 THEN (id % 1000) / 10.0E0 END AS quote_quantity,
        CASE WHEN q AND id % 6 <> 0 THEN 1.995E0 END AS quote_usd_in,
        CASE WHEN q AND id % 6 <> 0 THEN 1.995E0 * (100 - id % 20) / 100 END AS quote_usd_out,
        CASE WHEN q THEN 'canonical_pool_quote' END AS quote_source, CASE WHEN q THEN block END AS quote_block,
        CASE WHEN q AND id % 6 = 0 THEN 'Pool has no reserves' END AS quote_error,
        CASE WHEN id % 8 = 0 THEN 'failed' WHEN id % 8 <> 1 THEN 'passed' END AS sim_status,
        CASE WHEN id % 8 <> 1 THEN 'eth_call' END AS sim_source, CASE WHEN id % 8 <> 1 AND id % 9 <> 0 THEN ts - id % 140 END AS sim_at,
        CASE WHEN id % 8 <> 1 THEN CASE WHEN id % 23 = 0 THEN block + 1 ELSE block END END AS sim_block,
        CASE WHEN id % 8 = 0 THEN 'reverted' END AS sim_error, CASE WHEN id % 8 > 1 THEN (id % 5) / 100.0E0 END AS buy_shortfall,
        CASE WHEN id % 8 > 1 THEN (id % 4) / 100.0E0 END AS sell_shortfall,
        CASE WHEN id % 8 > 1 THEN (id % 14) / 100.0E0 END AS roundtrip_loss,
        CASE WHEN id % 7 <> 2 THEN (id % 103) / 100.0E0 END AS top10_share,
        CASE WHEN id % 7 <> 2 AND id % 37 <> 0 THEN 'verified_transfer_ledger' END AS holder_source,
        CASE WHEN id % 7 <> 2 THEN ts - id % 125 END AS holder_at,
        CASE WHEN id % 7 <> 2 THEN CASE WHEN id % 47 = 0 THEN block + 2 ELSE block END END AS holder_block,
        b AS buyers_present, CASE WHEN b THEN id % 6 END AS distinct_buyers, CASE WHEN b THEN id % 3 END AS qualified_buys,
        CASE WHEN b THEN id % 7 + (id % 9) % 3 + CASE WHEN id % 59 = 0 THEN 1 ELSE 0 END END AS buyer_total,
        CASE WHEN b THEN id % 7 END AS buyer_reviewed, CASE WHEN b THEN (id % 9) % 3 END AS buyer_pending,
        CASE WHEN b THEN CASE WHEN id % 7 > 0 THEN id % 2 ELSE 0 END END AS buyer_ambiguous,
        CASE WHEN b AND id % 10 <> 0 THEN ts - id % 122 END AS buyer_at, CASE WHEN b THEN block END AS buyer_block,
        CASE id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'verified' END AS source_status,
        CASE WHEN id % 4 <> 3 THEN 'explorer' END AS source_provider,
        CASE WHEN id % 4 <> 3 THEN ts - (id * 7) % 4000 END AS source_at, ts - id % 128 AS risk_checked_at, FLAGS
      FROM (SELECT o_orderkey AS id, EPOCH(o_orderdate) AS ts, '0x' || lpad(TEXT(o_custkey), 40, '0') AS token,
          '0x' || lpad(TEXT(o_orderkey % 200), 40, '0') AS pool, IDIV(EPOCH(o_orderdate) - 788918400, 86400) AS block,
          CASE WHEN o_orderkey % 83 = 0 THEN -1.0E0 WHEN o_orderkey % 7 <> 3 THEN o_totalprice / 1000 END AS price,
          CASE WHEN o_orderkey % 7 <> 1 THEN o_totalprice / 4 END AS liquidity,
          CASE WHEN o_orderkey % 17 <> 0 THEN EPOCH(o_orderdate) - o_orderkey % 150 END AS observed_at,
          (o_orderkey * 13) % 90000 AS launch_age, o_orderkey % 10 <> 0 AS deployment_confirmed,
          o_orderkey % 41 <> 0 AS m, o_orderkey % 29 <> 0 AS q, o_orderkey % 11 <> 0 AS b FROM orders) x""",
}

# --- fixed values: provider risk flags, administrative controls from the fourth on ------------------------------------
RISK_FLAGS = ("is_honeypot", "cannot_buy", "cannot_sell_all", "is_mintable", "is_proxy", "is_blacklisted", "is_whitelisted",
              "transfer_pausable", "slippage_modifiable", "personal_slippage_modifiable", "hidden_owner",
              "owner_change_balance", "can_take_back_ownership", "selfdestruct")

VIEWS["observed"] = VIEWS["observed"].replace("FLAGS", ", ".join(
    f"CASE WHEN id % 3 = 0 THEN 'pass' ELSE CASE (id + {3 * k}) % 40 WHEN 0 THEN 'fail' WHEN 1 THEN NULL ELSE 'pass' END END"
    f" AS {flag}" for k, flag in enumerate(RISK_FLAGS)))

_MACRO = re.compile(r"\b(EPOCH|IDIV|TEXT|ATOMIC)\(")


def _expand(text: str, spark: bool) -> str:
    """Replace the dialect macros; arguments may nest."""
    while (hit := _MACRO.search(text)) is not None:
        depth, i, args, begin = 1, hit.end(), [], hit.end()
        while depth:
            ch = text[i]
            depth += (ch == "(") - (ch == ")")
            if (ch == "," and depth == 1) or depth == 0:
                args.append(text[begin:i])
                begin = i + 1
            i += 1
        name = hit.group(1)
        if name == "EPOCH":
            new = f"unix_seconds(CAST({args[0]} AS TIMESTAMP))" if spark else f"CAST(floor(epoch({args[0]})) AS BIGINT)"
        elif name == "IDIV":
            new = f"(({args[0]}) div ({args[1]}))" if spark else f"(({args[0]}) // ({args[1]}))"
        elif name == "ATOMIC":
            new = (f"CAST(CAST({args[0]} AS DECIMAL(19,0)) * 1000000000000000000 AS DECIMAL(38,0))" if spark
                   else f"(CAST({args[0]} AS HUGEINT) * 1000000000000000000)")
        else:
            new = f"CAST({args[0]} AS STRING)" if spark else f"CAST({args[0]} AS VARCHAR)"
        text = text[:hit.start()] + new + text[i:]
    return text


def _uses(text: str) -> list[str]:
    return [v for v in (*VIEWS, *BASE) if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text)]


def duck(body: str) -> str:
    """A DuckDB statement: ``body`` with the bound views it needs placed in front as CTEs."""
    body = _expand(body.strip(), spark=False)
    order: list[str] = []

    def need(text: str) -> None:
        for view in _uses(text):
            if view in VIEWS and view not in order:
                need(VIEWS[view])
                order.append(view)

    need(body)
    start = re.match(r"WITH(\s+RECURSIVE)?\s", body, re.IGNORECASE)
    recursive = bool(start and start.group(1))
    own = body[start.end():] if start else None
    ctes = [f"{v} AS ({_expand(VIEWS[v], spark=False)})" for v in order]
    if not ctes:
        return body
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    return head + (",\n" + own if own is not None else "\n" + body)


class Tables:
    """Base tables and bound views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: bool = False):
        self.spark = tune(spark)
        self.dir = sf_dir.rstrip("/")
        self._spread = spread
        self._cache: dict[str, DataFrame] = {}

    def spread(self) -> Tables:
        """The same tables for jobs that are heavy per row: a table that arrives in fewer pieces than there are cores is
        redistributed first. Large tables already come in many splits and are left alone."""
        return Tables(self.spark, self.dir, spread=True)

    def _base(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path(name))
        cores = self.spark.sparkContext.defaultParallelism
        if self._spread and rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(cores)
        return rows

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self._base(name)
            elif name in VIEWS:
                self._cache[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._cache[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL over base tables, bound views and the given frames."""
        text = _expand(text, spark=True)
        used = {v: getattr(self, v) for v in _uses(text) if v not in frames}
        used.update(frames)
        for name in used:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", text)
        return self.spark.sql(text, **used)
