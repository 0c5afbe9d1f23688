"""Keyed state that built-in operators cannot express: FIFO lots and refresh requests."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from onledger.params import REFRESH_COOLDOWN_SECONDS, REFRESH_MAX_ATTEMPTS, REFRESH_RUNNING_TIMEOUT_SECONDS

# the processors travel to the workers by value, so no worker has to have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

L, S, D = T.LongType(), T.StringType(), T.DoubleType()
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"

EVENT = T.StructType([T.StructField(n, t) for n, t in (
    ("ts", L), ("tx", L), ("log_index", L), ("pool", L), ("origin", L), ("quantity", L), ("quote", L), ("gas", L), ("side", S))])
LOT = T.StructType([T.StructField(n, t) for n, t in (("size", L), ("left", L), ("cost", L), ("opened_at", L), ("gained", D))])
OUTCOME = T.StructType([T.StructField(n, t) for n, t in (
    ("wallet", L), ("token", S), ("opened_at", L), ("closed_at", L), ("quantity", L), ("pnl", D), ("kind", S))])
ORDER = [f.name for f in EVENT.fields]
HOLDER = ["wallet", "token"]
HELD = T.StructType([OUTCOME["wallet"], OUTCOME["token"], *LOT.fields])
PIECE = T.StructType([T.StructField("rows", T.BinaryType())])
PIECE_ROWS = 10_000
# fixed for the life of a checkpoint; a shard is read at once, so 10**9 waiting events are half a million in a task
SHARDS = 2048


_DTYPES = {L: "int64", S: object, D: "float64"}


def frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as a pandas frame with the column types of the schema."""
    columns = zip(*rows)
    return pd.DataFrame({f.name: pd.Series(list(values), dtype=_DTYPES[f.dataType]) for f, values in zip(schema.fields, columns)})


def pack(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one compressed state value."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    return [pack(rows.iloc[at:at + PIECE_ROWS]) for at in range(0, len(rows), PIECE_ROWS)]


def unpacked(state) -> pd.DataFrame | None:
    """All rows of a list of packed values; None if there is none."""
    if not state.exists():
        return None
    return pa.concat_tables([pa.ipc.open_stream(bytes(v[0])).read_all() for v in state.get()]).to_pandas()


class FifoLots(StatefulProcessor):
    """Open lots of all (wallet, token) of one shard. Events wait until the watermark passes them, then apply in chain order.

    A call of the state store costs as much for one row as for thousands, so a shard keeps its waiting events and its open lots in
    packed pieces: the calls grow with rows / PIECE_ROWS, not with the number of wallets.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PIECE)
        self.lots = handle.getListState("lots", PIECE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = None
        for chunk in rows:
            self.waiting.appendList(packed(chunk[HOLDER + ORDER]))
            first = int(chunk["ts"].min())
            due = first if due is None else min(due, first)
        if due is not None:
            self.handle.registerTimer((due + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() // 1000
        events = unpacked(self.waiting)
        if events is None or events["ts"].min() > limit:
            return iter(())
        late = events["ts"] > limit
        ready, later = events[~late].sort_values(HOLDER + ORDER), events[late]
        held = unpacked(self.lots)
        lots = {} if held is None else open_lots(held)
        out = settle(lots, ready)
        left = [(*holder, *lot) for holder, rest in lots.items() for lot in rest]
        self.waiting.put(packed(later)) if len(later) else self.waiting.clear()
        self.lots.put(packed(frame(left, HELD))) if left else self.lots.clear()
        if len(later):
            self.handle.registerTimer((int(later["ts"].min()) + 1) * 1000)
        return iter([frame(out, OUTCOME)] if out else ())

    def close(self) -> None:
        pass


def columns_of(rows: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*[rows[n].tolist() for n in names])


def open_lots(held: pd.DataFrame) -> dict[tuple, list]:
    """Open lots by holder, oldest first, as they were kept."""
    lots = {}
    for wallet, token, *lot in columns_of(held, HELD.names):
        lots.setdefault((wallet, token), []).append(lot)
    return lots


def settle(lots: dict[tuple, list], ready: pd.DataFrame) -> list[tuple]:
    """Apply events in order to the open lots of their holders; returns what was settled."""
    out = []
    for wallet, token, *event in columns_of(ready, HOLDER + ORDER):
        rest, done = step(lots.get((wallet, token), []), event)
        if rest:
            lots[wallet, token] = rest
        else:
            lots.pop((wallet, token), None)
        out += [(wallet, token, *d) for d in done]
    return out


def step(lots: list, event: Sequence) -> tuple[list, list]:
    """Apply one event to the open lots [size, left, cost, opened_at, gained], in place; returns the lots and what was settled.
    Only lots that a sale uses are looked at."""
    ts, _, _, _, _, quantity, quote, gas, side = event
    if side == "buy":
        lots.append([quantity, quantity, quote + gas, ts, 0.0])
        return lots, []
    have = n = 0
    while have < quantity and n < len(lots):
        have += lots[n][1]
        n += 1
    if have < quantity:
        return [], [(ts, ts, quantity, None, "unknown_basis")]
    unit, need, closed = (quote - gas) / quantity, quantity, []
    for lot in lots[:n]:
        used = min(need, lot[1])
        lot[1] -= used
        lot[4] += used * unit
        need -= used
        if not lot[1]:
            closed.append((lot[3], ts, lot[0], lot[4] - lot[2], "closed"))
    del lots[:len(closed)]
    return lots, closed


def stream_fifo(flows: DataFrame, event_time: str, delay: str) -> DataFrame:
    """flows: wallet, token, the columns of EVENT and an event-time timestamp."""
    shard = F.pmod(F.xxhash64(*HOLDER), F.lit(SHARDS).cast("bigint")).alias("shard")
    rows = flows.withWatermark(event_time, delay).select(shard, *HOLDER, *ORDER, event_time)
    return rows.groupBy("shard").transformWithStateInPandas(FifoLots(), OUTCOME, "append", "eventTime")


REQUEST = T.StructType([T.StructField(n, t) for n, t in (("token", L), ("action", S), ("requested_at", L), ("attempt", L))])


class RefreshRequests(StatefulProcessor):
    """Requests of one (token, action): one open at a time, a cooldown between attempts, a fixed number of attempts.

    An open request that got no answer within the running time counts as unavailable, so the next finding may ask again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("request", T.StructType([T.StructField("attempts", L), T.StructField("at", L)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, last = self.state.get() if self.state.exists() else (0, None)
        wait = max(REFRESH_COOLDOWN_SECONDS, REFRESH_RUNNING_TIMEOUT_SECONDS)
        times = pd.concat([chunk["ts"] for chunk in rows]).sort_values().to_numpy()
        out = []
        for ts in times:
            if attempts >= REFRESH_MAX_ATTEMPTS:
                break
            if last is None or ts - last >= wait:
                attempts, last = attempts + 1, int(ts)
                out.append((key[0], key[1], last, attempts))
        if last is not None:
            self.state.update((attempts, last))
        return iter([frame(out, REQUEST)] if out else ())

    def close(self) -> None:
        pass


def stream_requests(findings: DataFrame) -> DataFrame:
    """findings: token, action, ts (seconds). The batch size bounds what one key brings at a time."""
    return findings.groupBy("token", "action").transformWithStateInPandas(RefreshRequests(), REQUEST, "append", "none")
