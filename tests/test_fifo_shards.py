import pandas as pd

from onledger.streaming import stateful


class FakeList:
    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.calls += 1
        self.rows = []


class FakeHandle:
    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):
        return self.lists.setdefault(name, FakeList())

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


def test_state_calls_do_not_grow_with_wallets():
    """Every wallet of a shard buys at 10 and 20 and sells at 30 and 50; one sells too much at 40."""
    wallets, handle, lots = 300, FakeHandle(), stateful.FifoLots()
    lots.init(handle)
    names = stateful.HOLDER + stateful.ORDER
    rows = [(w, "t", ts, ts, 0, 0, 0, q, q * price, 0, side) for w in range(wallets)
            for ts, q, price, side in ((30, 15, 3, "sell"), (10, 10, 1, "buy"), (20, 10, 2, "buy"), (50, 5, 4, "sell"))]
    rows.append((7, "z", 40, 40, 0, 0, 0, 1, 1, 0, "sell"))
    assert list(lots.handleInputRows((3,), iter([pd.DataFrame(rows, columns=names)]), None)) == []
    first = pd.concat(lots.handleExpiredTimer((3,), Watermark(45), None))
    assert handle.timers == [11_000, 51_000]
    again = list(lots.handleExpiredTimer((3,), Watermark(45), None))
    second = pd.concat(lots.handleExpiredTimer((3,), Watermark(60), None))
    assert again == [] and not any(x.exists() for x in handle.lists.values())
    closed = first[first["kind"] == "closed"]
    assert sorted(closed["wallet"]) == list(range(wallets)) and set(closed["pnl"]) == {20.0} and set(closed["opened_at"]) == {10}
    assert first[first["kind"] == "unknown_basis"][["wallet", "token", "closed_at"]].values.tolist() == [[7, "z", 40]]
    assert sorted(second["wallet"]) == list(range(wallets)) and set(second["pnl"]) == {15.0} and set(second["closed_at"]) == {50}
    assert sum(x.calls for x in handle.lists.values()) < 20


def test_long_lists_keep_their_order_over_pieces(monkeypatch):
    monkeypatch.setattr(stateful, "PIECE_ROWS", 3)
    kept = FakeList()
    kept.put(stateful.packed(pd.DataFrame({"a": range(10)})))
    assert len(kept.rows) == 4 and stateful.unpacked(kept)["a"].tolist() == list(range(10))
