"""Cases that ordinary bound tables do not hold: NULL keys in cut scans, wide values, nested secrets, replayed batches."""

import json

import pytest
from pyspark.sql import functions as F

from onledger.functions import wide
from onledger.functions import decode as d
from onledger.operators import scan
from onledger.plans import attribution as at
from onledger.plans import redaction
from tests.conftest import rows_of


@pytest.mark.parametrize("order", ["at", "n"])
def test_cut_scans_keep_null_keys_and_null_times(table, order):
    rows = table("k string, at long, n long, v long", [
        ("a", 1, 1, 5), ("a", None, 2, 7), ("a", 9, 3, 1), ("a", 9, 4, 2), (None, 3, 5, 4), (None, None, 6, 8), (None, 8, 7, 3), ("b", 2, 8, 6),
        ("a", 4, 9, None), ("a", None, 10, 11)])

    def run(limit):
        out = scan.running(rows, ["k"], ["at", "n"] if order == "at" else ["n"], scan.width_bucket(order, 3), max_rows=limit,
                           sums={"s": (F.col("v"), True)}, lasts={"l": (F.col("v"), False)}, nexts={"x": (F.col("v"), False)})
        return rows_of(out, "n", "k", "s", "l", "x")

    whole = run(10**9)
    assert len(whole) == 10 and run(1) == whole and run(3) == whole


def test_cut_inventory_keeps_null_keys(table):
    rows = table("k string, at long, q long, b boolean", [(None, 1, 5, True), (None, 2, 3, False), (None, None, 2, True), ("a", 1, 1, False), ("a", 5, 4, True)])

    def run(limit):
        out = scan.inventory(rows, ["k"], ["at"], scan.width_bucket("at", 1), F.col("q"), F.col("b"), max_rows=limit)
        return rows_of(out, "k", "at", "bought", "held_before", "taken", "short", "head_final")

    assert len(run(10**9)) == 5 and run(1) == run(10**9)


def test_quantities_of_any_length(table):
    rows = table("n int, t string", [(1, "0x" + "0" * 100 + "ff"), (2, hex(10**19)), (3, str(10**20)), (4, "0xzz"), (5, hex(2**200)), (6, None)])
    out = {r.n: (r.q, r.w) for r in rows.select("n", d.quantity(F.col("t")).alias("q"), wide.to_text(d.wide_quantity(F.col("t"))).alias("w")).collect()}
    assert out[1] == (255, "255") and out[2] == (None, str(10**19)) and out[3] == (None, str(10**20)) and out[5] == (None, str(2**200))
    assert out[4] == out[6] == (None, None)


def test_native_deltas_of_large_values_and_path_order(table):
    frames = table("tx long, path string, root_sender string, kind string, sender string, recipient string, value string", [
        (1, "0", "a", "CALL", "a", "b", hex(10 * 10**18)), (1, "0.1", "a", "CALL", "b", "c", None), (2, "0", "a", "CALL", "a", "b", hex(2**200)),
        (3, "0.10", "r", "CREATE", "late", "t", None), (3, "0.2", "r", "CREATE", "early", "t", None)])
    deltas = at.native_deltas(frames.filter("tx < 3"), d.wide_quantity(F.col("value"))).withColumn("delta", wide.to_text(F.col("delta")))
    assert {(r.tx, r.wallet): int(r.delta) for r in deltas.collect()} == {
        (1, "a"): -(10**19), (1, "b"): 10**19, (1, "c"): 0, (2, "a"): -(2**200), (2, "b"): 2**200}
    broken = at.native_deltas(frames.filter("tx = 1").withColumn("value", F.lit("0xzz")), d.wide_quantity(F.col("value")))
    assert all(r.delta is None for r in broken.collect())
    assert [r.deployer for r in at.deployment_origins(frames.filter("tx = 3")).collect()] == ["early"]


def test_nested_secrets_never_survive_and_json_stays_valid(table):
    docs = ['{"api_key":{"a":{"b":"hush"}}}', '{"api_key":[{"v":"hush"}]}', json.dumps({"t": json.dumps({"password": {"x": "hush"}})}),
            '{"note":"password=hush","k":1}', '{"k":2,"secret":"hush"}', '{"plain":"fine"}', 'password=hush rest']
    out = redaction.redact(table("i int, doc string", list(enumerate(docs))), ["doc"]).orderBy("i").collect()
    assert all("hush" not in r.doc for r in out)
    assert [json.loads(r.doc) is not None for r in out[:6]] == [True] * 6
    assert json.loads(out[3].doc)["k"] == 1 and json.loads(out[4].doc)["k"] == 2 and not out[5].changed
    assert all(sum(r.redactions.asDict().values()) > 0 for r in out if r.i != 5)


def test_read_all_leaves_later_versions_out(spark, table, tmp_path):
    from onledger.sources.sinks import VersionedTable

    stored = VersionedTable(spark, str(tmp_path / "known"))
    stored.write(table("n int", [(1,)]), 1)
    stored.write(table("n int", [(2,)]), 2)
    assert rows_of(stored.read_all(2), "n") == [(1,)] and stored.read_all(1) is None and stored.read_all().count() == 2


def test_repeated_batches_and_rebuilds_change_nothing(spark, table, tmp_path):
    from onledger.sources import sinks

    stored = sinks.VersionedTable(spark, str(tmp_path / "rows"))
    for _ in range(2):
        sinks.append_new(stored, table("k int, v int", [(1, 5), (1, 6)]), ["k"], ["v"], 1)
    for _ in range(2):
        sinks.append_new(stored, table("k int, v int", [(1, 7), (2, 8)]), ["k"], ["v"], 2)
    assert rows_of(stored.read_all(), "k", "v") == [(1, 5), (2, 8)]
    current, archive = (sinks.VersionedTable(spark, str(tmp_path / n)) for n in ("current", "archive"))
    sinks.rebuild_version(current, archive, table("k int", [(1,)]), "k", F.lit(0), 1)
    for _ in range(2):
        sinks.rebuild_version(current, archive, table("k int", [(2,)]), "k", F.lit(0), 2)
    assert rows_of(current.read(), "k") == [(2,)] and rows_of(archive.read_all(), "version", "key") == [(1, "1")]
