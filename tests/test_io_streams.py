"""Write-then-read and stream-equals-batch, with restarts."""

import json
import pytest
from conftest import rows_of
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from onledger.session import work_dir
from onledger.sources import readers, sinks
from onledger.streaming import jobs, stateful


def test_append_is_idempotent_and_versions_survive(spark, table):
    t = sinks.VersionedTable(spark, work_dir(spark, "t"))
    batch = table("k long, v long", [(1, 1), (1, 0), (2, 5)])
    for _ in range(3):
        sinks.append_new(t, batch, ["k"], ["v"])
    assert rows_of(t.read_all(), "k", "v") == [(1, 0), (2, 5)] and t.versions() == [1, 2, 3] and t.read(3).count() == 0


def test_known_values_are_kept_and_unknown_ones_filled(table):
    rows = table("k long, a long, b long, seq long", [(1, None, 7, 1), (1, 5, 8, 2), (1, 6, None, 3)])
    assert rows_of(sinks.upsert_known(rows, ["k"], ["a", "b"], "seq"), "k", "a", "b") == [(1, 5, 7)]


def test_csv_null_is_empty_and_jsonl_nests(spark, table):
    rows = table("id long, x double, j string", [(2, None, '{"a": [1]}'), (1, 0.0, "{broken"), (3, 1.5, None)])
    path = work_dir(spark, "csv")
    sinks.write_csv(rows.select("id", "x"), path, ["id"])
    assert [r.value for r in spark.read.text(path).collect() if r.value != "id,x"] == ["1,0.0", "2,", "3,1.5"]
    path = work_dir(spark, "jsonl")
    sinks.write_jsonl(rows, path, ["j"])
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == ['{"id":1,"x":0.0,"j":"{broken"}', '{"id":2,"x":null,"j":{"a":[1]}}', '{"id":3,"x":1.5,"j":null}']


def test_snapshot_export_and_manifest(spark, table):
    root = work_dir(spark, "export")
    rows = table("id long, secret string", [(1, "a"), (2, "b")])
    report = sinks.export_snapshot(spark, {"one": rows, "two": rows}, root, exclude=["two"], null_columns={"one": ["secret"]})
    assert rows_of(report, "table_name", "source_rows", "target_rows", "agrees") == [("one", 2, 2, True), ("two", 2, None, True)]
    assert spark.read.parquet(f"{root}/one").filter("secret IS NOT NULL").count() == 0
    files = sinks.manifest(spark, root).collect()
    assert files and all(f.relative_path.startswith("one/") and len(f.sha256) == 64 and f.bytes > 0 for f in files)


def test_candle_arrays(table):
    rows = table("candle array<double>", [([60.0, 1.0, 3.0, 2.0, 2.5, 9.0],), ([61.0, 1.0, 3.0, 2.0, 2.5, 9.0],), ([120.0, 1.0],),
                                          ([120.0, 1.0, 3.0, 2.0, -1.0, 9.0],), ([180.0, 1.0, 3.0, 2.0, float("nan"), 9.0],)])
    assert rows_of(readers.parse_candles(rows), "start", "close", "available_at") == [(60, 2.5, 120)]


def feed(spark, folder, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_confirmed_rows_wait_and_a_restart_continues(spark):
    folder, root, schema = work_dir(spark, "in"), work_dir(spark, "confirm"), "block long, v long"
    feed(spark, folder, schema, [(1, 1), (2, 2), (9, 9)])
    stream = lambda: jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    jobs.confirmed_ingestion(stream(), root, "block", 3)
    assert rows_of(spark.read.parquet(f"{root}/out"), "v") == [(1,), (2,)]
    feed(spark, folder, schema, [(3, 3), (12, 12)])
    jobs.confirmed_ingestion(stream(), root, "block", 3)
    jobs.confirmed_ingestion(stream(), root, "block", 3)
    assert rows_of(spark.read.parquet(f"{root}/out"), "v") == [(1,), (2,), (3,), (9,)]


def test_reorganisation_stops_the_stream(spark):
    folder, root, schema = work_dir(spark, "in"), work_dir(spark, "headers"), "number long, hash string"
    feed(spark, folder, schema, [(1, "a"), (2, "b")])
    stream = lambda: jobs.read_stream(spark, folder, spark.read.parquet(folder).schema)
    jobs.watch_headers(stream(), root)
    feed(spark, folder, schema, [(2, "x")])
    with pytest.raises(StreamingQueryException):
        jobs.watch_headers(stream(), root)
    assert rows_of(spark.read.parquet(f"{root}/conflicts"), "number", "hashes") == [(2, 2)]
    assert rows_of(sinks.VersionedTable(spark, f"{root}/known").read_all(), "hash") == [("a",), ("b",)]


def test_conflicting_batch_writes_nothing(spark):
    folder, root, schema = work_dir(spark, "in"), work_dir(spark, "norm"), "tx long, block long, v long, seq long"
    feed(spark, folder, schema, [(1, 5, None, 1), (2, 5, 2, 2)])
    stream = lambda: jobs.read_stream(spark, folder, spark.read.parquet(folder).schema)
    run = lambda: jobs.normalise_incrementally(stream(), root, ["tx"], ["block"], ["v"], "seq")
    run()
    feed(spark, folder, schema, [(1, 5, 9, 3)])
    run()
    feed(spark, folder, schema, [(1, 6, 9, 4), (3, 7, 1, 5)])
    with pytest.raises(StreamingQueryException):
        run()
    assert rows_of(jobs.known_values(spark, root, ["tx"], ["block", "v"], "seq"), "tx", "block", "v") == [(1, 5, 9), (2, 5, 2)]


def test_fifo_state_equals_batch_over_many_files(spark):
    schema = "wallet long, token string, ts long, tx long, log_index long, pool long, origin long, quantity long, quote long, gas long, side string"
    rows = [(1, "t", 10, 1, 0, 0, 0, 100, 100, 1, "buy"), (1, "t", 20, 2, 0, 0, 0, 50, 70, 1, "sell"), (1, "t", 30, 3, 0, 0, 0, 50, 70, 1, "sell"),
            (2, "t", 40, 4, 0, 0, 0, 5, 9, 0, "sell"), (9, "z", 9999, 5, 0, 0, 0, 1, 1, 0, "buy")]
    folder, root = work_dir(spark, "in"), work_dir(spark, "fifo")
    for part in (rows[1:3], rows[:1] + rows[3:4]):  # the buy arrives after its sales, within the allowed delay
        feed(spark, folder, schema, part)
    before = spark.conf.get(stateful.STORE_CONF)
    spark.conf.set(stateful.STORE_CONF, stateful.ROCKSDB)
    try:
        def run():
            flows = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1).withColumn("at", F.timestamp_seconds("ts"))
            out = stateful.stream_fifo(flows, "at", "100 seconds")
            jobs.run_to_files(out, root)
            return jobs.output(spark, root, out.schema)

        assert run().count() == 0
        feed(spark, folder, schema, rows[4:])  # a later event moves the watermark past the others
        assert rows_of(run(), "wallet", "closed_at", "pnl", "kind") == [(1, 30, 37.0, "closed"), (2, 40, None, "unknown_basis")]
    finally:
        spark.conf.set(stateful.STORE_CONF, before)


def test_step_model():
    lots, done = stateful.step([], (1, 0, 0, 0, 0, 10, 100, 0, "buy"))
    lots, done = stateful.step(lots, (2, 0, 0, 0, 0, 4, 80, 0, "sell"))
    assert done == [] and lots[0][1] == 6
    lots, done = stateful.step(lots, (3, 0, 0, 0, 0, 7, 80, 0, "sell"))
    assert lots == [] and done[0][-1] == "unknown_basis"


def test_candles_inside_their_bucket(table):
    rows = table("candle array<double>, bucket long", [([3600.0, 1.0, 2.0, 1.5, 2.5, 9.0], 3600), ([7200.0, 1.0, 2.0, 1.5, 2.5, 9.0], 3600), ([3660.0, 1.0, 2.0, 1.5, 2.5, 9.0], None)])
    assert rows_of(readers.parse_candles(rows, bucket="bucket"), "start") == [(3600,)]
    assert readers.parse_candles(rows, width=300).count() == 2


def test_saved_history_is_an_array_and_must_match_the_job(spark, table, tmp_path):
    docs = [{"wallet": "0xAB", "start_block": 1, "end_block": 9, "transactions": [{"hash": "0x1", "blockNumber": "3", "from": "0xab", "to": "0xc"}]},
            {"wallet": "0xCD", "start_block": 1, "end_block": 8, "transactions": []}]
    (tmp_path / "a.json").write_text(json.dumps(docs, indent=1))
    saved = readers.read_history(spark, str(tmp_path))
    assert saved.count() == 2 and rows_of(readers.explode_history(saved), "wallet", "hash", "block") == [("0xab", "0x1", 3)]
    jobs = table("wallet string, start_block long, end_block long", [("0xab", 1, 9), ("0xab", 1, 10), ("0xcd", 1, 8), ("0xef", 1, 8)])
    assert rows_of(readers.history_for_jobs(saved, jobs), "wallet", "end_block", "status") == [
        ("0xab", 9, "matched"), ("0xab", 10, "unavailable"), ("0xcd", 8, "matched"), ("0xef", 8, "unavailable")]
