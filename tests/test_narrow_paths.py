from conftest import rows_of
from pyspark.sql import functions as F

from onledger.functions import amounts, wide
from onledger.functions import decode as d
from onledger.functions.pin import pinned
from onledger.plans import attribution as at


def word(value):
    return f"{value % (1 << 256):064x}"


def test_narrow_words_equal_wide_words_or_are_null(table):
    values = [0, 1, -1, 2 ** 59, -2 ** 60, 10 ** 18, 2 ** 120 - 1, -2 ** 120, 2 ** 120, -2 ** 120 - 1, 2 ** 200]
    rows = table("w string", [(word(v),) for v in values] + [("xy",), (None,)])
    out = rows.select(d.narrow_unsigned(F.col("w")).cast("string").alias("u"), wide.to_text(d.unsigned(F.col("w"))).alias("wu"),
                      d.narrow_signed(F.col("w")).cast("string").alias("s"), wide.to_text(d.signed(F.col("w"))).alias("ws")).collect()
    assert all(r.u in (None, r.wu) and r.s in (None, r.ws) for r in out)
    assert [r.s for r in out[:8]] == [str(v) for v in values[:8]] and [r.s for r in out[8:]] == [None] * 5
    assert [r.u is None for r in out] == [not 0 <= v < 2 ** 120 for v in values] + [True, True]


def test_narrow_quantities(table):
    texts = ["0", "-5", "9" * 28, "9" * 29, "0x0", "0xff", "0x" + "f" * 22, "0x" + "f" * 23, "0x", "1.5", "", None]
    out = table("t string", [(t,) for t in texts]).select(d.narrow_quantity(F.col("t")).alias("n")).collect()
    assert [None if r.n is None else int(r.n) for r in out] == [0, -5, 10 ** 28 - 1, None, 0, 255, 16 ** 22 - 1, None, None, None, None, None]


def test_trees_are_parsed_once_and_deltas_use_decimals_where_they_fit(table):
    tree = '{"type":"call","from":"A","to":"b","value":"7","calls":[{"type":"CALL","from":"b","to":"c","value":%s},{"error":"x","calls":[{"type":"CALL"}]},5]}'
    rows = [(1, tree % '"0x5"'), (2, tree % f'"{2 ** 200}"'), (3, tree % '"bad"'), (4, tree % "null"), (5, "no json"), (6, '{"from":{"a":1}}')]
    frames = at.flatten_frames(table("tx long, trace string", rows))
    assert rows_of(frames.filter("tx = 1"), "path", "root_sender", "kind", "sender", "value") == rows_of(table(
        "path string, root_sender string, kind string, sender string, value string",
        [("0", "a", "CALL", "a", "7"), ("0.0", "a", "CALL", "b", "0x5"), ("0.2", "a", None, None, None)]),
        "path", "root_sender", "kind", "sender", "value")
    plain = at.native_deltas(frames.filter("tx IN (1, 4)"), d.wide_quantity(F.col("value")), narrow=d.narrow_quantity(F.col("value")))
    assert plain.schema["delta"].dataType == amounts.NARROW
    mixed = at.native_deltas(frames, d.wide_quantity(F.col("value")), narrow=d.narrow_quantity(F.col("value")))
    got = {(r.tx, r.wallet): r.t for r in mixed.withColumn("t", amounts.text(mixed, "delta")).collect()}
    assert got == {(1, "a"): "-7", (1, "b"): "2", (1, "c"): "5", (2, "a"): "-7", (2, "b"): str(7 - 2 ** 200), (2, "c"): str(2 ** 200),
                   (3, "a"): "-7", (3, "b"): None, (3, "c"): None, (4, "a"): "-7", (4, "b"): "7", (4, "c"): "0"}


def test_pinned_values_are_computed_below_the_generator(spark):
    rows = pinned(spark.range(3), "p", F.sha2(F.col("id").cast("string"), 256))
    text = rows.filter("p > 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sha2") == 1 and "explode(array(_pinned" in text
