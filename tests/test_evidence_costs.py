"""Rules over several measurements read what was worked out once per measurement."""

from pyspark.sql import functions as F

from onledger.bindings import Tables
from onledger.operators.rules import failed
from onledger.plans import evidence as ev
from onledger.plans import scoring


def test_families_are_zipped_once(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").observed.withColumn("now", F.col("ts") + 10)
    plan = ev.assess(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan


def test_families_stand_together_in_the_catalogue():
    for prefix, names in (("market.", ev.METRICS), ("simulation.", ev.METRICS), ("buyers.", ev.METRICS), ("controls.", ev.CONTROLS)):
        places = [ev.METRICS.index(n) for n in names if n.startswith(prefix)]
        assert places == list(range(places[0], places[0] + len(places)))


def optimized(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_effective_values_read_plain_columns(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").observed.withColumn("now", F.col("ts") + 10)
    plan = optimized(ev.effective(ev.assess(rows)).select("id", "eff_price", "eff_source", "eff_is_proxy"))
    assert "metric_id" not in plan and "eff_price" in plan
    # formats of hashes and times are judged once per provenance, not per measurement
    assert plan.count("{64}\\z") <= 3


def test_one_pass_equals_the_three_steps(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").observed.withColumn("now", F.col("ts") + 10)
    columns = ["id", "ms", "errors", "freshness", "findings"]
    once, steps = ev.assess(rows).select(*columns), ev.quality(ev.validate(ev.build(rows))).select(*columns)
    assert once.count() == 1500 and once.exceptAll(steps).isEmpty() and steps.exceptAll(once).isEmpty()


def test_errors_of_changed_documents(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").observed.filter("id = 6").withColumn("now", F.col("ts") + 10)
    built = ev.build(rows)
    spoiled = F.transform("ms", lambda m, i: F.when(i == 1, m.withField("unit", F.lit("EUR")).withField("scope", F.lit(""))
                                                    .withField("status", F.lit("odd"))).otherwise(m))
    assert ev.validate(built).head().errors == []
    assert ev.validate(built.withColumn("ms", spoiled)).head().errors == [
        f"market.liquidity: {text}" for text in ("invalid status", "missing scope", "wrong unit", "non-measured status requires a reason")]
    for cut in (F.slice("ms", 1, 33), F.concat("ms", F.slice("ms", 1, 1)), F.reverse("ms")):
        wrong = ev.validate(built.withColumn("ms", cut))
        assert wrong.head().errors == ["Invalid measurement catalogue"]
        assert [f.code for f in ev.quality(wrong).head().findings] == ["SCHEMA_INVALID"]


def test_findings_are_compiled(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").observed.withColumn("now", F.col("ts") + 10)
    plan = optimized(ev.finding_rows(ev.assess(rows)))
    # lambdas put texts of broken rules together, they do not judge measurements
    assert "exists(" not in plan and "zip_with(" not in plan
    texts = [line for line in plan.splitlines() if "getbit(" in line]
    assert len(texts) == 1 and "isnan" not in texts[0]


def test_scores_are_added_up_without_a_lambda(spark):
    rows = Tables(spark, "/root/testdata/sf0.001").observed.withColumn("now", F.col("ts") + 10)
    rows = ev.effective(ev.assess(rows)).withColumn("risk_reasons", F.array().cast("array<string>"))
    out = scoring.decide(rows)
    assert "aggregate(" not in optimized(out.select("id", "score", "reasons", "action"))
    points = F.aggregate("components", F.lit(0).cast("bigint"), lambda a, p: a + p["hundredths"])
    assert out.count() == 1500 and out.filter(~F.col("score").eqNullSafe(F.round(points / 100, 1))).isEmpty()


def test_failed_rules_are_listed_without_a_lambda(spark):
    rules = [("a", F.col("id") == 0), ("b", F.lit(None).cast("boolean")), ("c", F.col("id") == 1)]
    out = spark.range(3).select("id", failed(rules).alias("reasons"))
    assert [r.reasons for r in out.orderBy("id").collect()] == [["b", "c"], ["a", "b"], ["a", "b", "c"]]
    assert "lambda" not in optimized(out) and not out.schema["reasons"].dataType.containsNull
