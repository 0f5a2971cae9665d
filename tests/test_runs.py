"""Whole runs on a small drive."""

import pytest
from pyspark.sql import functions as F

from test_operators import RULE, S, normal
from tracewright.plans import runs


@pytest.fixture(scope="module")
def trained(spark):
    v1 = runs.train(normal(spark, "cap01", 10, 1), normal(spark, "cap02", 8, 2), S, 0.2)
    return v1, runs.train(normal(spark, "cap01", 10, 1), normal(spark, "cap02", 8, 2), S, 0.2, "v3", ["0D0"], v1.stage1)


def test_ordinary(spark, trained):
    v1, _ = trained
    got = runs.ordinary(normal(spark, "cap03", 6, 3), v1, validation=normal(spark, "cap02", 8, 2), max_rate=0.5)
    assert got.outputs.count() == 5 and {r["action"] for r in got.action_counts.collect()} == {"SIMULATED_ALERT", "SIMULATED_FORWARD", "SIMULATED_ISOLATION"}
    assert got.advice.count() == got.escalations.where("escalate").count() and got.egress.count() == 1


def test_red_team(spark, trained):
    _, v3 = trained
    got = runs.red_team(normal(spark, "cap03", 6, 3), v3, 0.1)
    rows = got.results.groupBy("is_attack", "family").count().collect()
    assert {(r["is_attack"], r["family"]): r["count"] for r in rows} == {(False, None): 5, (True, "freeze"): 5, (True, "offset"): 5}
    assert {r["family"]: r["proposed"] for r in got.proposed.collect()} == {"freeze": 5, "offset": 5}
    assert {r["family"]: r["recall"] for r in got.by_family.collect()}["freeze"] == 1.0
    assert got.quality.first()["windows"] == 15 and got.evasions.where("family = 'freeze'").count() == 0


def test_final_comparison(spark, trained):
    v1, v3 = trained
    frames = normal(spark, "cap04", 8, 1)
    frames = frames.withColumn("payload", F.when((F.col("can_id") == "0D0") & F.col("t_us").between(3 * S, 4 * S), "FF00000000FF0000").otherwise(F.col("payload")))
    rule = spark.createDataFrame([("cap04", "masquerade", "speed", "0D0", 3 * S, 4 * S - 1, None)], RULE)
    trained_on = spark.createDataFrame([("cap01_w0000",)], "window_id string")
    rates, delays = runs.final_comparison(frames, rule, v1, v3, trained_on)
    assert {r["model_version"]: r["tp"] for r in rates.collect()}["v3"] == 1
    assert {r["model_version"]: r["delay_s"] for r in delays.collect()}["v3"] == 1.0
    with pytest.raises(ValueError, match="trained"):
        runs.final_comparison(frames, rule, v1, v3, spark.createDataFrame([("cap04_w0003",)], "window_id string"))
    assert runs.check_development(frames, rule, [v1, v3]).where("model_version is null").count() == 1
