"""A stored history of scorecards, read back and compared."""

from pyspark.sql import functions as F

from tidemark.plans import analyses, quality
from tests.test_store import copy_of, orders, replace


def test_two_runs_over_different_data(spark, small, tmp_path):
    path, sf = str(tmp_path / "history"), copy_of(small, tmp_path)
    first = analyses.record(spark, sf, path)
    now = quality.m15_scorecard(spark, sf)
    assert analyses.drifted(analyses.stored_drift(spark, path, now)) == 0
    later = orders(spark, sf)
    replace(spark, sf, later.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderdate + interval 8 years")).otherwise(F.col("o_orderdate"))))
    now = quality.m15_scorecard(spark, sf).where("rule <> 'null_value'").unionByName(quality.m15_scorecard(spark, sf).where("place = 1").withColumn("rule", F.lit("new_rule")))
    found = {r.rule: r.status for r in analyses.stored_drift(spark, path, now).collect()}
    assert found["null_value"] == "REMOVED" and found["new_rule"] == "NEW" and "implausible_duration" not in found
    second = analyses.record(spark, sf, path, now)
    assert second > first
    assert analyses.drifted(analyses.stored_drift(spark, path, now)) == 0
    assert analyses.drifted(analyses.stored_drift(spark, path, now, first)) == 1
    short = now.where("place <= 2 and rule <> 'new_rule'").collect()
    assert analyses.record(spark, sf, path, now.where("place <= 2 and rule <> 'new_rule'")) == second  # of one vintage, the last
    assert analyses.stored_drift(spark, path, now).where("status = 'NEW'").count() == now.count() - len(short)
