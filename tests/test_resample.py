"""Cuts of an order are asked for by the largest key, not by all rows together."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumisweep.operators import keyed, resample


def _curves(spark, knots):
    rows = [(k, float(i), float((i * 7 + len(str(k))) % 5)) for k, n in knots.items()
            for i in range(n)]
    table = spark.createDataFrame(rows, "k int, x double, y double")
    points = spark.createDataFrame([(k, i + 0.25) for k in knots for i in range(4)],
                                   "k int, x double")
    return table, points


def test_many_small_keys_need_no_cuts(spark, monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_PER_BUCKET", 20)
    table, points = _curves(spark, {None: 8, **{k: 10 for k in range(6)}})
    assert resample._common_splits(points, table, ["k"], "x") == []
    found = resample.spline_resample(points, table, ["k"], "x", ["y"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInPandas") == 1
    assert found.count() == 28 and found.where("y IS NULL").isEmpty()


def test_a_large_key_is_cut_with_the_same_values(spark, monkeypatch):
    table, points = _curves(spark, {1: 60, 2: 6, None: 6})
    plain = resample.spline_resample(points, table, ["k"], "x", ["y"]).withColumn(
        "y", F.round("y", 9))
    monkeypatch.setattr(keyed, "ROWS_PER_BUCKET", 20)
    assert resample._common_splits(points, table, ["k"], "x")
    cut = resample.spline_resample(points, table, ["k"], "x", ["y"]).withColumn(
        "y", F.round("y", 9))
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()
