"""Equal stacks share one sweep; large sides of joins never go through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumisweep.operators import envelopes, sweepgrid


def _stacks(spark, n):
    key = F.col("id")
    rows = spark.range(n).select(key.alias("part"), *[
        (1 + key % 2).cast("double").alias(c) for c in sweepgrid.GEOMETRY])
    # A NULL key with two shapes, one of which is shared, and a row that comes twice.
    odd = [(None, *[1.0] * 6), (None, *[3.0] * 6), (0, *[1.0] * 6)]
    return rows.unionByName(spark.createDataFrame(
        odd, ", ".join(f"{c} double" if c != "part" else "part long" for c in rows.columns)))


def test_equal_stacks_share_one_sweep(spark):
    stacks = _stacks(spark, 200)
    members, sets = sweepgrid.alike(sweepgrid.layers_of(stacks, ["part"]), ["part"])
    assert sets.select(*sweepgrid.ALIKE).distinct().count() == 3
    rows = sweepgrid.for_members(sets, members).select(*stacks.columns)
    expected = stacks.distinct()
    assert rows.exceptAll(expected).isEmpty() and expected.exceptAll(rows).isEmpty()


def test_large_sets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sweepgrid, "STACKS_PER_SHARE", 10)
    members, sets = sweepgrid.alike(
        sweepgrid.layers_of(_stacks(spark, 200), ["part"]), ["part"])
    sizes = [r["count"] for r in members.groupBy(*sweepgrid.ALIKE).count().collect()]
    assert sum(sizes) == 201 and max(sizes) < 30
    assert sets.count() == len(sizes) + 1


def test_targets_meet_bounds_without_a_broadcast_of_the_sweep(spark):
    few = spark.createDataFrame([(1, 0.0), (2, 15.0)], "part int, angle_deg double")
    targets = few.withColumn("lambda_nm", F.explode(F.lit([400.0, 500.0])))
    bounds = spark.createDataFrame([(0.0, 1.0), (15.0, 2.0), (30.0, 3.0)],
                                   "angle_deg double, min double")
    found = envelopes.with_angle_bounds(targets, bounds)
    expected = targets.join(bounds, "angle_deg", "right").select(*found.columns)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
