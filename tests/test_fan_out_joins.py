"""Fits join rows of a fan-out with per-key values without a broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumisweep.operators import fits, stackfit
from lumisweep.plans import views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lowpass_fit_broadcasts_no_rows(spark):
    rows = spark.range(20).withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(30)))).select(
        "id", F.col("f").cast("double").alias("f"),
        (-20 * F.log10(1 + F.pow(F.col("f") / 10, 2))).alias("a"))
    fitted = fits.fit_lowpass2(rows, ["id"])
    assert "BroadcastExchange" not in _plan(fitted)
    assert fitted.where("converged and abs(f0_mhz - 10) < 1e-6").count() == 20


def test_stack_prediction_broadcasts_no_curves(spark):
    curves = spark.range(5).withColumn(
        "lambda_nm", F.explode(F.lit(views.MEASURED_LAMBDAS))).withColumn("y", F.lit(0.3))
    indices = views.measured_indices(spark)
    fitted = spark.range(5).select("id", *[F.lit(1e-8).alias(f"thickness_{k}")
                                           for k in stackfit.PARAMETERS])
    plan = _plan(stackfit.predict_layer_stack(curves, indices, fitted, ["id"], "y"))
    assert "ShuffledHashJoin [coalesce(id" in plan


def test_singular_steps_are_refused():
    matrices = np.stack([np.ones((2, 2)), 2 * np.eye(2)])
    found = fits.solve_each(matrices, np.ones((2, 2)))
    assert np.isnan(found[0]).all() and (found[1] == 0.5).all()


def test_equal_sweeps_are_fitted_once(monkeypatch):
    f = np.arange(80.0, 1500.0, 10.0)
    a = [-20 * np.log10(1 + (f / 300) ** 2), -20 * np.log10(1 + (f / 400) ** 2)]
    solved = []
    block = fits._fit_block
    monkeypatch.setattr(fits, "_fit_block", lambda x, y: solved.append(len(x)) or block(x, y))
    known = {}
    with np.errstate(all="ignore"):
        found = fits._fit_new([f, f, f], [a[0], a[1], a[0]], known)
        again = fits._fit_new([f], [a[1]], known)
    assert sum(solved) == 2
    assert (found[0] == found[2]).all() and (again[0] == found[1]).all()


def test_equal_curves_are_fitted_once(monkeypatch):
    curve = np.random.default_rng(1).uniform(1, 2, (9, len(stackfit._FIELDS)))
    solved = []
    block = stackfit._fit_block
    monkeypatch.setattr(stackfit, "_fit_block",
                        lambda x, y: solved.append(len(x)) or block(x, y))
    with np.errstate(all="ignore"):
        found = stackfit._fit_new([curve.ravel(), 2 * curve.ravel(), curve.ravel()], None, {})
    assert sum(solved) == 2
    assert np.array_equal(found[0], found[2], equal_nan=True)


def _exchanges(df):
    """Shuffles that no ``repartition`` asked for."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return plan.count("ENSURE_REQUIREMENTS")


def test_rows_dealt_by_key_are_not_shuffled_by_the_lowpass_fit(spark):
    few = spark.createDataFrame([(1, 50.0), (2, 500.0), (3, 90.0)], "k int, f0 double")

    def rows(df):
        wide = df.repartition(4, "k").withColumn("f", F.explode(F.lit([25.0 * i for i in range(40)])))
        return wide.select("k", "f", (-20 * F.log10(1 + F.pow(F.col("f") / F.col("f0"), 2))).alias("a"))

    found = fits.fit_lowpass2(rows(few), ["k"])
    assert _exchanges(found) == 0
    with_null = fits.fit_lowpass2(rows(few.union(spark.createDataFrame([(None, 70.0)], few.schema))), ["k"])
    assert {r["k"]: round(r["f0_mhz"], 4) for r in with_null.collect()} == {
        1: 50.0, 2: 500.0, 3: 90.0, None: 70.0}
    assert {r["k"] for r in found.collect()} == {1, 2, 3}


def _sweeps(spark, keys):
    table = spark.createDataFrame([(k,) for k in keys], "k int").repartition(4, "k")
    i = F.sequence(F.lit(0), F.lit(59))
    return table.withColumn("points", F.transform(i, lambda x: F.struct(
        x.alias("pos"), (x * 40.0).alias("f"),
        (-20 * F.log10(1 + F.pow(x * 40.0 / 300, 2)) + 0.01 * ((x * 37) % 11)).alias("a"))))


def test_sweeps_are_fitted_where_they_are(spark):
    found = fits.fit_rational_packed(_sweeps(spark, [1, 2, 3]), ["k"])
    assert _plan(found).count("Exchange hashpartitioning") == 1          # the test's own


def test_samples_dealt_by_key_are_not_shuffled_by_the_certificate(spark):
    for keys in ([1, 2, 3], [1, None, 3]):
        packed = _sweeps(spark, keys)
        fitted = fits.fit_rational_packed(packed, ["k"], digits=None).drop("points").persist()
        samples = packed.select("k", F.inline_outer("points"))
        proof = fits.rational_certificate(samples, fitted, ["k"])
        if None not in keys:
            assert _exchanges(proof) <= 1              # the few fitted rows
        assert {(r["k"], r["n"]) for r in proof.collect()} == {(k, 60) for k in keys}
        fitted.unpersist()
