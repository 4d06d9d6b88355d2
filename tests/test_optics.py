"""Layer stacks: anchor values, properties of sweeps and envelopes, splines, stack fit."""

import numpy as np
import pytest
from measured import optical_tables
from pyspark.sql import functions as F

from lumisweep.functions.optics import with_responsivity
from lumisweep.operators import envelopes, resample, stackfit, stats, sweepgrid
from lumisweep.plans import jobs, views
from lumisweep.sources import tables

TABLES = optical_tables()
needs_tables = pytest.mark.skipif(len(TABLES) != 3, reason="optical tables are not here")

# Stack (um, nm, nm, degrees), wavelength, r_te, r_tm, r, absorption, quantum_eff, sabs.
ANCHORS = [
    ((10, 15, 70, 0), 400, 0.484249851, 0.484249851, 0.484249851, 1, 0.322621786, 0.166392234),
    ((10, 15, 70, 0), 660, 0.00446541754, 0.00446541754, 0.00446541754, 0.923494603,
     0.532325947, 0.489404939),
    ((10, 15, 70, 0), 1064, 0.111975382, 0.111975382, 0.111975382, 0.00957247154, 0.85817395,
     0.00729498523),
    ((380, 30, 95, 0), 905, 0.0230411076, 0.0230411076, 0.0230411076, 0.999981063, 0.72993179,
     0.713099849),
    ((65, 15, 98, 30), 905, 0.00656298732, 0.000547040082, 0.0035550137, 0.844341801,
     0.72993179, 0.614120925),
    ((65, 15, 98, 30), 940, 0.0105092047, 0.00330653218, 0.00690786843, 0.695655239,
     0.758161197, 0.523775469),
]


@pytest.fixture(scope="module")
def optical(spark):
    return tables.read_optical_constants(spark, TABLES)


@needs_tables
def test_optical_tables(optical):
    counts = {r["material"]: r["count"] for r in optical.groupBy("material").count().collect()}
    assert counts == {"si": 121, "sio2": 201, "si3n4": 710}
    assert optical.where("n is null or k is null or alpha is null").count() == 0


@needs_tables
def test_anchor_values(spark, optical):
    stacks = spark.createDataFrame(
        [(si * 1e-6, ox * 1e-9, nit * 1e-9, float(ang), float(lam), 1.0)
         for (si, ox, nit, ang), lam, *_ in ANCHORS],
        "thickness_si double, thickness_sio2 double, thickness_si3n4 double, "
        "angle_deg double, lambda_nm double, n_env double")
    indices = resample.refractive_indices(stacks, optical)
    got = {(r["angle_deg"], r["lambda_nm"], round(r["thickness_si"] * 1e6)): r for r in
           with_responsivity(sweepgrid.with_indices(stacks, indices)).collect()}
    for (si, _, _, ang), lam, *want in ANCHORS:
        row = got[float(ang), float(lam), si]
        have = [row[c] for c in ("r_te", "r_tm", "r", "absorption", "quantum_eff", "sabs")]
        assert have == pytest.approx(want, rel=1e-6)
        assert row["t"] == pytest.approx(1 - row["r"])


@needs_tables
def test_nine_level_sweep(spark, optical):
    sweep = jobs.responsivity_sweep_job(spark, optical, (10e-6, 15e-9, 60e-9),
                                        (1.5e-6, 5e-9, 5e-9), 9, 400, 1100, 1)
    peaks = stats.peak_row(sweep, ["combo"], "sabs", "lambda_nm", ["is_si_target"])
    row = {r["column"]: r for r in stats.summary_table(peaks, ["lambda_nm", "sabs"]).collect()}
    lam = row["lambda_nm"]
    assert [lam[c] for c in ("min", "q1", "median", "q3", "max")] == [621, 637, 645, 652, 673]
    assert lam["mean"] == pytest.approx(646.2002743, abs=1e-6)
    assert row["sabs"]["min"] == pytest.approx(0.462684878, rel=1e-6)
    assert row["sabs"]["max"] == pytest.approx(0.505769920, rel=1e-6)


def test_levels():
    assert sweepgrid.level_values(10.0, 0.0) == [10.0]
    assert sweepgrid.level_values(10.0, 2.0) == [8.0, 10.0, 12.0]
    assert len(sweepgrid.level_values(15e-9, 5e-9, 9)) == 9
    assert len(sweepgrid.thickness_decades()) == 361


def test_sweep_properties(spark):
    sweep = sweepgrid.tolerance_sweep(
        spark, [9e-6, 10e-6, 11e-6], [10e-9, 15e-9], [65e-9, 70e-9, 75e-9], [500.0, 700.0],
        (10e-6, 15e-9, 70e-9), angles=(0.0, 30.0))
    assert sweep.count() == 3 * 2 * 3 * 2 * 2
    assert sweep.select("combo").distinct().count() == 36
    done = with_responsivity(views.with_material_constants(sweep)).cache()
    assert done.where("r < 0 or r > 1 or r is null").count() == 0
    assert done.where("angle_deg = 0 and abs(r_te - r_tm) > 1e-12").count() == 0
    bands = envelopes.envelope(done, ["lambda_nm", "angle_deg"])
    assert bands.where("target between min and max").count() == bands.count() == 4
    plain = with_responsivity(views.with_material_constants(
        sweep.where("angle_deg = 0")), tilted=False)
    diff = plain.alias("p").join(done.where("angle_deg = 0").alias("d"), ["combo", "lambda_nm"])
    assert diff.where("abs(p.sabs - d.sabs) > 1e-12").count() == 0
    right = envelopes.targets_with_envelope_by_angle(done.where("angle_deg = 0 or combo < 0"))
    assert right.count() == 2
    done.unpersist()


def dense_spline(x, y):
    """Second-order coefficients by a full linear solve of the defining equations."""
    n, h = len(x), np.diff(x)
    s = np.diff(y) / h
    m, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = s[i] - s[i - 1]
    d = (s[1:] - s[:-1]) / (x[2:] - x[:-2])
    m[0, :2], b[0] = (-h[0], h[0]), h[0] ** 2 * (d[1] - d[0]) / (x[3] - x[0])
    m[-1, -2:], b[-1] = (h[-1], -h[-1]), -h[-1] ** 2 * (d[-1] - d[-2]) / (x[-1] - x[-4])
    return np.linalg.solve(m, b)


def test_spline_in_chunks(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.2, 3.0, 1500))
    y = np.sin(x / 7) + rng.normal(0, 0.3, 1500)
    table = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)],
                                  "m string, x double, y double").repartition(4)
    got = resample.spline_coefficients(table, ["m"], "x", ["y"]).orderBy("x").toPandas()
    assert len(got) == 1500
    np.testing.assert_allclose(got["y_c"], dense_spline(x, y), atol=1e-12)
    values = resample.spline_resample(table.select("m", "x"), table, ["m"], "x", ["y"])
    back = values.orderBy("x").toPandas()
    np.testing.assert_allclose(back["y"], y, atol=1e-12)


def test_spline_reproduces_a_cubic_also_outside(spark):
    cube = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    table = spark.createDataFrame([("m", float(t), cube(float(t))) for t in (0, 1, 3, 4, 7, 9)],
                                  "m string, x double, y double")
    points = spark.createDataFrame([("m", t) for t in (-1.0, 0.5, 2.0, 8.5, 11.0)],
                                   "m string, x double")
    for r in resample.spline_resample(points, table, ["m"], "x", ["y"]).collect():
        assert r["y"] == pytest.approx(cube(r["x"]), abs=1e-9)


def test_stack_fit_finds_the_truth(spark):
    truth = spark.createDataFrame([(1, 9.3e-6, 13e-9, 74e-9), (2, 10.9e-6, 18e-9, 66e-9)],
                                  "k int, thickness_si double, thickness_sio2 double, "
                                  "thickness_si3n4 double")
    rows = truth.withColumn("lambda_nm", F.explode(F.lit([float(v) for v in range(400, 1101, 10)])))
    curve = with_responsivity(views.with_material_constants(rows), tilted=False).select(
        "k", "lambda_nm", F.col("sabs").alias("y"))
    indices = views.with_material_constants(sweepgrid.wavelength_grid(spark, 400, 1100, 10))
    fitted = stackfit.fit_layer_stack(curve.union(curve), indices, ["k"], "y")
    got = {r["k"]: r for r in fitted.collect()}
    for r in truth.collect():
        for c in ("thickness_si", "thickness_sio2", "thickness_si3n4"):
            assert got[r["k"]][c] == pytest.approx(r[c], rel=1e-5)
    predicted = stackfit.predict_layer_stack(curve, indices, fitted, ["k"], "y")
    summary = stackfit.residual_summary(predicted, ["k"]).collect()
    assert all(r["n"] == 71 and r["rmse"] < 1e-6 for r in summary)
