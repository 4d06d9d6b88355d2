"""Cut-off semantics: worked example, ties, ends, empty plateau, known low-pass."""

import math

import pytest
from pyspark.sql import functions as F

from lumisweep.operators import fits, readout, rollup

WORKED = [0, .1, 0, -.1, 0, -1, -2.9, -4, -6, -9]


def sweep(spark, levels, key="s", step=20.0):
    return spark.createDataFrame(
        [(key, i, step * (i + 1), None if a is None else float(a)) for i, a in enumerate(levels)],
        "k string, pos int, f double, a double")


def both(spark, levels, **options):
    rows = sweep(spark, levels)
    keyed = readout.cutoff_readout(rows, ["k"], **options).first()
    packed = readout.cutoff_packed(readout.pack_sweep(rows, ["k"], 0, 1000), **options).first()
    assert keyed["cutoff_mhz"] == packed["cutoff_mhz"]
    assert keyed["plateau"] == packed["plateau"]
    return keyed


def test_worked_example(spark):
    row = both(spark, WORKED)
    assert (row["plateau"], row["n_plateau"], row["pos"], row["cutoff_mhz"]) == (0, 4, 6, 140)
    done = readout.with_rise_time(readout.cutoff_readout(sweep(spark, WORKED), ["k"])).first()
    assert done["risetime_ps"] == pytest.approx(2500)


def test_first_sample_wins_a_tie_and_rises_count(spark):
    assert both(spark, [0, 0, 0, 0, 0, 2, -2, -9, 0])["pos"] == 5
    assert both(spark, [0, 0, 0, 0, 0, 3, -2, -3, 0])["pos"] == 5


def test_last_sample_only_on_request(spark):
    levels = [0, 0, 0, 0, 0, -1, -3]
    assert both(spark, levels)["pos"] == 5
    assert both(spark, levels, include_last=True)["pos"] == 6


def test_closed_plateau(spark):
    levels = [0, 0, 1, 1, 1, -3, -9]
    assert both(spark, levels)["plateau"] == 0.5
    assert both(spark, levels, plateau_closed=True)["plateau"] == 1


def test_empty_plateau_and_missing_levels(spark):
    empty = both(spark, WORKED, fmin=100, fmax=100)
    assert empty["plateau"] is None and empty["cutoff_mhz"] is None
    assert both(spark, [None, 0, None, 0, 0, -3, None, 0])["pos"] == 5


def test_input_order_and_partitions_do_not_matter(spark):
    rows = sweep(spark, WORKED)
    shuffled = rows.orderBy(F.rand(3)).repartition(5)
    assert (readout.cutoff_readout(rows, ["k"]).collect()
            == readout.cutoff_readout(shuffled, ["k"]).collect())


def test_known_low_pass(spark):
    f0 = 317.0
    levels = [-20 * math.log10(1 + (5 * (i + 1) / f0) ** 2) for i in range(300)]
    rows = sweep(spark, levels, step=5.0)
    row = readout.cutoff_readout(rows, ["k"], digits=None).first()
    exact = f0 * math.sqrt(10 ** ((3 - row["plateau"]) / 20) - 1)
    assert abs(row["cutoff_mhz"] - exact) <= 2.5
    fitted = fits.fit_lowpass2(rows, ["k"]).first()
    assert fitted["f0_mhz"] == pytest.approx(f0, abs=1e-6)
    assert fitted["cutoff_mhz"] == 317.0 and fitted["sse"] < 1e-9


@pytest.mark.parametrize("f0", [30.0, 130.0, 900.0, 3000.0])
def test_low_pass_far_from_any_start(spark, f0):
    rows = sweep(spark, [2 - 20 * math.log10(1 + (10 * (i + 1) / f0) ** 2) for i in range(200)],
                 step=10.0)
    fitted = fits.fit_lowpass2(rows, ["k"]).first()
    assert fitted["f0_mhz"] == pytest.approx(f0, rel=1e-6)
    assert fitted["level_db"] == pytest.approx(2, abs=1e-6)


def test_rational_fit_follows_its_own_model(spark):
    import numpy as np
    f = np.arange(1, 600) * 2.0
    six = [-18.0, 1.5, 1.0, 1.2, 4.0, -0.4]
    e = np.exp(-1j * f / 1000)[None, :]
    h = six[0] + (six[1] + six[2] * e + six[3] * e**2) / (six[4] + six[5] * e**2)
    true = np.array([fits._plain(six)])
    level, slope = fits._rational(true, e)
    np.testing.assert_allclose(level, 20 * np.log10(np.abs(h)), atol=1e-12)
    np.testing.assert_allclose(fits._plain(fits._six(true)[0]), true[0], atol=1e-12)
    for i in range(4):
        nudged = true.copy()
        nudged[0, i] += 1e-6
        numeric = (fits._rational(nudged, e)[0] - level) / 1e-6
        np.testing.assert_allclose(slope[0, :, i], numeric[0], atol=1e-5)
    rows = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(
        zip(f, level[0]))], "k string, pos int, f double, a double")
    fitted = fits.fit_rational(rows, ["k"], digits=None)
    row = fitted.first()
    assert row["sse"] < 1e-6 and row["converged"]
    assert max(abs(p["a"] - level[0][p["pos"]]) for p in row["points"]) < 1e-3
    assert fits.cutoff_of_fit(fitted).first()["cutoff_mhz"] is not None


def test_three_orders_of_averaging_differ(spark):
    results = spark.createDataFrame([("a", 100.0, 3500.0), ("a", -400.0, 875.0)],
                                    "k string, cutoff_mhz double, risetime_ps double")
    a = rollup.rollup_mean_of_ratios(results, ["k"]).first()
    b = rollup.rollup_ratio_of_means(results, ["k"]).first()
    assert (a["cutoff_mhz"], a["risetime_ps"]) == (-150.0, 2187.5)
    assert (b["cutoff_mhz"], b["risetime_ps"]) == (250.0, pytest.approx(1400.0))
