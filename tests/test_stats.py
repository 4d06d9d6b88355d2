"""Quantiles, box statistics, ECDF and densities against direct formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisweep.operators import rollup, stats


def test_squares(spark):
    df = spark.createDataFrame([(1, float(i * i)) for i in range(1, 12)], "k int, v double")
    row = stats.decile_bands(df, ["k"], "v").first()
    assert (row["q_0"], row["q_10"], row["q_50"], row["q_100"]) == (1, 4, 36, 121)
    box = stats.box_stats(df, ["k"], "v").first()
    assert (box["q1"], box["median"], box["whisker_low"], box["whisker_high"]) == (12.5, 36, 1, 121)
    long = stats.bands_long(stats.decile_bands(df, ["k"], "v"), ["k"], "v")
    assert long.count() == 11


def test_peak_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame([(1, 700.0, 5.0), (1, 650.0, 5.0), (1, 600.0, None)],
                               "k int, x double, v double")
    assert stats.peak_row(df, ["k"], "v", "x").first()["x"] == 650.0


def test_density_1d_matches_the_sum_of_kernels(spark):
    values = np.random.default_rng(3).normal(10, 2, 400)
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    got = stats.kde_1d(df, ["k"], "v", cut=3.0).orderBy("x").toPandas()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
    want = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - values) / bw) ** 2).sum(1) / (
        len(values) * bw * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["density"], want, atol=2e-4 * want.max())
    assert np.trapezoid(got["density"], got["x"]) == pytest.approx(1, abs=1e-2)


def test_density_2d_matches_the_product_kernel(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, 300), rng.normal(5, 3, 300)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)],
                               "k string, x double, y double")
    got = stats.kde_2d(df, ["k"], "x", "y", 100).toPandas()
    assert len(got) == 10_000

    def width(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    hx, hy = width(x), width(y)
    some = got.iloc[::97]
    want = (np.exp(-0.5 * ((some["x"].to_numpy()[:, None] - x) / hx) ** 2)
            * np.exp(-0.5 * ((some["y"].to_numpy()[:, None] - y) / hy) ** 2)).sum(1) / (
        300 * hx * hy * 2 * np.pi)
    np.testing.assert_allclose(some["density"], want, atol=5e-3 * want.max())


def test_summary_and_bands(spark):
    df = spark.createDataFrame([("a", "p", 500.0), ("a", "q", 700.0), ("b", "p", 600.0),
                                ("b", "p", 1100.0), ("b", "q", None)],
                               "o string, part string, v double")
    rows = {(r["level"], r["part"], r["operator"]): r for r in rollup.part_operator_summary(
        df.withColumnRenamed("o", "operator"), "part", "operator", "v").collect()}
    assert rows["part", "p", None]["n"] == 3 and rows["operator", None, "b"]["mean"] == 850.0
    assert rows["part_operator", "q", "b"]["n"] == 0 and len(rows) == 8
    bands = df.select(rollup.threshold_band(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in bands] == [0, 1, 1, 3, None]


def test_rows_meet_the_grid_of_few_keys_without_a_shuffle(spark):
    n = 400
    rows = [(None if i % 2 else "a", float(i % 20), float(i * 7 % 13)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], "k string, x double, y double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found, step in ((stats.kde_1d(df.where("x IS NOT NULL"), ["k"], "x", 32), "1d"),
                            (stats.kde_2d(df, ["k"], "x", "y", 16), "2d")):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("BroadcastHashJoin") == 1, step
            sums = {r["k"]: r for r in found.groupBy("k").agg(
                F.count("*").alias("n"), F.sum("density").alias("d")).collect()}
            assert set(sums) == {None, "a"}
            assert all(r["n"] == (32 if step == "1d" else 256) and r["d"] > 0
                       for r in sums.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
