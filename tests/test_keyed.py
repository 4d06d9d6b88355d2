"""Bucketed plans against brute force, with one key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumisweep.operators import keyed, readout, stats


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    value = np.round(rng.normal(0, 5, n), 2)
    value[rng.random(n) < 0.05] = 1e6
    data = pd.DataFrame({"k": key, "o": rng.permutation(n), "v": value})
    return data, spark.createDataFrame(data)


SPLITS = {"few": [-3.0, 0.0, 2.5], "plain": [], "many": [float(x) for x in np.arange(-9, 9, 0.37)]}


@pytest.mark.parametrize("splits", SPLITS.values(), ids=SPLITS.keys())
def test_exact_quantiles(hot, splits):
    data, df = hot
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r["k"]: r for r in keyed.exact_quantiles(df, ["k"], "v", probs, splits=splits).collect()}
    assert len(got) == data["k"].nunique()
    for k, part in data.groupby("k"):
        assert got[k]["n"] == len(part)
        np.testing.assert_allclose(got[k]["quantiles"], np.quantile(part["v"], probs), rtol=1e-12)


@pytest.mark.parametrize("splits", SPLITS.values(), ids=SPLITS.keys())
def test_quantiles_leave_out_missing_values(spark, splits):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, float("nan")), (1, 3.0), (2, None)],
                               "k int, v double")
    rows = keyed.exact_quantiles(df, ["k"], "v", [0.5], splits=splits).collect()
    assert [(r["k"], r["n"], list(r["quantiles"])) for r in rows] == [(1, 2, [2.0])]


@pytest.mark.parametrize("splits", [[], [100.0, 900.0, 901.0, 2500.0]], ids=["plain", "cut"])
def test_positions_and_running_total(hot, splits):
    data, df = hot
    want = data.sort_values("o").groupby("k").cumcount().loc[data.index]
    got = keyed.dense_positions(df, ["k"], "o", splits=splits).toPandas().set_index("o")["pos"]
    assert (got.loc[data["o"]].to_numpy() == want.to_numpy()).all()
    ones = df.withColumn("one", F.lit(1))
    run = keyed.running_total(ones, ["k"], "o", "one", splits=splits).toPandas().set_index("o")
    assert (run["running"].loc[data["o"]].to_numpy() == want.to_numpy() + 1).all()


@pytest.mark.parametrize("splits", [[], [1.0, 4.0, 4.5]], ids=["plain", "cut"])
def test_asof_and_next(spark, splits):
    table = spark.createDataFrame([("a", 1.0, 10.0), ("a", 4.0, 40.0), ("b", 2.0, 7.0)],
                                  "k string, x double, y double")
    points = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 3.9), ("a", 9.0), ("b", 5.0),
                                    ("c", 1.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["y"] for r in keyed.asof_lookup(
        points, table, ["k"], "x", ["y"], splits=splits).collect()}
    assert got == {("a", 0.5): None, ("a", 1.0): 10.0, ("a", 3.9): 10.0, ("a", 9.0): 40.0,
                   ("b", 5.0): 7.0, ("c", 1.0): None}
    nxt = {(r["k"], r["x"]): r["x_next"] for r in keyed.with_next(
        table, ["k"], "x", ["y"], splits=splits).collect()}
    assert nxt == {("a", 1.0): 4.0, ("a", 4.0): None, ("b", 2.0): None}


def test_order_splits_grow_with_rows(hot, monkeypatch):
    _, df = hot
    assert keyed.order_splits(df, "v") == []
    monkeypatch.setattr(keyed, "ROWS_PER_BUCKET", 100)
    cuts = keyed.order_splits(df, "v")
    assert 10 < len(cuts) <= 31 and cuts == sorted(cuts)


def test_large_plans_give_the_same_results(hot, monkeypatch):
    """Readout, box statistics and ECDF with buckets and salts, as for large inputs."""
    data, df = hot
    sweep = df.withColumnsRenamed({"o": "pos"}).withColumn("f", F.col("pos") * 1.0)

    def results():
        return [sorted(map(tuple, frame.collect()), key=repr) for frame in (
            readout.cutoff_readout(sweep, ["k"], 100.0, 2000.0, a="v"),
            stats.box_stats(df, ["k"], "v"), stats.ecdf(df, ["k"], "v"))]

    plain = results()
    monkeypatch.setattr(keyed, "ROWS_PER_BUCKET", 50)
    assert results() == plain


def test_text_positions_spread_paths_with_a_common_start(spark):
    """One folder, names that differ at the end only; NULL and repeated texts; any cut."""
    names = spark.range(200_000).selectExpr(
        "concat('/data/measured/one/folder/report_', lpad(string(id * 7919 % 200000), 9, '0')) t",
        "id")
    splits = keyed.text_splits(names, "t", 64)
    assert 60 <= len(splits) <= 70
    sizes = [r["count"] for r in names.withColumn(
        "b", keyed.text_bucket(F.col("t"), splits)).groupBy("b").count().collect()]
    assert len(sizes) == len(splits) + 1 and max(sizes) < 3 * 200_000 / len(sizes)
    found = keyed.text_positions(names, "t", buckets=64)
    wrong = found.where(F.col("pos") != F.col("id") * 7919 % 200_000)
    assert wrong.count() == 0
    odd = spark.createDataFrame([(None,), ("b",), ("",), ("b",), ("é",), ("Z",), (None,)], "t string")
    for buckets in (1, 3, 512):
        rows = keyed.text_positions(odd, "t", buckets=buckets).orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(7))
        assert [r["t"] for r in rows] == [None, None, "", "Z", "b", "b", "é"]
    assert keyed.text_positions(odd.limit(0), "t").count() == 0
