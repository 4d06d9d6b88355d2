"""Gauge studies against a plain computation, and quantile sketches against exact ranks."""

import numpy as np
import pytest

from lumisweep.operators import gauge, sketches


def _plain(y):
    """``y`` is (parts, operators, repeats)."""
    p, o, r = y.shape
    m, a, b, c = y.mean(), y.mean((1, 2)), y.mean((0, 2)), y.mean(2)
    ss = {"part": o * r * ((a - m) ** 2).sum(), "operator": p * r * ((b - m) ** 2).sum(),
          "interaction": r * ((c - a[:, None] - b[None] + m) ** 2).sum(),
          "repeat": ((y - c[..., None]) ** 2).sum()}
    df = {"part": p - 1, "operator": o - 1, "interaction": (p - 1) * (o - 1),
          "repeat": p * o * (r - 1)}
    ms = {k: ss[k] / df[k] for k in ss}
    var = {"repeat": ms["repeat"],
           "interaction": max(0, (ms["interaction"] - ms["repeat"]) / r),
           "operator": max(0, (ms["operator"] - ms["interaction"]) / (p * r)),
           "part": max(0, (ms["part"] - ms["interaction"]) / (o * r))}
    return ss, df, var


def _rows(study, y):
    return [(study, i, j, float(v)) for i, part in enumerate(y) for j, cell in enumerate(part)
            for v in cell]


SCHEMA = "study string, part int, op int, y double"


def test_crossed_study(spark):
    rng = np.random.default_rng(0)
    y = (1e6 + rng.normal(size=(10, 1, 1)) + 0.3 * rng.normal(size=(1, 3, 1))
         + 0.2 * rng.normal(size=(10, 3, 1)) + 0.1 * rng.normal(size=(10, 3, 4)))
    flat = rng.normal(size=(5, 2, 3))                       # components below zero
    odd = [("gap", 1, 1, 1.0), ("gap", 1, 2, 2.0), ("gap", 2, 1, 1.0), ("one", 1, 1, 5.0),
           ("one", None, 1, None)]
    rows = spark.createDataFrame(_rows("a", y) + _rows("b", flat) + odd, SCHEMA)
    found = {r["study"]: r for r in gauge.crossed_study(rows, ["study"], "part", "op", "y").collect()}
    for study, values in (("a", y), ("b", flat)):
        ss, df, var = _plain(values)
        assert found[study]["balanced"]
        for k in gauge.SOURCES:
            assert found[study][f"ss_{k}"] == pytest.approx(ss[k], rel=1e-6, abs=1e-8)
            assert found[study][f"df_{k}"] == df[k]
            assert found[study][f"var_{k}"] == pytest.approx(var[k], rel=1e-6, abs=1e-8)
    for study in ("gap", "one"):
        assert not found[study]["balanced"] and found[study]["var_part"] is None
        assert found[study]["gauge_percent"] is None
    # One study over all rows, and one with a null part that is a part of its own.
    whole = gauge.crossed_study(rows.where("study = 'a'").drop("study"), [], "part", "op", "y").first()
    assert whole["ss_part"] == pytest.approx(_plain(y)[0]["part"], rel=1e-6)
    null = rows.where("study = 'a'").selectExpr("nullif(part, 3) part", "op", "y")
    assert gauge.crossed_study(null, [], "part", "op", "y").first()["df_part"] == 9
    assert gauge.crossed_study(rows.limit(0), ["study"], "part", "op", "y").count() == 0


PROBS = [0.0, 0.05, 0.5, 0.9, 1.0]


def test_sketches_merge_and_keep_their_rank_error(spark, tmp_path):
    """One key holds most rows; days are sketched alone, written, and merged when read."""
    rows = spark.range(200_000).selectExpr(
        "if(id % 10 = 0, id % 7, null) k", "id % 30 day",
        "case when id % 1000 = 0 then double('nan') when id % 999 = 0 then null "
        "else pow(rand(3), 3) end v")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    sketches.sketch_table(rows.where("day < 20"), ["k", "day"], "v").write.parquet(str(tmp_path / "s"))
    sketches.sketch_table(rows.where("day >= 20"), ["k", "day"], "v").write.mode("append").parquet(
        str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    merged = sketches.merge_sketches(kept, ["k"])
    bands = sketches.sketch_bands(merged, PROBS)
    assert bands.count() == 8 and bands.where("size(quantiles) = 5").count() == 8
    errors = sketches.rank_errors(rows.where("k is not null"), bands, ["k"], "v", PROBS).collect()
    assert len(errors) == 7 * 5 and max(r["error"] for r in errors) <= 2 * sketches.rank_error()
    hot = bands.where("k is null").first()
    values = np.array([r["v"] for r in rows.where("k is null and v is not null and not isnan(v)")
                       .collect()])
    assert hot["n"] == len(values) and hot["quantiles"][0] == values.min()
    assert abs((values < hot["quantiles"][2]).mean() - 0.5) <= 2 * sketches.rank_error()
    assert sketches.sketch_table(rows.limit(0), ["k"], "v").count() == 0
