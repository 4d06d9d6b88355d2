"""Bootstrap intervals: the same in every partitioning, and as wide as they should be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisweep.operators import bootstrap


def test_weights_are_poisson(spark):
    rows = spark.range(4000).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn(
        "w", bootstrap.poisson_weight(bootstrap.uniform(F.col("id"), F.col("r"))))
    found = rows.agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert found[0] == pytest.approx(1, abs=0.01) and found[1] == pytest.approx(1, abs=0.02)
    assert 5 <= found[2] <= 7
    # Neighbouring rows and replicates draw independently.
    wide = rows.groupBy("id").pivot("r", [1, 2, 3]).agg(F.first("w")).toPandas().sort_values("id")
    draws = wide[["1", "2", "3"]].to_numpy(float)
    assert np.abs(np.corrcoef(draws.T) - np.eye(3)).max() < 0.06
    assert abs(np.corrcoef(draws[1:, 0], draws[:-1, 0])[0, 1]) < 0.06


def test_interval_is_reproducible_and_fits_the_standard_error(spark):
    rows = spark.range(30_000).selectExpr(
        "if(id % 10 < 7, 'hot', if(id % 10 = 7, null, 'other')) k", "id",
        "if(id % 500 = 3, null, pow((id * 7919 % 10007) / 10007, 2)) v")
    one = bootstrap.bootstrap_mean(rows.coalesce(1), ["k"], "v", "id").orderBy("k").collect()
    many = bootstrap.bootstrap_mean(rows.repartition(13, "v"), ["k"], "v", "id").orderBy("k").collect()
    for a, b in zip(one, many):
        assert (a["k"], a["n"]) == (b["k"], b["n"])
        assert [a["low"], a["high"]] == pytest.approx([b["low"], b["high"]], rel=1e-12)
    assert [r["k"] for r in one] == [None, "hot", "other"]
    plain = {r["k"]: r for r in rows.groupBy("k").agg(F.avg("v").alias("m"), (
        F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("se")).collect()}
    for r in one:
        assert r["low"] < r["mean"] < r["high"]
        assert r["mean"] == pytest.approx(plain[r["k"]]["m"])
        assert (r["high"] - r["low"]) / (2 * 1.96 * plain[r["k"]]["se"]) == pytest.approx(1, abs=0.25)
    whole = bootstrap.bootstrap_mean(rows, [], "v", "id", replicates=20).first()
    assert whole["n"] == rows.where("v is not null").count()
    assert bootstrap.bootstrap_mean(rows.limit(0), ["k"], "v", "id").count() == 0
