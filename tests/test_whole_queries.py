"""Queries of full length, wavelengths, levels and grid, on the whole job of a few parts."""

from pathlib import Path

import pytest
from compare import compare, connect

from lumisweep.operators import envelopes, factored
from lumisweep.plans import views
from lumisweep.plans.oracle import (ORACLE_SQL, envelope_bands_sql,
                                    envelope_one_factor_sql)
from lumisweep.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
SQL = {n: s for n, s in ORACLE_SQL.items() if n.endswith("_whole")}
# Every combination of levels, without factors.
BRUTE = {"envelope_bands_whole": envelope_bands_sql(
             views.ALL_LAMBDAS, 9, {"tol": 4, "sd_1": 1, "sd_2": 2, "sd_3": 3}),
         "envelope_one_factor_whole": envelope_one_factor_sql(views.ALL_LAMBDAS, 9)}


@pytest.fixture(scope="module")
def few_parts(spark, tmp_path_factory):
    """The smallest tables with three parts."""
    folder = tmp_path_factory.mktemp("few")
    for path in Path(SF).glob("*.parquet"):
        if path.stem != "part":
            (folder / path.name).symlink_to(path)
    table = spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").limit(3).toPandas()
    table.to_parquet(folder / "part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_whole_query_matches_sql(spark, few_parts, name):
    ok, note = compare(QUERIES[name](spark, few_parts), connect(few_parts), SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_factors_match_all_combinations(spark, few_parts, name):
    ok, note = compare(QUERIES[name](spark, few_parts), connect(few_parts), BRUTE[name])
    assert ok, note


def test_factored_sweep_makes_no_row_per_silicon_level_and_no_second_shuffle(spark, few_parts):
    bands = factored.ONE_FACTOR
    thin = factored.thin_sweep(views.stacks(spark, few_parts), ["p_partkey"], [500.0, 905.0],
                               bands, views.with_material_constants, n=9)
    assert thin.count() == 3 * 2 * 81
    found = factored.band_extremes(thin, ["p_partkey"], list(bands))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_angles_by_factors_match_the_sweep(spark, few_parts):
    bands = factored.ONE_FACTOR
    thin = factored.thin_sweep(views.stacks(spark, few_parts), ["p_partkey"], [500.0, 905.0],
                               bands, views.with_material_constants, (0.0, 25.0))
    ours = {(r["p_partkey"], r["lambda_nm"], r["angle_deg"]): r
            for r in factored.band_extremes(thin, ["p_partkey"], list(bands)).collect()}
    sweep = views.stack_responses(spark, few_parts, [500.0, 905.0], (0.0, 25.0))
    theirs = envelopes.envelope(sweep, ["p_partkey", "lambda_nm", "angle_deg"]).collect()
    assert len(ours) == len(theirs) == 12
    for row in theirs:
        mine = ours[row["p_partkey"], row["lambda_nm"], row["angle_deg"]]
        for a, b in (("target", "target_min"), ("min", "all_min"), ("max", "all_max")):
            assert row[a] == pytest.approx(mine[b], rel=1e-12)


def test_whole_queries_lose_nothing(spark, few_parts):
    def rows(name):
        return QUERIES[name](spark, few_parts).collect()

    assert {r["samples"] for r in rows("sweep_text_samples_whole")} == {1000}
    assert len(rows("positional_slice_whole")) == 3 * 485
    assert len(rows("envelope_all_whole")) == 3 * 701
    assert len(rows("target_by_angle_whole")) == 3 * 701 * len(views.ANGLES)
    assert len({r["lambda_nm"] for r in rows("peak_ecdf_whole")}) > 3


def test_whole_rational_fit_stays_near_the_curve(spark, few_parts):
    found = QUERIES["fit_rational_whole"](spark, few_parts).collect()
    assert len(found) == 3 and all(row["sse"] < 592 for row in found)   # RMS below 1 dB
