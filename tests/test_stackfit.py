"""Stack fits, their statistics, and the job from reports to fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisweep.functions.optics import with_responsivity
from lumisweep.operators import stackfit, sweepgrid
from lumisweep.plans import jobs, views
from lumisweep.sources import reports

TRUTH = {1: (9.3, 13.0, 74.0), 2: (40.0, 16.0, 69.0), 3: (160.0, 14.0, 70.0)}
LAMBDAS = [float(v) for v in range(400, 1101, 10)]


def _curves(spark, noise=0.0):
    truth = spark.createDataFrame(
        [(k, a * 1e-6, b * 1e-9, c * 1e-9) for k, (a, b, c) in TRUTH.items()],
        "k int, thickness_si double, thickness_sio2 double, thickness_si3n4 double")
    rows = with_responsivity(views.with_material_constants(
        truth.withColumn("lambda_nm", F.explode(F.lit(LAMBDAS)))), tilted=False)
    ripple = ((F.col("k") * 37 + F.col("lambda_nm") * 101) % 97 / 97 - 0.5) * noise
    return rows.select("k", "lambda_nm", (F.col("sabs") + ripple).alias("y"))


@pytest.fixture(scope="module")
def indices(spark):
    return views.with_material_constants(sweepgrid.wavelength_grid(spark, 400, 1100, 10))


def test_slopes_are_those_of_the_model():
    lam = np.array([LAMBDAS])
    x = {"lambda_nm": lam, "n_env": 1 + 0 * lam, "n_si": 3.42 + 1.2e5 / lam**2,
         "k_si": 0.02 + 0 * lam, "alpha_si": 1e5 * np.exp((400 - lam) / 90),
         "n_sio2": 1.45 + 0 * lam, "k_sio2": 0 * lam, "n_si3n4": 2.0 + 0 * lam,
         "k_si3n4": 0.001 + 0 * lam}
    p = np.array([[10.0, 15.0, 70.0]])
    level, slope = stackfit._model(p, x)
    for i in range(3):
        up, down = p.copy(), p.copy()
        up[0, i] += 1e-4
        down[0, i] -= 1e-4
        numeric = (stackfit._model(up, x)[0] - stackfit._model(down, x)[0]) / 2e-4
        np.testing.assert_allclose(slope[..., i], numeric, atol=1e-8)


def test_fit_to_the_last_digits(spark, indices):
    curves = _curves(spark)
    odd = spark.createDataFrame([(1, 500.0, None), (1, None, 0.3), (7, 500.0, 0.3), (7, 510.0, 0.3),
                                 (None, 500.0, 0.2), (8, 123.0, 0.1)],
                                "k int, lambda_nm double, y double")
    fitted = {r["k"]: r for r in stackfit.fit_layer_stack(
        curves.union(curves).union(odd), indices, ["k"], "y").collect()}
    assert set(fitted) == {1, 2, 3, 7, None}      # 8 has no known wavelength
    for k, truth in TRUTH.items():
        r = fitted[k]
        assert r["converged"] and r["n"] == 142
        found = (r["thickness_si"] * 1e6, r["thickness_sio2"] * 1e9, r["thickness_si3n4"] * 1e9)
        assert found == pytest.approx(truth, rel=1e-8)
    assert not fitted[7]["converged"] and not fitted[None]["converged"]


def test_coefficients_match_a_dense_computation(spark, indices):
    fitted = stackfit.fit_layer_stack(_curves(spark, 0.002), indices, ["k"], "y")
    rows = {(r["k"], r["parameter"]): r
            for r in stackfit.coefficient_summary(fitted, ["k"]).collect()}
    assert len(rows) == 9
    one = {f: np.array([[r[f] for r in indices.orderBy("lambda_nm").collect()]])
           for f in stackfit._OPTICAL} | {"lambda_nm": np.array([LAMBDAS])}
    for r in fitted.collect():
        p = np.array([[r["thickness_si"] * 1e6, r["thickness_sio2"] * 1e9,
                       r["thickness_si3n4"] * 1e9]])
        slope = stackfit._model(p, one)[1][0]
        q, upper = np.linalg.qr(slope)
        spread = np.sqrt((np.linalg.inv(upper) ** 2).sum(1) * r["sse"] / 68)
        for i, name in enumerate(stackfit.PARAMETERS):
            got = rows[r["k"], name]
            assert got["df"] == 68 and got["std_error"] == pytest.approx(spread[i], rel=1e-6)
            assert got["t_value"] == pytest.approx(p[0, i] / spread[i], rel=1e-6)
    degenerate = spark.createDataFrame([(1, 500.0, 0.3)], "k int, lambda_nm double, y double")
    fitted = stackfit.fit_layer_stack(degenerate, indices, ["k"], "y")
    assert all(r["std_error"] is None and r["p_value"] is None
               for r in stackfit.coefficient_summary(fitted, ["k"]).collect())


# Two-sided p values of printed tables of Student's t.
TABLE = [(12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (3.169272673, 10, 0.01),
         (1.959963985, 10 ** 7, 0.05), (0.0, 4, 1.0), (-2.570581836, 5, 0.05),
         (0.764892328, 3, 0.5), (3.390, 120, 0.000948)]


def test_student_tail(spark):
    table = spark.createDataFrame(TABLE, "t double, df long, p double")
    for r in table.withColumn("got", stackfit.student_tail(F.col("t"), F.col("df"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-6)
    far = spark.createDataFrame([(60.0, 30), (1e5, 3)], "t double, df long")
    got = [r[0] for r in far.select(stackfit.student_tail(F.col("t"), F.col("df"))).collect()]
    assert 0 < got[0] < 1e-30 and 0 < got[1] < 1e-13


def _report(folder, name, device, rows, sections=("head", "data")):
    lines = ["[Allgemein]", "Bauteil:;AD", "Charge:;FA7", f"Bauteil-Nr.:;{device}"]
    lines += ["[Einstellungen Messung]", "NPLC:;1"]
    if "data" in sections:
        lines += ["[Messwerte]", "Kurve", "Wellenlänge [nm];Empfindlichkeit [A/W];"]
        lines += [f"{x:.1f};{y:.9f};".replace(".", ",") for x, y in rows]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_reports_to_stack_fit(spark, tmp_path):
    """Written reports with wavelengths of their own give back the planted stacks."""
    truth = spark.createDataFrame([(1, 9.5e-6, 14e-9, 72e-9), (2, 11.0e-6, 17e-9, 66e-9)],
                                  "k int, thickness_si double, thickness_sio2 double, "
                                  "thickness_si3n4 double")
    rows = truth.withColumn("step", F.explode(F.sequence(F.lit(405), F.lit(1080), F.lit(15)))
                            ).withColumn("lambda_nm", F.col("step") + F.col("k") * 2.3)
    rows = with_responsivity(views.with_material_constants(rows), tilted=False).collect()
    for k in (1, 2):
        _report(tmp_path, f"r{k}.csv", k, [(r["lambda_nm"], r["sabs"]) for r in rows if r["k"] == k])
    _report(tmp_path, "cut.csv", 3, [], ("head",))
    _report(tmp_path, "empty.csv", 4, [])
    _report(tmp_path, "short.csv", 5, [(500.0, 0.3), (600.0, 0.4)])
    found = jobs.stack_fit_job(spark, str(tmp_path), views.optical_knots(spark))
    fits = {r["device_nr"]: r for r in found["fits"].collect()}
    for r in truth.collect():
        got = fits[str(r["k"])]
        assert got["converged"] and got["n"] == 46 and got["rmse"] < 1e-8
        for c in ("thickness_si", "thickness_sio2", "thickness_si3n4"):
            assert got[c] == pytest.approx(r[c], rel=1e-5)
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in found["rejected"].collect()}
    assert reasons == {"cut.csv": "no data section", "empty.csv": "no measured value",
                       "short.csv": "fit does not settle"}
    assert found["coefficients"].where("device_nr = '1'").count() == 3
    assert found["curves"].where("abs(residual) > 1e-7 and device_nr in ('1', '2')").count() == 0


def test_reports_are_read_once_for_all_results(spark):
    """Text made by a function that counts: four results, each report read and cut once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(content):
        seen.add(1)
        return bytes(content)

    texts = [(f"x/{i}.csv", "\n".join([
        "[Allgemein]", f"Bauteil-Nr.:;{i}", "[Einstellungen Messung]", "[Messwerte]", "Kurve",
        "Wellenlänge [nm];Empfindlichkeit [A/W];", *[
            f"{400 + 20 * n},5;0,{300 + 7 * n + i};" for n in range(12)]]).encode())
        for i in range(6)]
    raw = spark.createDataFrame(texts, "path string, content binary").repartition(2)
    lines = reports.parse_report_lines(raw.select("path", counted("content").alias("content")))
    found = jobs.fit_reports(lines, views.optical_knots(spark))
    assert {name: df.count() for name, df in found.items() if name != "rejected"} == {
        "fits": 6, "coefficients": 18, "curves": 72}
    assert {r["reason"] for r in found["rejected"].collect()} <= {"fit does not settle"}
    assert seen.value == 6
