"""End-to-end jobs: files in, result tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.functions.optics import with_responsivity
from lumisweep.operators.fits import cutoff_of_fit, fit_lowpass2, fit_rational_packed
from lumisweep.operators.readout import (cutoff_packed, cutoff_readout, positional_slice,
                                         unpack_sweep, with_rise_time)
from lumisweep.operators.keyed import join_values
from lumisweep.operators.resample import refractive_indices
from lumisweep.operators.rollup import (lookup_join, mean_over_repeats, part_operator_summary,
                                        rollup_mean_of_ratios, rollup_ratio_of_means,
                                        threshold_counts)
from lumisweep.operators.stackfit import (coefficient_summary, fit_layer_stack,
                                          predict_layer_stack, residual_summary)
from lumisweep.operators.sweepgrid import (level_values, tolerance_sweep, wavelength_grid,
                                           with_indices)
from lumisweep.sources.reports import (measured_with_header, report_data, report_errors,
                                       report_header, report_lines)
from lumisweep.sources.sinks import kept
from lumisweep.sources.sweeps import packed_sweeps, sweep_files
from lumisweep.sources.tables import device_lookup

SWEEP_KEYS = ["operator", "run_order", "part"]


def readout_job(spark: SparkSession, path: str, fmin: float = 8.0,
                fmax: float = 100.0) -> DataFrame:
    """Sweep files -> cut-off and rise time per file -> mean over repeats."""
    packed = packed_sweeps(sweep_files(spark, path))
    results = with_rise_time(cutoff_packed(packed, fmin=fmin, fmax=fmax), digits=1)
    return rollup_mean_of_ratios(results, SWEEP_KEYS)


def averaged_readout_job(spark: SparkSession, path: str, fmin: float = 10.0,
                         fmax: float = 25.0, max_rows: int | None = None) -> DataFrame:
    """Sweep files -> mean sweep over repeats -> cut-off -> device names.

    ``max_rows`` limits the samples of a file, for readers that stop at a row.
    """
    packed = packed_sweeps(sweep_files(spark, path), skip_foot=0, max_rows=max_rows,
                           round_after_unit=True, exclude_parts=())
    # Footer lines that fall inside the row limit have no numbers.
    rows = unpack_sweep(packed).select(*SWEEP_KEYS, "f", "a").where(
        F.col("f").isNotNull() & F.col("a").isNotNull())
    mean = mean_over_repeats(rows, SWEEP_KEYS).withColumn("pos", F.col("f"))
    found = with_rise_time(cutoff_readout(mean, SWEEP_KEYS, fmin, fmax, plateau_closed=True,
                                          include_last=True, digits=None))
    return lookup_join(found, device_lookup(spark), ["part"]).select(
        "device", *SWEEP_KEYS, "plateau", "cutoff_mhz", "risetime_ps", "ubr_V")


def lowpass_job(spark: SparkSession, path: str, lo: int = 15, hi: int = 500) -> DataFrame:
    """Sweep files -> samples ``lo`` to ``hi`` - 1 -> low-pass fit per file -> mean over repeats.

    The rise time is that of the mean absolute cut-off.  A file without samples in the
    slice has no fit and takes no part.
    """
    rows = positional_slice(unpack_sweep(packed_sweeps(sweep_files(spark, path))), lo, hi)
    fitted = fit_lowpass2(rows.select("file", *SWEEP_KEYS, "f", "a"), ["file", *SWEEP_KEYS])
    return rollup_ratio_of_means(fitted, SWEEP_KEYS)


def rational_job(spark: SparkSession, path: str, lo: int = 8, hi: int = 600, fmin: float = 8.0,
                 fmax: float = 100.0) -> DataFrame:
    """Sweep files -> rational fit per file -> cut-off of the fitted curve -> mean over repeats."""
    packed = packed_sweeps(sweep_files(spark, path)).withColumn(
        "points", F.filter("points", lambda x: (x["pos"] >= lo) & (x["pos"] < hi)))
    fitted = fit_rational_packed(packed, ["file", *SWEEP_KEYS])
    found = with_rise_time(cutoff_of_fit(fitted, fmin=fmin, fmax=fmax), digits=1)
    return rollup_mean_of_ratios(found, SWEEP_KEYS)


def comparison_job(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """Averaged readout -> summaries by part and operator, and counts by rise-time band."""
    found = averaged_readout_job(spark, path, **options)
    return {"summary": part_operator_summary(found, "part", "operator", "risetime_ps"),
            "bands": threshold_counts(found, ["part"], "risetime_ps")}


def responsivity_sweep_job(spark: SparkSession, optical: DataFrame, targets: Sequence[float],
                           tolerances: Sequence[float], levels: int, start: int, stop: int,
                           step: int, angles: Sequence[float] = (0.0,)) -> DataFrame:
    """Optical tables -> indices per wavelength -> tolerance sweep with responsivity.

    ``targets`` and ``tolerances`` are for Si, SiO2 and Si3N4 in m.
    """
    indices = refractive_indices(wavelength_grid(spark, start, stop, step), optical)
    lists = [level_values(t, d, levels) for t, d in zip(targets, tolerances)]
    lambdas = [float(v) for v in range(start, stop + 1, step)]
    sweep = tolerance_sweep(spark, *lists, lambdas=lambdas, targets=targets, angles=angles)
    return with_responsivity(with_indices(sweep, indices), tilted=tuple(angles) != (0.0,))


DEVICE_KEYS = ["path", "article_name", "fa_nr", "device_nr"]


def stack_fit_job(spark: SparkSession, path: str, optical: DataFrame,
                  **options) -> dict[str, DataFrame]:
    """Report files -> layer stack per report and device (E4); see ``fit_reports``."""
    return fit_reports(report_lines(spark, path), optical, **options)


def fit_reports(reports: DataFrame, optical: DataFrame, y: str = "empfindlichkeit",
                start: dict[str, float] | None = None,
                against: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Reports as rows of lines -> refractive indices -> layer stack -> statistics.

    ``optical`` has ``material, lambda_nm, n, k, alpha``.  Every distinct wavelength that any
    report measures is resampled once, and this dictionary is joined back to the rows.
    Reports, measured rows, dictionary and fits are read by several results and computed once
    (``kept``); this starts when the function is called.

    * ``fits``: thicknesses, ``converged``, ``sse`` and ``rmse`` per report and device
    * ``coefficients``: estimate, standard error, t and p value per parameter
    * ``curves``: measured rows with the fitted value and the residual
    * ``rejected``: ``path, reason`` of the reports that give no fit: sections missing, no
      measured value, or a fit that does not settle (these stay in ``fits`` as well)
    """
    reports = kept(reports)
    data = report_data(reports, ("wellenlange", y)).select(
        "file", "path", "pos", F.col("wellenlange").alias("lambda_nm"), F.col(y).alias("y"))
    measured = kept(measured_with_header(data, report_header(reports))
                    .where(F.col("lambda_nm").isNotNull() & F.col("y").isNotNull()))
    indices = kept(refractive_indices(measured.select("lambda_nm"), optical).withColumn(
        "n_env", F.lit(1.0)))
    fitted = kept(fit_layer_stack(measured, indices, DEVICE_KEYS, "y", start))
    curves = predict_layer_stack(measured, indices, fitted, DEVICE_KEYS, "y")
    rmse = residual_summary(curves, DEVICE_KEYS).select(*DEVICE_KEYS, "rmse")
    errors = report_errors(reports).select("path", "reason")
    empty = (reports.select("path").join(errors.select("path"), "path", "left_anti")
             .join(measured.select("path").distinct(), "path", "left_anti")
             .select("path", F.lit("no measured value").alias("reason")))
    unsettled = fitted.where(~F.col("converged")).select(
        "path", F.lit("fit does not settle").alias("reason"))
    return {"fits": join_values(fitted.drop("inverse"), rmse, DEVICE_KEYS),
            "coefficients": coefficient_summary(fitted, DEVICE_KEYS, against),
            "curves": curves,
            "rejected": errors.unionByName(empty).unionByName(unsettled)}
