"""Registered queries: each runs one or more operators over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.functions.formatting import (clean_name_column, format_eng, format_fixed,
                                            format_si)
from lumisweep.functions.optics import layer_angle, with_responsivity
from lumisweep.functions.rounding import (decimal_comma_to_double, double_to_decimal_comma,
                                          hz_to_mhz, rise_time_ps, round_even, round_numeric)
from lumisweep.operators import (bootstrap, envelopes, factored, fits, gauge, readout, resample,
                                 rollup, sketches, stackfit, stats, sweepgrid)
from lumisweep.operators.keyed import dense_positions
from lumisweep.plans import jobs, views
from lumisweep.plans.cut_queries import CUT_QUERIES
from lumisweep.plans.views import V2_KEYS
from lumisweep.sources import reports, sinks, sweeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(CUT_QUERIES)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(name: str | Column, digits: int = 6) -> Column:
    return round_even(F.col(name) if isinstance(name, str) else name, digits)


def rounded(df: DataFrame, digits: int, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


# ------------------------------------------------------------------ ordered series

@query
def positions(spark, sf):
    """Position of each order within its supplier (the file-order position of a sample)."""
    items = views.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    items = items.groupBy("l_suppkey", "l_orderkey").agg(
        F.count("*").alias("lines"), F.max("l_extendedprice").alias("top"))
    return dense_positions(items, ["l_suppkey"], "l_orderkey")


@query
def nearest_sample(spark, sf):
    found = readout.nearest_sample(views.event_sweep(spark, sf), ["user_id"], 8.0)
    return rounded(found, 6, ["f", "distance"])


@query
def plateau_median(spark, sf):
    found = readout.plateau_level(views.event_sweep(spark, sf), ["user_id"], 8.0, 40.0)
    return rounded(found, 6, ["plateau"])


@query
def plateau_rows(spark, sf):
    return rounded(readout.plateau_rows(views.event_sweep(spark, sf), ["user_id"], 8.0, 40.0),
                   6, ["a"])


@query
def cutoff_readout_events(spark, sf):
    found = readout.cutoff_readout(views.event_sweep(spark, sf), ["user_id"], 8.0, 40.0)
    return rounded(found, 6, ["plateau"])


@query
def cutoff_readout(spark, sf):
    found = readout.cutoff_packed(views.device_sweep(spark, sf))
    return rounded(found, 6, ["plateau"])


@query
def risetime(spark, sf):
    found = readout.with_rise_time(readout.cutoff_packed(views.device_sweep(spark, sf)), digits=1)
    return found.select("p_partkey", "cutoff_mhz", "risetime_ps")


@query
def cutoff_closed_plateau(spark, sf):
    mean = rollup.mean_over_repeats(views.repeat_sweep(spark, sf), V2_KEYS).withColumns(
        {"pos": F.col("f"), "a": r("a", 9)})
    found = readout.cutoff_readout(mean, V2_KEYS, 10.0, 25.0, plateau_closed=True,
                                   include_last=True, digits=None)
    return rounded(found, 6, ["plateau", "cutoff_mhz"])


@query
def positional_slice(spark, sf):
    rows = readout.positional_slice(views.device_rows(spark, sf), 15, 50)
    return rounded(rows, 6, ["a"]).select("p_partkey", F.col("pos").cast("long").alias("pos"),
                                          "f", "a")


@query
def positional_slice_whole(spark, sf):
    """The full slice 15..499 of sweeps that are longer than it."""
    rows = readout.positional_slice(views.device_rows(spark, sf, views.WHOLE_POINTS), 15, 500)
    return rounded(rows, 6, ["a"]).select("p_partkey", F.col("pos").cast("long").alias("pos"),
                                          "f", "a")


@query
def pack_unpack(spark, sf):
    packed = readout.pack_sweep(views.event_sweep(spark, sf), ["user_id"], 10, 30)
    return rounded(readout.unpack_sweep(packed), 6, ["a"])


# ------------------------------------------------------------------ rollups

@query
def mean_over_repeats(spark, sf):
    return rounded(rollup.mean_over_repeats(views.repeat_sweep(spark, sf), V2_KEYS), 10, ["a"])


def _device_results(spark, sf):
    found = readout.cutoff_packed(views.device_sweep(spark, sf))
    return readout.with_rise_time(found, digits=1)


@query
def rollup_mean_of_ratios(spark, sf):
    found = rollup.rollup_mean_of_ratios(_device_results(spark, sf), ["p_brand", "p_size"])
    return rounded(found, 4, ["cutoff_mhz", "risetime_ps"]).withColumn(
        "p_size", F.col("p_size").cast("long"))


@query
def rollup_ratio_of_means(spark, sf):
    found = rollup.rollup_ratio_of_means(_device_results(spark, sf), ["p_brand", "p_size"])
    return rounded(found, 4, ["cutoff_mhz", "risetime_ps"]).withColumn(
        "p_size", F.col("p_size").cast("long"))


@query
def average_then_detect(spark, sf):
    keys = ["p_brand", "p_size"]
    mean = rollup.mean_over_repeats(views.device_rows(spark, sf), keys).withColumns(
        {"pos": F.col("f"), "a": r("a", 9)})
    found = readout.with_rise_time(readout.cutoff_readout(mean, keys), digits=1)
    return rounded(found, 6, ["plateau"]).select(
        "p_brand", F.col("p_size").cast("long").alias("p_size"), "plateau", "cutoff_mhz",
        "risetime_ps")


@query
def device_lookup(spark, sf):
    supplier = views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("part"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    nation = views.table(spark, sf, "nation").select("n_nationkey", "n_name")
    runs = rollup.distinct_runs(views.repeat_sweep(spark, sf), V2_KEYS)
    named = rollup.lookup_join(rollup.lookup_join(runs, supplier, ["part"]), nation,
                               ["n_nationkey"])
    return named.select(*V2_KEYS, "s_name", "n_name")


@query
def attach_identity(spark, sf):
    items = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_quantity").alias("f"))
    identity = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("operator"))
    joined = rollup.attach_identity(items, identity)
    return joined.groupBy("operator").agg(F.count("*").alias("samples"), F.sum("f").alias("sum_f"))


@query
def parts_excluded(spark, sf):
    kept = rollup.exclude_parts(views.repeat_sweep(spark, sf))
    return kept.groupBy("part").agg(F.count("*").alias("samples"))


@query
def distinct_runs(spark, sf):
    return rollup.distinct_runs(views.repeat_sweep(spark, sf), V2_KEYS)


@query
def part_operator_summary(spark, sf):
    items = views.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("part"), F.col("l_returnflag").alias("operator"),
        F.col("l_extendedprice").alias("value"))
    found = rollup.part_operator_summary(items, "part", "operator", "value")
    return rounded(found, 4, ["mean", "sd"])


@query
def threshold_bands(spark, sf):
    return rollup.threshold_counts(_device_results(spark, sf), ["p_brand"], "risetime_ps").select(
        "p_brand", F.col("band").cast("long").alias("band"), "n")


@query
def mean_curve_ci(spark, sf):
    found = rollup.mean_curve(views.repeat_sweep(spark, sf), ["part"], "f", "a")
    return rounded(found, 6, ["mean", "sd", "ci_low", "ci_high"])


# ------------------------------------------------------------------ names, text, files

@query
def parse_names(spark, sf):
    name = F.concat(F.col("l_returnflag"), F.lit("OP_RO"), F.col("l_suppkey").cast("string"),
                    F.lit("_part"), F.col("l_linenumber").cast("string"), F.lit("_"),
                    F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.lit(".CSV"))
    named = views.table(spark, sf, "lineitem").select(name.alias("file")).withColumns(
        sweeps.parse_sweep_name(F.col("file")))
    return named.groupBy("operator", "run_order", "part", "repeat").agg(
        F.count("*").alias("files")).withColumns(
        {c: F.col(c).cast("long") for c in ("run_order", "part")})


@query
def decimal_comma_roundtrip(spark, sf):
    text = double_to_decimal_comma(F.col("o_totalprice"))
    return views.table(spark, sf, "orders").select("o_orderkey", text.alias("text")).withColumn(
        "value", decimal_comma_to_double(F.col("text")))


@query
def decimal_comma_exact(spark, sf):
    """Numbers of all sizes keep their value through the text, which has no exponent (K1)."""
    scale = F.get(F.lit(views.POWERS), (F.col("o_orderkey") % len(views.POWERS)).cast("int"))
    rows = views.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * scale).alias("number"))
    text = double_to_decimal_comma(F.col("number"))
    return rows.select("o_orderkey", "number",
                       (decimal_comma_to_double(text) == F.col("number")).alias("same"),
                       text.rlike(r"^-?\d+,\d+$").alias("fixed_notation"))


@query
def sweep_text_readout(spark, sf):
    """Instrument files of all parts: parsed, excluded parts dropped, read out."""
    files = views.sweep_texts(spark, sf).withColumns(sweeps.parse_sweep_name(F.col("file")))
    found = readout.with_rise_time(readout.cutoff_packed(sweeps.packed_sweeps(files)), digits=1)
    return found.select("operator", F.col("run_order").cast("long").alias("run_order"),
                        F.col("part").cast("long").alias("part"), "repeat",
                        r("plateau", 6).alias("plateau"), "cutoff_mhz", "risetime_ps")


@query
def sweep_text_samples(spark, sf):
    """The first 150 samples of the same files, per file (L2, with its row limit)."""
    files = views.sweep_texts(spark, sf).withColumns(sweeps.parse_sweep_name(F.col("file")))
    rows = sweeps.sweep_samples(files, skip_foot=0, max_rows=150, round_after_unit=True,
                                exclude_parts=())
    return rows.groupBy("file").agg(F.count("a").alias("samples"), F.max("f").alias("f_max"),
                                    r(F.sum("a"), 3).alias("a_sum"))


@query
def sweep_text_samples_whole(spark, sf):
    """All samples of instrument files of full length, per file."""
    files = views.sweep_texts(spark, sf, views.WHOLE_POINTS).withColumns(
        sweeps.parse_sweep_name(F.col("file")))
    rows = sweeps.sweep_samples(files, round_after_unit=True, exclude_parts=())
    return rows.groupBy("file").agg(F.count("a").alias("samples"), F.max("f").alias("f_max"),
                                    r(F.sum("a"), 3).alias("a_sum"))


@query
def report_header_recipe(spark, sf):
    lines = reports.parse_report_lines(views.report_texts(spark, sf))
    return reports.report_header(lines).join(
        reports.report_recipe(lines).drop("file"), "path").drop("file")


@query
def report_measured(spark, sf):
    lines = reports.parse_report_lines(views.report_texts(spark, sf))
    rows = reports.measured_with_header(reports.report_data(lines), reports.report_header(lines))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), "wellenlange",
                       "empfindlichkeit", "article_name", "fa_nr", "device_nr")


@query
def report_header_ids(spark, sf):
    lines = reports.parse_report_lines(views.report_texts(spark, sf))
    return reports.header_ids(lines).withColumn("header_id", F.col("header_id").cast("long"))


@query
def clean_name_values(spark, sf):
    raw = F.concat(F.initcap("p_type"), F.lit(" "), F.col("p_name"), F.lit("-Größe"), F.lit(" ["),
                   F.col("p_size").cast("string"), F.lit("]"))
    return views.table(spark, sf, "part").select(
        "p_partkey", clean_name_column(raw).alias("name"))


@query
def number_formats(spark, sf):
    price = F.col("o_totalprice")
    return views.table(spark, sf, "orders").select(
        "o_orderkey", format_eng(price / 7).alias("eng"), format_si(price, "Hz").alias("si"),
        format_fixed(price / 1e6, 4).alias("fixed"))


@query
def unit_and_rounding(spark, sf):
    orders = views.table(spark, sf, "orders").select(
        "o_orderkey", hz_to_mhz(F.col("o_totalprice") * 1000).alias("mhz"),
        (F.col("o_totalprice") / 7).alias("seventh"))
    return round_numeric(orders, 4).withColumn(
        "risetime_ps", round_even(rise_time_ps(F.col("mhz")), 1))


# ------------------------------------------------------------------ layer stacks

@query
def tolerance_sweep(spark, sf):
    sweep = views.stack_responses(spark, sf)
    return rounded(sweep.groupBy("p_partkey").agg(
        F.count("*").alias("n"), F.sum("combo").alias("combos"), F.avg("sabs").alias("sabs_mean"),
        F.avg("r").alias("r_mean"), F.avg("absorption").alias("absorption_mean"),
        F.max("quantum_eff").alias("qe_max"), F.avg("thickness_si").alias("si_mean")),
        7, ["sabs_mean", "r_mean", "absorption_mean", "qe_max"]).withColumn(
        "si_mean", r(F.col("si_mean") * 1e6, 6))


@query
def reflectance_grid(spark, sf):
    sweep = views.stack_responses(spark, sf, views.FEW_LAMBDAS, views.ANGLES)
    inside = layer_angle(F.col("n_env"), F.col("angle_deg"), F.col("n_si"))
    return rounded(sweep.groupBy("p_partkey", "angle_deg").agg(
        F.avg("r_te").alias("r_te"), F.avg("r_tm").alias("r_tm"), F.avg("r").alias("r"),
        F.avg("t_te").alias("t_te"), F.avg("t_tm").alias("t_tm"), F.avg("t").alias("t"),
        F.max(inside).alias("angle_si")),
        7, ["r_te", "r_tm", "r", "t_te", "t_tm", "t", "angle_si"])


@query
def absorption_sweep(spark, sf):
    """Absorption of the parts' alpha over all thickness decades, at four wavelengths."""
    base = views.with_material_constants(views.stacks(spark, sf).select("p_partkey").withColumn(
        "lambda_nm", F.explode(F.lit([660.0, 905.0, 940.0, 1064.0])))).select(
        "p_partkey", "lambda_nm", (F.col("alpha_si") * (1 + F.col("p_partkey") % 5)).alias(
            "alpha_si"))
    sweep = sweepgrid.absorption_sweep(base, sweepgrid.thickness_decades())
    return rounded(sweep.groupBy("p_partkey", "lambda_nm").agg(
        F.count("*").alias("n"), F.sum("absorption").alias("total")), 5, ["total"])


@query
def envelope_all(spark, sf):
    sweep = views.stack_responses(spark, sf)
    return rounded(envelopes.envelope(sweep, ["p_partkey", "lambda_nm"]), 7,
                   ["target", "min", "max"])


def _extremes(sets, bands, value="sabs", n=3, angles=(0.0,)):
    """Extremes of all sets of equal stacks at all wavelengths, from the factors of the sweep."""
    sets = sets.withColumns({f"_{c}": F.col(c) for c in sweepgrid.GEOMETRY})
    keys = [*sweepgrid.ALIKE, *[f"_{c}" for c in sweepgrid.GEOMETRY]]
    thin = factored.thin_sweep(sets, keys, views.ALL_LAMBDAS, bands,
                               views.with_material_constants, angles, n, dealt=sweepgrid.ALIKE)
    found = factored.band_extremes(thin, keys, list(bands), value)
    return factored.over_stacks(found, [*sweepgrid.ALIKE, "lambda_nm", "angle_deg"], list(bands))


def _brand_extremes(spark, sf, bands, value="sabs"):
    """Extremes per brand and wavelength, nine levels."""
    layers = F.array(F.struct(*sweepgrid.GEOMETRY)).alias("_layers")
    stacks = views.stacks(spark, sf).select("p_brand", layers).distinct()
    members, sets = sweepgrid.alike(stacks, ["p_brand"])
    found = sweepgrid.for_members(_extremes(sets, bands, value, n=9), members)
    found = factored.over_stacks(found, ["p_brand", "lambda_nm"], list(bands))
    return rounded(found, 7, [f"{b}_{e}" for b in bands for e in ("min", "max")])


@query
def envelope_all_whole(spark, sf):
    bands = {b: factored.ONE_FACTOR[b] for b in ("target", "all")}
    members, sets = sweepgrid.alike(
        sweepgrid.layers_of(views.stacks(spark, sf), ["p_partkey"]), ["p_partkey"])
    return sweepgrid.for_members(_extremes(sets, bands), members).select(
        "p_partkey", "lambda_nm", r("target_max", 7).alias("target"),
        r("all_min", 7).alias("min"), r("all_max", 7).alias("max"))


@query
def envelope_one_factor_whole(spark, sf):
    """All wavelengths, nine levels: the target curve and one free factor at a time."""
    return _brand_extremes(spark, sf, factored.ONE_FACTOR)


@query
def envelope_one_factor(spark, sf):
    sweep = views.stack_responses(spark, sf)
    return rounded(envelopes.envelope_one_factor(sweep, ["p_brand", "lambda_nm"]), 7,
                   ["min", "max"])


def _bands(spark, sf, lambdas, n):
    stacks = views.stacks(spark, sf)
    for layer in sweepgrid.LAYERS:
        stacks = stacks.withColumn(f"middle_{layer}", F.col(f"target_{layer}"))
    keys = ["p_partkey", "p_brand", *[f"middle_{x}" for x in sweepgrid.LAYERS]]
    sweep = sweepgrid.stack_sweep(stacks, keys, lambdas, n=n)
    sweep = with_responsivity(views.with_material_constants(sweep), tilted=False)
    middle = {x: F.col(f"middle_{x}") for x in sweepgrid.LAYERS}
    tolerance = {"si": 1.5e-6, "sio2": 5e-9, "si3n4": 5e-9}
    bands = {"tol": envelopes.within(middle, {x: F.lit(t) for x, t in tolerance.items()})}
    for k in (1, 2, 3):
        bands[f"sd_{k}"] = envelopes.within(
            middle, {x: F.lit(k * t / 4) for x, t in tolerance.items()})
    found = envelopes.envelope_bands(sweep, ["p_brand", "lambda_nm"], bands)
    return rounded(found, 7, [f"{b}_{e}" for b in bands for e in ("min", "max")])


@query
def envelope_bands(spark, sf):
    return _bands(spark, sf, views.FEW_LAMBDAS, 5)


@query
def envelope_bands_whole(spark, sf):
    """Nine levels, a quarter of the tolerance apart, tell all four bands from each other."""
    tolerance = {"si": 1.5e-6, "sio2": 5e-9, "si3n4": 5e-9}
    bands = {"tol": {x: factored.within(t) for x, t in tolerance.items()}}
    for k in (1, 2, 3):
        bands[f"sd_{k}"] = {x: factored.within(k * t / 4) for x, t in tolerance.items()}
    return _brand_extremes(spark, sf, bands, "r")


@query
def envelope_by_angle(spark, sf):
    sweep = views.stack_responses(spark, sf, views.FEW_LAMBDAS, views.ANGLES)
    return rounded(envelopes.envelope(sweep, ["p_brand", "angle_deg"]), 7,
                   ["target", "min", "max"])


@query
def target_by_angle(spark, sf):
    sweep = views.stack_responses(spark, sf, [905.0], views.ANGLES)
    rows = envelopes.targets_with_envelope_by_angle(sweep)
    return rounded(rows.select("angle_deg", "p_partkey", "sabs", "min", "max"), 7,
                   ["sabs", "min", "max"])


@query
def target_by_angle_whole(spark, sf):
    layers = F.array(F.struct(*sweepgrid.GEOMETRY)).alias("_layers")
    members, sets = sweepgrid.alike(
        views.stacks(spark, sf).select("p_partkey", layers), ["p_partkey"])
    bounds = factored.over_stacks(_extremes(sets, {"all": {}}, angles=views.ANGLES),
                                  ["angle_deg"], ["all"]).withColumnsRenamed(
        {"all_min": "min", "all_max": "max"})
    target = sets.withColumns({f"tolerance_{x}": F.lit(0.0) for x in sweepgrid.LAYERS})
    sweep = sweepgrid.stack_sweep(target, sweepgrid.ALIKE, views.ALL_LAMBDAS, views.ANGLES)
    sweep = with_responsivity(views.with_material_constants(sweep))
    targets = sweep.select(*sweepgrid.ALIKE, "angle_deg", "lambda_nm", "sabs")
    rows = sweepgrid.for_members(envelopes.with_angle_bounds(targets, bounds), members)
    return rounded(rows.select("angle_deg", "p_partkey", "lambda_nm", "sabs", "min", "max"), 7,
                   ["sabs", "min", "max"])


@query
def point_table(spark, sf):
    sweep = views.stack_responses(spark, sf, views.FEW_LAMBDAS)
    return envelopes.point_table(envelopes.envelope(
        sweep, ["p_partkey", "lambda_nm"], "r"), 1064.0)


# ------------------------------------------------------------------ distributions

@query
def decile_bands(spark, sf):
    items = views.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    bands = stats.decile_bands(items, ["l_quantity"], "l_extendedprice")
    return rounded(bands, 4, [c for c in bands.columns if c != "l_quantity"])


@query
def decile_bands_sweep(spark, sf):
    bands = stats.decile_bands(views.stack_responses(spark, sf, views.FEW_LAMBDAS),
                               ["lambda_nm"], "sabs")
    return rounded(bands, 6, [c for c in bands.columns if c != "lambda_nm"])


@query
def decile_bands_long(spark, sf):
    items = views.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    bands = stats.decile_bands(items, ["l_quantity"], "l_extendedprice")
    return rounded(stats.bands_long(bands, ["l_quantity"], "value"), 4, ["value"])


def _peaks(spark, sf, lambdas=views.LAMBDAS):
    """Peaks of each set of equal stacks, and the stacks of the sets."""
    members, sets = sweepgrid.alike(
        sweepgrid.layers_of(views.stacks(spark, sf), ["p_partkey"]), ["p_partkey"])
    sweep = with_responsivity(views.with_material_constants(
        sweepgrid.stack_sweep(sets, sweepgrid.ALIKE, lambdas)), tilted=False)
    # A coarser responsivity settles ties between wavelengths the same way everywhere.
    sweep = sweep.withColumn("sabs", r("sabs", 7))
    return stats.peak_row(sweep, [*sweepgrid.ALIKE, "combo"], "sabs", "lambda_nm",
                          ["thickness_si"]), members


def _peaks_by_part(spark, sf, lambdas):
    peaks, members = _peaks(spark, sf, lambdas)
    found = peaks.groupBy(*sweepgrid.ALIKE).agg(
        F.count("*").alias("combos"), F.min("lambda_nm").alias("lambda_min"),
        F.max("lambda_nm").alias("lambda_max"), F.sum("lambda_nm").alias("lambda_sum"),
        F.sum("sabs").alias("sabs_sum"))
    return rounded(sweepgrid.for_members(found, members).select(
        "p_partkey", *found.columns[len(sweepgrid.ALIKE):]), 7, ["sabs_sum"])


@query
def peak_row(spark, sf):
    return _peaks_by_part(spark, sf, views.LAMBDAS)


@query
def peak_row_whole(spark, sf):
    return _peaks_by_part(spark, sf, views.ALL_LAMBDAS)


@query
def peak_summary(spark, sf):
    found = stats.summary_table(sweepgrid.for_members(*_peaks(spark, sf)), ["lambda_nm", "sabs"])
    return rounded(found, 10, [c for c in found.columns if c != "column"])


@query
def peak_ecdf(spark, sf):
    return rounded(stats.ecdf(sweepgrid.for_members(*_peaks(spark, sf)), [], "lambda_nm"), 8,
                   ["ecdf"])


@query
def peak_ecdf_whole(spark, sf):
    peaks = sweepgrid.for_members(*_peaks(spark, sf, views.ALL_LAMBDAS))
    return rounded(stats.ecdf(peaks, [], "lambda_nm"), 8, ["ecdf"])


@query
def value_ecdf(spark, sf):
    events = views.table(spark, sf, "events").select("event_type", "value")
    return rounded(stats.ecdf(events, ["event_type"], "value"), 8, ["ecdf"])


@query
def box_stats(spark, sf):
    items = views.table(spark, sf, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") * F.col("l_discount")).alias("value"))
    items = rounded(items, 4, ["value"])
    found = stats.box_stats(items, ["l_quantity"], "value")
    return rounded(found, 8, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query
def kde_1d(spark, sf):
    events = views.table(spark, sf, "events").select("event_type", "value")
    return rounded(stats.kde_1d(events, ["event_type"], "value"), 7, ["x", "density"])


@query
def kde_2d(spark, sf):
    items = views.table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_quantity") + F.col("l_discount") * 10).alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(stats.kde_2d(items, ["l_returnflag"], "x", "y", 50), 8, ["x", "y", "density"])


@query
def kde_2d_whole(spark, sf):
    """The same on the operator's own grid."""
    items = views.table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_quantity") + F.col("l_discount") * 10).alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(stats.kde_2d(items, ["l_returnflag"], "x", "y"), 8, ["x", "y", "density"])


# ------------------------------------------------------------------ interpolation and fits

def _knots(spark, sf):
    items = views.table(spark, sf, "lineitem")
    return items.groupBy("l_suppkey", F.col("l_quantity").alias("x")).agg(
        r(F.avg("l_extendedprice") / 1e4, 6).alias("y"))


def _points(spark, sf):
    keys = views.table(spark, sf, "lineitem").select("l_suppkey").distinct()
    return keys.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(101)))).withColumn(
        "x", F.col("x") / 2)


@query
def linear_segments(spark, sf):
    found = resample.linear_segments(views.event_sweep(spark, sf), ["user_id"], "f", "a")
    return rounded(found, 6, ["a", "a_next", "slope"])


@query
def interpolate_linear(spark, sf):
    found = resample.interpolate_linear(_points(spark, sf), _knots(spark, sf), ["l_suppkey"],
                                        "x", "y")
    return rounded(found, 6, ["y"])


@query
def spline_resample(spark, sf):
    found = resample.spline_resample(_points(spark, sf), _knots(spark, sf), ["l_suppkey"], "x",
                                     ["y"])
    return rounded(found, 6, ["y"])


@query
def fit_lowpass2(spark, sf):
    found = fits.fit_lowpass2(views.device_rows(spark, sf), ["p_partkey"])
    return rounded(found, 4, ["f0_mhz", "level_db", "sse"])


@query
def fit_layer_stack(spark, sf):
    fitted = stackfit.fit_layer_stack(views.measured_curves(spark, sf),
                                  views.measured_indices(spark), ["p_partkey"], "y")
    return fitted.select("p_partkey", "converged", r(F.col("thickness_si") * 1e6, 4).alias("si_um"),
                         r(F.col("thickness_sio2") * 1e9, 3).alias("sio2_nm"),
                         r(F.col("thickness_si3n4") * 1e9, 3).alias("si3n4_nm"))


@query
def fit_lowpass2_wide(spark, sf):
    """Poles over five decades are found, and the fit says so."""
    curves = views.wide_poles(spark, sf)
    truth = views.order_poles(spark, sf).distinct().hint("shuffle_hash")
    found = fits.fit_lowpass2(curves, ["o_orderkey"]).join(truth, "o_orderkey")
    return found.select("o_orderkey", r(F.col("f0_mhz") / F.col("f0"), 3).alias("ratio"),
                        r(F.col("level_db") - F.col("level"), 4).alias("level_error"),
                        (F.col("sse") >= 0).alias("positive"), "converged")


@query
def fit_layer_stack_wide(spark, sf):
    """Stacks from 5 to 380 um are found, and the fit says so."""
    curves = views.wide_stacks(spark, sf)
    truth = views.part_depths(spark, sf).select(
        "p_partkey", F.col("thickness_si").alias("d")).distinct().hint("shuffle_hash")
    found = stackfit.fit_layer_stack(curves, views.measured_indices(spark), ["p_partkey"], "y")
    return found.join(truth, "p_partkey").select(
        "p_partkey", r(F.col("thickness_si") / F.col("d"), 3).alias("ratio"), "converged")


@query
def fit_residuals(spark, sf):
    curves = views.measured_curves(spark, sf)
    indices = views.measured_indices(spark)
    fitted = stackfit.fit_layer_stack(curves, indices, ["p_partkey"], "y")
    predicted = stackfit.predict_layer_stack(curves, indices, fitted, ["p_partkey"], "y")
    return rounded(stackfit.residual_summary(predicted, ["p_partkey"]), 7, ["sse", "rmse"])


@query
def fit_rational(spark, sf):
    packed = views.device_sweep(spark, sf).withColumn(
        "points", F.filter("points", lambda x: (x["pos"] >= 8) & (x["pos"] < 600)))
    fitted = fits.fit_rational_packed(packed, ["p_partkey"])
    return fits.cutoff_of_fit(fitted).select("p_partkey", "sse", "plateau", "cutoff_mhz")


@query
def fit_rational_whole(spark, sf):
    """The full slice 8..599 of sweeps that are longer than it."""
    packed = views.device_sweep(spark, sf, views.WHOLE_POINTS).withColumn(
        "points", F.filter("points", lambda x: (x["pos"] >= 8) & (x["pos"] < 600)))
    fitted = fits.fit_rational_packed(packed, ["p_partkey"])
    return fits.cutoff_of_fit(fitted).select("p_partkey", "sse", "plateau", "cutoff_mhz")


def _stack_reports(spark, sf):
    """Reports of all parts, fitted; the coefficients are tested against the nominal stack."""
    lines = reports.parse_report_lines(views.stack_report_texts(spark, sf))
    return jobs.fit_reports(lines, views.optical_knots(spark), against=stackfit.STACK_START)


@query
def stack_fit_reports(spark, sf):
    """Reports to layer stacks: own wavelengths, indices resampled once per wavelength."""
    return _stack_reports(spark, sf)["fits"].select(
        "path", "device_nr", "fa_nr", "article_name", "n", "converged",
        r(F.col("thickness_si") * 1e6, 4).alias("si_um"),
        r(F.col("thickness_sio2") * 1e9, 3).alias("sio2_nm"),
        r(F.col("thickness_si3n4") * 1e9, 3).alias("si3n4_nm"), r("rmse", 8).alias("rmse"))


@query
def stack_fit_coefficients(spark, sf):
    """Standard error, t and p value of each thickness against its nominal value."""
    found = _stack_reports(spark, sf)["coefficients"]
    return found.select("device_nr", "parameter", r("estimate", 3).alias("estimate"),
                        r("std_error", 5).alias("std_error"), r("t_value", 2).alias("t_value"),
                        r("p_value", 5).alias("p_value"), r("residual_sd", 8).alias("residual_sd"),
                        F.col("df").cast("long").alias("df"))


@query
def stack_fit_rejected(spark, sf):
    return _stack_reports(spark, sf)["rejected"]


@query
def fit_rational_certified(spark, sf):
    """Every fit of the full slice is stationary, by sums recomputed from its coefficients."""
    packed = views.device_sweep(spark, sf, views.WHOLE_POINTS).withColumn(
        "points", F.filter("points", lambda x: (x["pos"] >= 8) & (x["pos"] < 600)))
    # Read by the proof and by the result: fitted once.
    fitted = sinks.kept(fits.fit_rational_packed(packed, ["p_partkey"], digits=None).drop("points"))
    # The proof leaves out the NULL row of an empty sweep.  A plain ``inline`` adds a filter on the
    # number of samples, which is pushed to the tasks that read the parts and makes them all there.
    samples = packed.select("p_partkey", F.inline_outer("points"))
    proof = fits.rational_certificate(samples, fitted, ["p_partkey"])
    found = fitted.select("p_partkey", F.col("sse").alias("fit_sse"), "converged")
    return proof.join(found, "p_partkey").select(
        "p_partkey", "n", "converged", (F.col("slant") < 1e-5).alias("stationary"),
        (F.abs(F.col("sse") - F.col("fit_sse")) < 1e-7 * F.col("fit_sse")).alias("same_sse"))


@query
def gauge_study(spark, sf):
    """Crossed study per brand: its parts, three operators, four repeats each."""
    rows = views.gauge_rows(spark, sf)
    found = gauge.crossed_study(rows, ["p_brand"], "p_partkey", "operator", "value")
    numbers = [c for c in found.columns if c.startswith(("ss_", "var_"))]
    return rounded(found, 6, numbers).withColumn("gauge_percent", r("gauge_percent", 4))


SKETCH_PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query
def sketch_bands(spark, sf):
    """Bands per return flag from sketches kept per flag and ship month: true rank errors."""
    rows = views.table(spark, sf, "lineitem").select(
        "l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice")
    kept = sketches.sketch_table(rows, ["l_returnflag", "month"], "l_extendedprice")
    bands = sketches.sketch_bands(sketches.merge_sketches(kept, ["l_returnflag"]), SKETCH_PROBS)
    errors = sketches.rank_errors(rows, bands, ["l_returnflag"], "l_extendedprice", SKETCH_PROBS)
    # Twice the stated error, which holds 99 times of 100.
    return errors.select("l_returnflag", "prob", "n",
                         (F.col("error") <= 2 * sketches.rank_error()).alias("within"))


@query
def mean_bootstrap_ci(spark, sf):
    """Mean price per line status and return flag with a bootstrap interval over its rows."""
    rows = views.table(spark, sf, "lineitem").select(
        "l_linestatus", "l_returnflag", "l_extendedprice",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    found = bootstrap.bootstrap_mean(rows, ["l_linestatus", "l_returnflag"], "l_extendedprice", "row",
                                     replicates=100)
    return rounded(found, 4, ["mean", "low", "high"])
