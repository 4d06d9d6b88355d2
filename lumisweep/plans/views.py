"""Measurement-like views over the driver tables.

* V1 event sweep: one sweep per user, position in event order, amplitude from the value
* V2 repeat sweep: several line items per (return flag, status, supplier, quantity)
* V3 device sweep: one packed sweep per part with a known pole frequency
* stacks: one layer stack per part with targets and tolerances
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.functions.optics import with_responsivity
from lumisweep.functions.rounding import round_even
from lumisweep.operators.keyed import dense_positions
from lumisweep.operators.sweepgrid import spread, stack_sweep, wavelength_grid

DEVICE_POINTS = 200
#: Samples per sweep and wavelengths of the queries named ``*_whole``; their sweeps end at the
#: same frequency, since the rational model repeats itself beyond 3 GHz.
WHOLE_POINTS = 1000
ALL_LAMBDAS = [float(v) for v in range(400, 1101)]
LAMBDAS = [float(v) for v in range(400, 1101, 50)]
FEW_LAMBDAS = [500.0, 660.0, 800.0, 905.0, 1064.0]
ANGLES = (0.0, 15.0, 30.0)
#: Powers of ten that take a price from about 1e-22 to 1e22.
POWERS = [float(f"1e{n}") for n in range(-26, 17)]
MEASURED_LAMBDAS = [float(v) for v in range(400, 1101, 25)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: ``user_id, pos, f, a``."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    placed = dense_positions(events, ["user_id"], "event_id")
    return placed.select("user_id", "pos", (F.col("pos") + 1).cast("double").alias("f"),
                         (F.col("value") / 10).alias("a"))


V2_KEYS = ["operator", "run", "part"]


def repeat_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: ``operator, run, part, f, a`` with repeats at each f."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("operator"), F.col("l_linestatus").alias("run"),
        F.col("l_suppkey").alias("part"), F.col("l_quantity").alias("f"),
        (F.col("l_extendedprice") / 10000).alias("a"))


def _device_level(i: Column, points: int) -> tuple[Column, Column]:
    """Frequency and level of sample ``i`` of a part: a known pole plus a small ripple."""
    f = (10 * DEVICE_POINTS // points * i).cast("double")
    f0 = F.lit(200.0) + 5 * F.col("p_size")
    ripple = ((F.col("p_partkey") * 37 + i * 101) % 97 / F.lit(97.0) - 0.5) * 0.1
    return f, F.lit(-20.0) * F.log10(1 + F.pow(f / f0, 2)) + ripple


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, spread over the tasks ahead of the fan-out to samples."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"),
                  ["p_partkey"])


def device_sweep(spark: SparkSession, sf_dir: str,
                 points: int = DEVICE_POINTS) -> DataFrame:
    """V3, packed: ``p_partkey, p_brand, p_size, points``."""
    def point(i: Column) -> Column:
        f, a = _device_level(i, points)
        return F.struct((i - 1).alias("pos"), f.alias("f"), a.alias("a"))

    return _parts(spark, sf_dir).withColumn("points", F.transform(
        F.sequence(F.lit(1), F.lit(points)), point))


def device_rows(spark: SparkSession, sf_dir: str, points: int = DEVICE_POINTS) -> DataFrame:
    """V3, one row per sample."""
    f, a = _device_level(F.col("_i"), points)
    rows = _parts(spark, sf_dir).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.lit(points))))
    return rows.select("p_partkey", "p_brand", "p_size", (F.col("_i") - 1).alias("pos"),
                       f.alias("f"), a.alias("a"))


def with_material_constants(df: DataFrame) -> DataFrame:
    """Smooth index curves that resemble the three materials, as columns of the wavelength."""
    lam = F.col("lambda_nm")
    return df.withColumns({
        "n_env": F.lit(1.0),
        "n_si": 3.42 + 120000.0 / (lam * lam),
        "alpha_si": 100000.0 * F.exp(-(lam - 400.0) / 90.0),
        "n_sio2": 1.448 + 3540.0 / (lam * lam), "k_sio2": F.lit(0.0),
        "n_si3n4": 1.98 + 14000.0 / (lam * lam),
        "k_si3n4": 0.002 * F.exp(-(lam - 400.0) / 50.0),
    }).withColumn("k_si", F.col("alpha_si") * lam * 1e-7 / (4 * F.pi()))


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack per part, targets and tolerances in m."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand",
        ((80 + F.col("p_size")) * 1e-7).alias("target_si"), F.lit(1.5e-6).alias("tolerance_si"),
        ((12 + key % 7) * 1e-9).alias("target_sio2"), F.lit(5e-9).alias("tolerance_sio2"),
        ((60 + key % 11) * 1e-9).alias("target_si3n4"), F.lit(5e-9).alias("tolerance_si3n4"))


def stack_responses(spark: SparkSession, sf_dir: str, lambdas: Sequence[float] = LAMBDAS,
                    angles: Sequence[float] = (0.0,), n: int = 3,
                    keys: Sequence[str] = ("p_partkey", "p_brand")) -> DataFrame:
    """Tolerance sweep of all stacks with reflectance and responsivity."""
    sweep = stack_sweep(stacks(spark, sf_dir), list(keys), lambdas, angles, n)
    return with_responsivity(with_material_constants(sweep),
                             tilted=tuple(angles) != (0.0,))


def measured_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One responsivity curve per part: a stack off the start values, with a small ripple."""
    key = F.col("p_partkey")
    parts = spread(table(spark, sf_dir, "part").select(
        "p_partkey",
        ((95 + F.col("p_size") % 11) * 1e-7).alias("thickness_si"),
        ((13 + key % 5) * 1e-9).alias("thickness_sio2"),
        ((67 + key % 7) * 1e-9).alias("thickness_si3n4")), ["p_partkey"])
    rows = parts.withColumn("lambda_nm", F.explode(F.lit(MEASURED_LAMBDAS)))
    rows = with_responsivity(with_material_constants(rows), tilted=False)
    ripple = ((key * 37 + F.col("lambda_nm").cast("int") * 101) % 97 / F.lit(97.0) - 0.5) * 0.002
    return rows.select("p_partkey", "lambda_nm", round_even(F.col("sabs") + ripple, 9).alias("y"))


def order_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pole and level of each order's curve."""
    key = F.col("o_orderkey")
    f0 = 5 * F.get(F.lit([1.0, 10.0, 100.0, 1e3, 1e4, 1e5]), (key % 6).cast("int"))
    level = -F.col("o_totalprice") / 1e4
    return table(spark, sf_dir, "orders").select("o_orderkey", f0.alias("f0"),
                                                 level.alias("level"))


def wide_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves without ripple of the orders: poles from 5 to 500,000 MHz, levels from -60 dB."""
    rows = spread(order_poles(spark, sf_dir), ["o_orderkey"])
    f = F.col("_i") * 25.0
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(40)))).select(
        "o_orderkey", "f0", "level", f.alias("f"),
        (F.col("level") - 20 * F.log10(1 + F.pow(f / F.col("f0"), 2))).alias("a"))


def part_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stack of each part's curve, from 5 to 380 um."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (5 * F.pow(F.lit(76.0), F.col("p_size") / 50) * 1e-6).alias("thickness_si"),
        ((14 + key % 3) * 1e-9).alias("thickness_sio2"),
        ((68 + key % 5) * 1e-9).alias("thickness_si3n4"))


def wide_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responsivity curves without ripple of the parts, stacks from 5 to 380 um."""
    rows = spread(part_depths(spark, sf_dir), ["p_partkey"]).withColumn(
        "lambda_nm", F.explode(F.lit(MEASURED_LAMBDAS)))
    return with_responsivity(with_material_constants(rows), tilted=False).select(
        "p_partkey", "lambda_nm", "thickness_si", F.col("sabs").alias("y"))


def measured_indices(spark: SparkSession) -> DataFrame:
    """The optical columns at the measured wavelengths, one row each."""
    return with_material_constants(wavelength_grid(spark, 400, 1100, 25))


#: The ripple of a sample repeats itself with the key; most keys of one remainder share a text.
RIPPLE_PERIOD, KEYS_PER_TEXT = 97, 10_000


def sweep_texts(spark: SparkSession, sf_dir: str, points: int = DEVICE_POINTS) -> DataFrame:
    """V3 written out as instrument files: ``file, content``, one row per part.

    Parts of one size whose keys leave the same remainder have equal texts.  A text is written
    once for such a set, which ranges of keys keep small, and repeated for its parts.
    """
    def line(x: Column) -> Column:
        level = F.replace(F.round(x["a"], 4).cast("decimal(12,4)").cast("string"), F.lit("."),
                          F.lit(","))
        return F.concat((x["f"] * 1000000).cast("long").cast("string"), F.lit(";"), level,
                        F.lit(";"))

    def point(i: Column) -> Column:
        f, a = _device_level(i, points)
        return F.struct(f.alias("f"), a.alias("a"))

    key = F.col("p_partkey")
    name = F.concat(F.lit("OP"), key.cast("string"), F.lit("_RO"), F.col("p_size").cast("string"),
                    F.lit("_part"), (1 + key % 10).cast("string"), F.lit("_"),
                    F.lpad((key % 5 + 1).cast("string"), 3, "0"), F.lit(".CSV"))
    head = F.array(F.lit("Type;demo"), F.lit("Date;none"), F.lit("Trace;1;"))
    foot = F.array_repeat(F.lit("end;0"), 11)
    samples = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: line(point(i)))
    text = F.concat(F.array_join(F.concat(head, samples, foot), "\n"), F.lit("\n"))
    # A negative remainder depends on more than the key's own remainder: such keys stay alone.
    plain = key.between(0, 2 ** 50)
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.when(plain, key % RIPPLE_PERIOD).otherwise(key).alias("_like"),
        F.when(plain, F.floor(key / (RIPPLE_PERIOD * KEYS_PER_TEXT))).alias("_range"))
    alike = ["p_size", "_like", "_range"]
    sets = spread(parts, alike).groupBy(*alike).agg(
        F.collect_list(F.struct("p_partkey")).alias("_parts"), F.min("p_partkey").alias("p_partkey"))
    return (sets.select("p_size", "_parts", text.alias("content"))
            .select("p_size", "content", F.inline("_parts")).select(name.alias("file"), "content"))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sectioned report per supplier, as lines: its 20 wavelengths are generated in place."""
    key = F.col("s_suppkey")

    def line(i: Column) -> Column:
        value = (key * 7 + i * 13) % 1000
        return F.concat((400 + 10 * i).cast("string"), F.lit(";0,"),
                        F.lpad(value.cast("string"), 3, "0"), F.lit(";"))

    head = [F.lit("[Allgemein]"), F.concat(F.lit("Datum:;"), F.lit("2022-07-21")),
            F.concat(F.lit("Bauteil:;"), F.col("s_name")),
            F.concat(F.lit("Charge:;FA"), (key % 13).cast("string")),
            F.concat(F.lit("Wafer:;W"), F.col("s_nationkey").cast("string")),
            F.concat(F.lit("Bauteil-Nr.:;"), key.cast("string")), F.lit("Temperatur:;25,0"),
            F.lit("[Einstellungen Messung]"), F.lit("Filter Counts:;10"),
            F.concat(F.lit("Delay:;"), (key % 3).cast("string")), F.lit("NPLC:;1"),
            F.lit("Spannung:;-5"), F.lit("Kanal B:;an"), F.lit("Id Kanal A:;1e-9"),
            F.lit("[Messwerte]"), F.lit("Kurve 1"),
            F.lit("Wellenlänge [nm];Empfindlichkeit [A/W];")]
    lines = F.concat(F.array(*head), F.transform(F.sequence(F.lit(0), F.lit(19)), line))
    name = F.concat(F.lit("report_"), F.lpad(key.cast("string"), 12, "0"), F.lit(".csv"))
    return spread(table(spark, sf_dir, "supplier"), ["s_suppkey"]).select(
        name.alias("path"), F.encode(F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n")),
                                     "UTF-8").alias("content"))


def optical_knots(spark: SparkSession, start: int = 380, stop: int = 1130) -> DataFrame:
    """The material constants as a measured table: ``material, lambda_nm, n, k, alpha``."""
    grid = with_material_constants(wavelength_grid(spark, start, stop, 1))
    zero = F.lit(0.0)
    rows = F.array(
        F.struct(F.lit("si").alias("material"), F.col("n_si").alias("n"), F.col("k_si").alias("k"),
                 F.col("alpha_si").alias("alpha")),
        F.struct(F.lit("sio2").alias("material"), F.col("n_sio2").alias("n"),
                 F.col("k_sio2").alias("k"), zero.alias("alpha")),
        F.struct(F.lit("si3n4").alias("material"), F.col("n_si3n4").alias("n"),
                 F.col("k_si3n4").alias("k"), zero.alias("alpha")))
    return grid.select("lambda_nm", F.inline(rows))


def stack_report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sectioned report per part: the responsivity of its stack at its own wavelengths.

    Every report measures from another wavelength on, between the whole nanometres of the
    optical tables.  Parts whose key divides by 50 write no data section.
    """
    key = F.col("p_partkey")
    parts = spread(table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand",
        ((95 + F.col("p_size") % 11) * 1e-7).alias("thickness_si"),
        ((13 + key % 5) * 1e-9).alias("thickness_sio2"),
        ((67 + key % 7) * 1e-9).alias("thickness_si3n4")), ["p_partkey"])
    rows = parts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(27)))).withColumn(
        "lambda_nm", (400 + 25 * F.col("_i")).cast("double") + (key % 40) * 0.5 + 0.25)
    rows = with_responsivity(with_material_constants(rows), tilted=False)
    ripple = ((key * 37 + F.col("_i") * 101) % 97 / F.lit(97.0) - 0.5) * 0.002
    value = round_even(F.col("sabs") + ripple, 6)
    text = F.translate(F.concat(F.col("lambda_nm").cast("decimal(8,2)").cast("string"), F.lit(";"),
                                value.cast("decimal(12,6)").cast("string"), F.lit(";")), ".", ",")
    lines = rows.groupBy("p_partkey", "p_brand").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", text.alias("line")))),
        lambda r: r["line"]).alias("_data"))
    head = F.array(F.lit("[Allgemein]"), F.concat(F.lit("Bauteil:;"), F.col("p_brand")),
                   F.concat(F.lit("Charge:;FA"), (key % 13).cast("string")),
                   F.concat(F.lit("Bauteil-Nr.:;"), key.cast("string")),
                   F.lit("[Einstellungen Messung]"), F.lit("NPLC:;1"))
    data = F.concat(F.array(F.lit("[Messwerte]"), F.lit("Kurve 1"),
                            F.lit("Wellenlänge [nm];Empfindlichkeit [A/W];")), F.col("_data"))
    whole = F.when(key % 50 == 0, head).otherwise(F.concat(head, data))
    name = F.concat(F.lit("stack_"), F.lpad(key.cast("string"), 12, "0"), F.lit(".csv"))
    return lines.select(name.alias("path"), F.encode(F.concat(
        F.array_join(whole, "\r\n"), F.lit("\r\n")), "UTF-8").alias("content"))


def gauge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts measured by three operators, four times each: ``value`` around the part's price."""
    key, op, rep = F.col("p_partkey"), F.col("operator"), F.col("repeat")
    rows = (spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"),
                   ["p_partkey"])
            .withColumn("operator", F.explode(F.sequence(F.lit(1), F.lit(3))))
            .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(4)))))
    ripple = ((key * 37 + op * 101 + rep * 53) % 97) / F.lit(97.0)
    both = ((key * op) % 7) / F.lit(70.0)
    return rows.select("p_brand", "p_partkey", "operator", (
        F.col("p_retailprice").cast("double") / 1000 + op * 0.05 + both + ripple * 0.2)
        .alias("value"))
