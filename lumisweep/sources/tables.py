"""Optical tables, run plan, assignment, results and the literal device lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.functions.formatting import clean_names, title_names
from lumisweep.functions.rounding import decimal_comma_to_double
from lumisweep.operators.rollup import lookup_join

OPTICAL_SCHEMA = ("lambda_nm double, n double, lambda_k double, k double, alpha double, "
                  "reference string, details string")
ASSIGNMENT_SCHEMA = "fa_nr string, wafer_charge string, wafer_nr int, facility string"

# The ten measured parts, their devices and breakdown voltages [V].
DEVICES = [
    (1, "GA2199", 204.0), (2, "GA2200", 193.0), (3, "GA0995", 119.0), (4, "GA0996", 118.0),
    (5, "2189_01", 147.0), (6, "2189_02", 149.0), (7, "2205_02", 149.0),
    (8, "2205_04", 163.0), (9, "2390_04", 162.0), (10, "2390_21", 159.0),
]


def read_optical_constants(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``material, lambda_nm, n, k, alpha`` from one CSV path (or glob) per material."""
    result = None
    for material, path in paths.items():
        table = (spark.read.csv(path, schema=OPTICAL_SCHEMA, header=True, escape='"',
                                enforceSchema=True)
                 .select(F.lit(material).alias("material"), "lambda_nm", "n", "k", "alpha"))
        result = table if result is None else result.unionByName(table)
    return result


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """Wafer to facility assignment, ``;`` separated with declared types."""
    return spark.read.csv(path, sep=";", header=True, schema=ASSIGNMENT_SCHEMA)


def read_run_plan(spark: SparkSession, path: str) -> DataFrame:
    """Run plan with clean names; its first column becomes ``RunOrder``.

    Types are inferred as in the source: this is a hand-written table of one plan.
    """
    plan = spark.read.csv(path, sep=";", header=True, inferSchema=True)
    return clean_names(plan).withColumnRenamed("i_run_order", "RunOrder").withColumnRenamed(
        "run_order", "RunOrder")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result file written with decimal commas.

    ``Runoders``, ``Cutoff_MHz`` and ``risetime_ps`` are doubles, ``Part`` and
    ``Mess`` integers (``001`` is read as 1).
    """
    raw = spark.read.csv(path, sep=";", header=True)
    doubles = {c: decimal_comma_to_double(F.col(c))
               for c in ("Runoders", "Cutoff_MHz", "risetime_ps") if c in raw.columns}
    integers = {c: F.col(c).try_cast("int") for c in ("Part", "Mess") if c in raw.columns}
    return raw.withColumns({**doubles, **integers})


def device_lookup(spark: SparkSession, part: str = "part", as_text: bool = False) -> DataFrame:
    """The literal table part -> device, breakdown voltage: ten rows."""
    table = spark.createDataFrame(DEVICES, f"`{part}` int, device string, ubr_V double")
    return table.withColumn(part, F.col(part).cast("string")) if as_text else table


def plan_with_devices(plan: DataFrame) -> DataFrame:
    """Run plan with device and voltage, title-case names and an empty ``Done``."""
    joined = lookup_join(plan, device_lookup(plan.sparkSession, "parts"), ["parts"])
    ordered = joined.select(*plan.columns, "device", "ubr_V")
    return title_names(ordered).withColumn("Done", F.lit(""))
