"""Rollups over repeats and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.functions.rounding import rise_time_ps
from lumisweep.operators.keyed import join_on


def mean_over_repeats(df: DataFrame, keys: Sequence[str], f: str = "f", a: str = "a") -> DataFrame:
    """Mean amplitude of the repeats at each frequency (A1)."""
    return df.groupBy(*keys, f).agg(F.avg(a).alias(a))


def rollup_mean_of_ratios(results: DataFrame, keys: Sequence[str], cutoff: str = "cutoff_mhz",
                          risetime: str = "risetime_ps") -> DataFrame:
    """Mean cut-off and mean of the per-repeat rise times (A2, W6 a)."""
    return results.groupBy(*keys).agg(F.avg(cutoff).alias(cutoff), F.avg(risetime).alias(risetime))


def rollup_ratio_of_means(results: DataFrame, keys: Sequence[str], cutoff: str = "cutoff_mhz",
                          risetime: str = "risetime_ps") -> DataFrame:
    """Mean absolute cut-off and the rise time of that mean (A2, W6 b)."""
    return (results.groupBy(*keys).agg(F.avg(F.abs(F.col(cutoff))).alias(cutoff))
            .withColumn(risetime, rise_time_ps(F.col(cutoff))))


def distinct_runs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations."""
    return df.select(*keys).distinct()


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a lookup table.

    No hint: the optimizer broadcasts the lookup when its size is known to be
    small, as it is for the literal device table, and shuffles otherwise.
    """
    return df.join(lookup, list(on), "left")


def attach_identity(samples: DataFrame, identity: DataFrame, file: str = "file") -> DataFrame:
    """Sweep identity for each sample, joined on the full sweep key.

    Sweeps are files, so one identity row per file; the join never multiplies rows.
    Of several rows the smallest is taken; ``identity_conflicts`` lists such files.
    """
    names = [c for c in identity.columns if c != file]
    one = identity.groupBy(file).agg(F.min(F.struct(*names)).alias("_one")).select(
        file, "_one.*")
    return join_on(samples, one, [file], "left")


def identity_conflicts(identity: DataFrame, file: str = "file") -> DataFrame:
    """Files with more than one identity and how many they have."""
    return (identity.distinct().groupBy(file).agg(F.count("*").alias("identities"))
            .where("identities > 1"))


def exclude_parts(df: DataFrame, parts: Sequence[int] = (1, 2, 3, 4),
                  part: str = "part") -> DataFrame:
    """Drop the rows of the given parts."""
    return df.where(~F.col(part).isin(*parts))


def part_operator_summary(df: DataFrame, part: str, operator: str, value: str) -> DataFrame:
    """Count, min, mean, max, sd by part, by operator and by both, in one pass."""
    p, o = F.col(part), F.col(operator)
    level = F.when(F.grouping_id() == 0, F.lit("part_operator")).when(
        F.grouping(part) == 1, F.lit("operator")).otherwise(F.lit("part"))
    return (df.groupingSets([[p], [o], [p, o]], p, o).agg(
        level.alias("level"), F.count(value).alias("n"), F.min(value).alias("min"),
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_samp(value).alias("sd")))


# The rise-time reference lines in ps.
RISETIME_LIMITS_PS = (600.0, 880.0, 1100.0)


def threshold_band(value: Column, limits: Sequence[float] = RISETIME_LIMITS_PS) -> Column:
    """Number of limits that the value reaches or passes: 0 .. len(limits)."""
    band = F.when(value < limits[0], F.lit(0))
    for i, limit in enumerate(limits[1:], start=1):
        band = band.when(value < limit, F.lit(i))
    return band.when(value.isNotNull(), F.lit(len(limits)))


def threshold_counts(df: DataFrame, keys: Sequence[str], value: str,
                     limits: Sequence[float] = RISETIME_LIMITS_PS) -> DataFrame:
    """Rows per key and band between the reference lines."""
    return (df.withColumn("band", threshold_band(F.col(value), limits))
            .groupBy(*keys, "band").agg(F.count("*").alias("n")))


def mean_curve(df: DataFrame, keys: Sequence[str], f: str, a: str, z: float = 1.96) -> DataFrame:
    """Mean, sd, count and normal 95 % interval of the amplitude per key and frequency."""
    half = F.lit(float(z)) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return (df.groupBy(*keys, f).agg(F.count(a).alias("n"), F.avg(a).alias("mean"),
                                     F.stddev_samp(a).alias("sd"))
            .withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}))
