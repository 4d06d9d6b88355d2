"""Quantile bands from mergeable sketches (A3, A8, A10 where exact ranks cost too much).

A sketch of fixed size is kept per key and part of the data - a file, a day - in a table.  New
parts add rows; bands of any coarser key are read by merging sketches, without the
measurements.  Ranks are right up to ``rank_error``: a quantile asked for at p is the value at
a rank between p - error and p + error, 99 times of 100.  Which value differs between runs
within that bound; exact bands are in ``stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 1000


def rank_error(k: int = SKETCH_K) -> float:
    """Error of a single rank, as a share of the rows, for sketch size ``k``."""
    return 2.296 / k ** 0.9021


def sketch_table(df: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``keys, n, low, high, sketch``: combined before the shuffle, of bounded size.

    NULL and NaN values take no part; a key without others gives no row.
    """
    number = F.col(value).cast("double")
    rows = df.select(*keys, number.alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketch table of a coarser key."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_bands(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The columns but the sketch, and ``quantiles`` in the order of ``probs``.

    The ends 0 and 1 are exact.
    """
    def at(p: float) -> Column:
        if p in (0, 1):
            return F.col("high" if p else "low")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))

    return sketches.withColumn("quantiles", F.array(*map(at, probs))).drop("sketch")


def rank_errors(df: DataFrame, bands: DataFrame, keys: Sequence[str], value: str,
                probs: Sequence[float]) -> DataFrame:
    """``keys, prob, n, error``: how far the values' true ranks lie from those asked for.

    The rank of a value that repeats is any of its ranks.
    """
    number = F.col(value).cast("double")
    asked = bands.select(*keys, "quantiles")
    rows = df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sums = []
    for i in range(len(probs)):
        q = F.get("quantiles", F.lit(i))
        sums += [F.count_if(F.col("_v") < q).alias(f"_below_{i}"),
                 F.count_if(F.col("_v") <= q).alias(f"_upto_{i}")]
    counted = rows.join(asked, list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    found = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.greatest(
        F.col(f"_below_{i}") / F.col("n") - p, p - F.col(f"_upto_{i}") / F.col("n"), F.lit(0.0))
        .alias("error")) for i, p in enumerate(probs)])
    return counted.select(*keys, "n", F.inline(found))
