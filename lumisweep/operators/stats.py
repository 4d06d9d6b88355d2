"""Quantile bands, peaks, summaries, box statistics, ECDF and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.operators.keyed import exact_quantiles, join_on, order_splits, running_total

DECILES = tuple(i / 10 for i in range(11))


def decile_bands(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact deciles ``q_0 .. q_100`` and the sample sd ``sd_<value>`` per key."""
    bands = exact_quantiles(df, keys, value, DECILES, out="_q", count="n",
                            extra=[F.stddev_samp(value).alias(f"sd_{value}")])
    return bands.select(
        *keys, *[F.col("_q")[i].alias(f"q_{i * 10}") for i in range(11)], f"sd_{value}")


def bands_long(bands: DataFrame, keys: Sequence[str], value: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key and quantile (R2)."""
    picked = columns or [c for c in bands.columns if c.startswith("q_")]
    return bands.unpivot(list(keys), list(picked), "quantile", value)


def peak_row(df: DataFrame, keys: Sequence[str], value: str, axis: str,
             carry: Sequence[str] = ()) -> DataFrame:
    """Row with the largest value per key, the smallest ``axis`` on a tie."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(
        F.col(value).alias("v"), (-F.col(axis)).alias("a"), *carry)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b.a")).alias(axis), F.col("_b.v").alias(value),
        *[F.col(f"_b.{c}").alias(c) for c in carry])


def summary_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact min, Q1, median, mean, Q3, max per column, one row each (A10)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    quartiles = exact_quantiles(long, ["column"], "value", [0, 0.25, 0.5, 0.75, 1], out="_q",
                                extra=[F.avg("value").alias("mean")])
    q = F.col("_q")
    return quartiles.select(
        "column", q[0].alias("min"), q[1].alias("q1"), q[2].alias("median"), "mean",
        q[3].alias("q3"), q[4].alias("max"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles and whisker ends inside ``reach`` x IQR of the box, per key."""
    splits = order_splits(df, value)
    quartiles = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], out="_q", count="n",
                                splits=splits)
    box = quartiles.select(*keys, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                           F.col("_q")[2].alias("q3"))
    width = (F.col("q3") - F.col("q1")) * F.lit(float(reach))
    inside = F.when(F.col(value).between(F.col("q1") - width, F.col("q3") + width), F.col(value))
    # Only distinct values matter for the whiskers; copies combine before the shuffle.
    rows = join_on(df.select(*keys, value).distinct(), box, keys)
    return rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of rows at or below each distinct value per key."""
    counted = df.groupBy(*keys, value).agg(F.count(value).alias("n"))
    running = running_total(counted, keys, value, "n", out="_upto", total="_all_rows")
    return running.where(F.col("n") > 0).select(*keys, value, "n", (F.col("_upto") / F.col("_all_rows")).alias("ecdf"))


def _bandwidth(rule: float, sd: Column, iqr: Column, n: Column) -> Column:
    """``rule * min(sd, IQR / 1.34) * n^(-1/5)``; sd, then 1, where the minimum is 0."""
    low = F.least(sd, iqr / 1.34)
    low = F.when(low > 0, low).when(sd > 0, sd).otherwise(F.lit(1.0))
    return F.lit(rule) * low * F.pow(n.cast("double"), F.lit(-0.2))


def _grid_stats(df: DataFrame, keys: Sequence[str], value: str, rule: float, n_grid: int,
                cut: float, tag: str, splits: Sequence[float]) -> DataFrame:
    stats = exact_quantiles(
        df, keys, value, [0.25, 0.75], out="_q", count=f"_n{tag}", splits=splits,
        extra=[F.stddev_samp(value).alias("_sd"), F.min(value).alias("_min"),
               F.max(value).alias("_max")])
    bw = _bandwidth(rule, F.coalesce("_sd", F.lit(0.0)), F.col("_q")[1] - F.col("_q")[0],
                    F.col(f"_n{tag}"))
    stats = stats.withColumn(f"_bw{tag}", bw)
    low = F.col("_min") - cut * F.col(f"_bw{tag}")
    high = F.col("_max") + cut * F.col(f"_bw{tag}")
    step = F.greatest((high - low) / (n_grid - 1), F.lit(1e-300))
    return stats.select(*keys, f"_n{tag}", f"_bw{tag}", low.alias(f"_lo{tag}"),
                        step.alias(f"_step{tag}"))


def _meet_grids(values: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the grid of their key, where they are.

    The output has a whole grid for each key, so keys are few and their grids are broadcast.
    In a shuffle by few keys, one task would read all rows of a key.
    """
    return join_on(values, F.broadcast(stats), keys)


def _shares(value: str, n_grid: int, tag: str) -> Column:
    """Linear binning: the two neighbouring grid points share the weight of a value."""
    at = (F.col(value) - F.col(f"_lo{tag}")) / F.col(f"_step{tag}")
    left = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(n_grid - 2)).cast("int")
    part = F.least(F.greatest(at - left, F.lit(0.0)), F.lit(1.0))
    return F.array(F.struct(left.alias("i"), (1 - part).alias("w")),
                   F.struct((left + 1).alias("i"), part.alias("w")))


def _smooth(bins: DataFrame, keys: Sequence[str], index: str, n_grid: int, tag: str,
            kept: Sequence[str]) -> DataFrame:
    """Gaussian weights from each bin to each grid point; the output has ``n_grid`` points.

    Work per key is ``n_grid`` squared at most, whatever the number of rows was.
    """
    distance = (F.col("_to") - F.col(index)) * F.col(f"_step{tag}") / F.col(f"_bw{tag}")
    weight = F.exp(-0.5 * distance * distance) / (
        F.col(f"_bw{tag}") * F.lit(math.sqrt(2 * math.pi)))
    others = [c for c in kept if c != index]
    return (bins.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
            .withColumn("_part", F.col("w") * weight)
            .groupBy(*keys, *others, "_to").agg(F.sum("_part").alias("w"))
            .withColumnRenamed("_to", index))


def kde_1d(df: DataFrame, keys: Sequence[str], value: str, n_grid: int = 512,
           cut: float = 0.0) -> DataFrame:
    """Gaussian density on ``n_grid`` points per key: ``x``, ``density``.

    Bandwidth ``0.9 min(sd, IQR/1.34) n^(-1/5)``.  Rows are first binned linearly onto the
    grid, ahead of any shuffle; then bins meet grid points.  The grid spans the data, widened by ``cut`` bandwidths on each side.
    """
    splits = order_splits(df, value)
    values = df.select(*keys, F.col(value).cast("double").alias(value))
    stats = _grid_stats(values, keys, value, 0.9, n_grid, cut, "", splits)
    bins = (_meet_grids(values, stats, keys)
            .select(*keys, F.inline_outer(_shares(value, n_grid, "")))
            .where(F.col("i").isNotNull())
            .groupBy(*keys, "i").agg(F.sum("w").alias("w")))
    smooth = _smooth(join_on(bins, stats, keys), keys, "i", n_grid, "", ["i"])
    return join_on(smooth, stats, keys).select(
        *keys, (F.col("_lo") + F.col("i") * F.col("_step")).alias("x"),
        (F.col("w") / F.col("_n")).alias("density"))


def kde_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, n_grid: int = 100) -> DataFrame:
    """Density on an ``n_grid`` x ``n_grid`` grid over the data range per key.

    Bandwidth per axis ``1.06 min(sd, IQR/1.34) n^(-1/5)``.  Rows are binned first, ahead of
    any shuffle; the product kernel is then applied one axis at a time.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    values = df.select(*keys, F.when(both, F.col(x).cast("double")).alias(x),
                       F.when(both, F.col(y).cast("double")).alias(y))
    splits_x, splits_y = order_splits(values, x), order_splits(values, y)
    stats = join_on(_grid_stats(values, keys, x, 1.06, n_grid, 0.0, "_x", splits_x),
                    _grid_stats(values, keys, y, 1.06, n_grid, 0.0, "_y", splits_y), keys)
    bins = (_meet_grids(values, stats, keys)
            .withColumn("_sy", _shares(y, n_grid, "_y"))
            .select(*keys, "_sy", F.inline_outer(_shares(x, n_grid, "_x")))
            .select(*keys, F.col("i").alias("ix"), F.col("w").alias("wx"),
                    F.inline_outer("_sy"))
            .select(*keys, "ix", F.col("i").alias("iy"), (F.col("wx") * F.col("w")).alias("w"))
            .where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
            .groupBy(*keys, "ix", "iy").agg(F.sum("w").alias("w")))
    along_x = _smooth(join_on(bins, stats, keys), keys, "ix", n_grid, "_x", ["ix", "iy"])
    along_y = _smooth(join_on(along_x, stats, keys), keys, "iy", n_grid, "_y", ["ix", "iy"])
    return join_on(along_y, stats, keys).select(
        *keys, (F.col("_lo_x") + F.col("ix") * F.col("_step_x")).alias("x"),
        (F.col("_lo_y") + F.col("iy") * F.col("_step_y")).alias("y"),
        (F.col("w") / F.col("_n_x")).alias("density"))
