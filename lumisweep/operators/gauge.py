"""Crossed gauge study: how much of the spread of measurements is the instrument's.

Every part is measured by every operator several times.  One pass sums the cells (part,
operator), and each cell is then added to its part's and its operator's sum, so the rows are read
once and what is shuffled is one row per cell and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.operators.keyed import join_on, with_keys

SOURCES = ("part", "operator", "interaction", "repeat")


def _floor(x: Column) -> Column:
    """Estimated variances below zero count as zero."""
    return F.greatest(x, F.lit(0.0))


def crossed_study(df: DataFrame, by: Sequence[str], part: str, operator: str,
                  value: str) -> DataFrame:
    """Two-way crossed analysis of variance with repeats, one row per group of ``by``.

    Sums of squares ``ss_<source>``, degrees of freedom ``df_<source>`` and variance
    components ``var_<source>`` of ``SOURCES``, ``var_gauge`` (all but the part's) and
    ``gauge_percent``, the gauge's share of the total standard deviation.  NULL values take
    no part.  Where a cell is missing, cells differ in size or there are no repeats, the study
    is not ``balanced`` and all of these are NULL.
    """
    rows, by = with_keys(df.where(F.col(value).isNotNull()), list(by))
    # var_pop is summed around the running mean, so large levels do not cancel.
    cells = rows.groupBy(*by, part, operator).agg(
        F.count("*").alias("_n"), F.avg(value).alias("_mean"),
        (F.var_pop(value) * F.count("*")).alias("_within"))
    grand = cells.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_m"))
    shifted = join_on(cells, grand, by).withColumn("_s", F.col("_n") * (F.col("_mean") - F.col("_m")))
    # Each cell counts for itself, its part and its operator, which may be NULL.
    margin = F.col("_margin")
    level = (shifted.withColumn("_margin", F.explode(F.lit(["cell", "part", "operator"])))
             .groupBy(*by, "_margin", F.when(margin != "operator", F.col(part)).alias("_a"),
                      F.when(margin != "part", F.col(operator)).alias("_b"))
             .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"),
                  F.sum("_within").alias("_within")))

    def only(margin: str, x: Column) -> Column:
        return F.when(F.col("_margin") == margin, x)

    square = F.col("_s") * F.col("_s") / F.col("_n")
    wide = level.groupBy(*by).agg(
        *[F.sum(only(m, square)).alias(f"_ss_{m}") for m in ("cell", "part", "operator")],
        *[F.count(only(m, F.lit(1))).cast("double").alias(f"_k_{m}")
          for m in ("cell", "part", "operator")],
        F.sum(only("cell", F.col("_within"))).alias("_within"),
        F.min(only("cell", F.col("_n"))).cast("double").alias("_least"),
        F.max(only("cell", F.col("_n"))).cast("double").alias("_most"))
    p, o, r = F.col("_k_part"), F.col("_k_operator"), F.col("_least")
    balanced = ((F.col("_k_cell") == p * o) & (r == F.col("_most")) & (r > 1) & (p > 1) & (o > 1))
    ss = {"part": F.col("_ss_part"), "operator": F.col("_ss_operator"),
          "interaction": F.col("_ss_cell") - F.col("_ss_part") - F.col("_ss_operator"),
          "repeat": F.col("_within")}
    free = {"part": p - 1, "operator": o - 1, "interaction": (p - 1) * (o - 1),
            "repeat": p * o * (r - 1)}
    found = wide.select(*by, balanced.alias("balanced"), p.alias("_p"), o.alias("_o"), r.alias("_r"),
                        *[F.when(balanced, ss[s]).alias(f"ss_{s}") for s in SOURCES],
                        *[F.when(balanced, free[s]).cast("long").alias(f"df_{s}") for s in SOURCES])
    mean = {s: F.col(f"ss_{s}") / F.col(f"df_{s}") for s in SOURCES}
    p, o, r = F.col("_p"), F.col("_o"), F.col("_r")
    found = found.withColumns({
        "var_part": _floor((mean["part"] - mean["interaction"]) / (o * r)),
        "var_operator": _floor((mean["operator"] - mean["interaction"]) / (p * r)),
        "var_interaction": _floor((mean["interaction"] - mean["repeat"]) / r),
        "var_repeat": mean["repeat"]})
    # greatest() leaves NULLs out; an unbalanced study has no components.
    found = found.withColumns({f"var_{s}": F.when(F.col("balanced"), F.col(f"var_{s}"))
                               for s in SOURCES})
    gauge = F.col("var_operator") + F.col("var_interaction") + F.col("var_repeat")
    return (found.withColumn("var_gauge", gauge)
            .withColumn("gauge_percent", 100 * F.sqrt(
                F.col("var_gauge") / F.nullif(F.col("var_gauge") + F.col("var_part"), F.lit(0.0))))
            .drop("_p", "_o", "_r", "_all"))
