"""Ordered-series operators on sweeps: nearest sample, plateau, cut-off.

Two forms of the same semantics:

* **keyed rows** - one row per sample, any number of samples per key.  Built from
  aggregates that combine before the shuffle, null-safe joins and exact quantiles.
* **packed sweep** - one row per sweep with an array of ``struct(pos, f, a)``.
  For sweeps whose length the instrument file or a positional slice bounds; it
  needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.functions.rounding import rise_time_ps, round_even
from lumisweep.operators.keyed import exact_quantiles, join_on, order_splits


def _nearest(f: str, pos: str, target: float) -> Column:
    distance = F.abs(F.col(f) - F.lit(float(target)))
    return F.min(F.when(F.col(f).isNotNull(), F.struct(
        distance.alias("distance"), F.col(pos).alias("pos"), F.col(f).alias("f"))))


def nearest_sample(df: DataFrame, keys: Sequence[str], target: float, f: str = "f",
                   pos: str = "pos") -> DataFrame:
    """Sample nearest to ``target`` per key, the first one on a tie."""
    return (df.groupBy(*keys).agg(_nearest(f, pos, target).alias("_near"))
            .select(*keys, F.col("_near.pos").alias("pos"), F.col("_near.f").alias("f"),
                    F.col("_near.distance").alias("distance")))


def plateau_limits(df: DataFrame, keys: Sequence[str], fmin: float, fmax: float,
                   f: str = "f", pos: str = "pos") -> DataFrame:
    """Positions nearest to ``fmin`` and ``fmax`` and the last position, in one pass."""
    return (df.groupBy(*keys).agg(_nearest(f, pos, fmin).alias("_lo"),
                                  _nearest(f, pos, fmax).alias("_hi"),
                                  F.max(pos).alias("pos_last"))
            .select(*keys, F.col("_lo.pos").alias("pos_lo"), F.col("_hi.pos").alias("pos_hi"),
                    "pos_last"))


def _in_plateau(closed: bool, pos: str) -> Column:
    upper = F.col(pos) <= F.col("pos_hi") if closed else F.col(pos) < F.col("pos_hi")
    return (F.col(pos) >= F.col("pos_lo")) & upper


def plateau_rows(df: DataFrame, keys: Sequence[str], fmin: float, fmax: float, f: str = "f",
                 pos: str = "pos", closed: bool = True) -> DataFrame:
    """Rows between the two plateau positions, both ends included by default."""
    limits = plateau_limits(df, keys, fmin, fmax, f, pos)
    return (join_on(df, limits, keys)
            .where(_in_plateau(closed, pos)).drop("pos_lo", "pos_hi", "pos_last"))


def plateau_level(df: DataFrame, keys: Sequence[str], fmin: float, fmax: float, f: str = "f",
                  a: str = "a", pos: str = "pos", closed: bool = False) -> DataFrame:
    """Exact median amplitude of the plateau per key (A3): ``plateau``, ``n_plateau``."""
    splits = order_splits(df, a)
    rows = plateau_rows(df, keys, fmin, fmax, f, pos, closed)
    return (exact_quantiles(rows, keys, a, [0.5], out="_q", count="n_plateau", splits=splits)
            .select(*keys, F.col("_q")[0].alias("plateau"), "n_plateau"))


def cutoff_readout(df: DataFrame, keys: Sequence[str], fmin: float = 8.0, fmax: float = 100.0,
                   drop_db: float = 3.0, f: str = "f", a: str = "a", pos: str = "pos",
                   plateau_closed: bool = False, include_last: bool = False,
                   digits: int | None = 1) -> DataFrame:
    """Cut-off per key on keyed rows (W2; W3 with the two flags set).

    The plateau level is the exact median between the samples nearest to ``fmin``
    and ``fmax``.  The cut-off is the sample, from the plateau start on, whose
    distance to the level is closest to ``drop_db`` in either direction; the first
    one on a tie.  An empty plateau gives NULL.
    """
    # Cuts over all amplitudes also bound the plateau rows, and need no join first.
    splits = order_splits(df, a)
    limits = plateau_limits(df, keys, fmin, fmax, f, pos)
    placed = join_on(df.select(*keys, pos, f, a), limits, keys)
    # Conditions stand inside the aggregates, not in filters: both passes then read
    # the same rows and share one shuffle of them.
    inside = F.when(_in_plateau(plateau_closed, pos), F.col(a))
    level = exact_quantiles(placed.withColumn("_inside", inside), keys, "_inside", [0.5],
                            out="_q", count="n_plateau", splits=splits)
    level = level.select(*keys, F.col("_q")[0].alias("plateau"), "n_plateau")

    usable = (F.col(pos) >= F.col("pos_lo")) & F.col(a).isNotNull() & F.col(
        "plateau").isNotNull()
    if not include_last:
        usable &= F.col(pos) < F.col("pos_last")
    gap = F.abs(F.lit(float(drop_db)) - F.abs(F.col(a) - F.col("plateau")))
    found = (join_on(placed, level, keys, "left")
             .groupBy(*keys).agg(
                 F.min(F.when(usable, F.struct(gap.alias("gap"), F.col(pos).alias("pos"),
                                               F.col(f).alias("f")))).alias("_best"),
                 F.first("plateau").alias("plateau"), F.first("n_plateau").alias("n_plateau")))
    cutoff = F.col("_best.f")
    if digits is not None:
        cutoff = round_even(cutoff, digits)
    return found.select(*keys, "plateau", "n_plateau", F.col("_best.pos").alias("pos"),
                        cutoff.alias("cutoff_mhz"))


def with_rise_time(df: DataFrame, cutoff: str = "cutoff_mhz", out: str = "risetime_ps",
                   digits: int | None = None) -> DataFrame:
    """Rise time next to the cut-off."""
    value = rise_time_ps(F.col(cutoff))
    return df.withColumn(out, value if digits is None else round_even(value, digits))


# ---------------------------------------------------------------- packed sweeps

def pack_sweep(df: DataFrame, keys: Sequence[str], lo: int, hi: int, f: str = "f",
               a: str = "a", pos: str = "pos", out: str = "points") -> DataFrame:
    """Rows at positions ``lo <= pos < hi`` of each sweep as one array, ordered.

    The slice bounds the array: positions are unique within a sweep, so it has at
    most ``hi - lo`` entries however many rows a key holds.
    """
    points = F.array_sort(F.collect_list(F.struct(
        F.col(pos).alias("pos"), F.col(f).alias("f"), F.col(a).alias("a"))))
    return (df.where((F.col(pos) >= lo) & (F.col(pos) < hi))
            .groupBy(*keys).agg(points.alias(out)))


def unpack_sweep(df: DataFrame, points: str = "points") -> DataFrame:
    """One row per sample again.

    The outer form keeps the optimizer from testing the size of the array first, which
    would build the array a second time; the row it adds for an empty array is dropped.
    """
    return df.select("*", F.inline_outer(points)).drop(points).where(F.col("pos").isNotNull())


def positional_slice(df: DataFrame, lo: int, hi: int, pos: str = "pos") -> DataFrame:
    """Rows at positions ``lo <= pos < hi`` (P10, L2)."""
    return df.where((F.col(pos) >= lo) & (F.col(pos) < hi))


def _packed_nearest(points: str, target: float) -> Column:
    near = F.transform(
        F.filter(points, lambda x: x["f"].isNotNull()),
        lambda x: F.struct(F.abs(x["f"] - F.lit(float(target))).alias("d"),
                           x["pos"].alias("pos")))
    return F.array_min(near)["pos"]


def cutoff_packed(df: DataFrame, points: str = "points", fmin: float = 8.0,
                  fmax: float = 100.0, drop_db: float = 3.0, plateau_closed: bool = False,
                  include_last: bool = False, digits: int | None = 1) -> DataFrame:
    """The same readout on packed sweeps: a narrow job, one sweep per row."""
    def inside(x: Column) -> Column:
        upper = x["pos"] <= F.col("_hi") if plateau_closed else x["pos"] < F.col("_hi")
        return (x["pos"] >= F.col("_lo")) & upper & x["a"].isNotNull() & ~F.isnan(x["a"])

    def usable(x: Column) -> Column:
        seen = (x["pos"] >= F.col("_lo")) & x["a"].isNotNull() & F.col("plateau").isNotNull()
        return seen if include_last else seen & (x["pos"] < F.col("_last"))

    def gap(x: Column) -> Column:
        off = F.abs(F.lit(float(drop_db)) - F.abs(x["a"] - F.col("plateau")))
        return F.struct(off.alias("gap"), x["pos"].alias("pos"), x["f"].alias("f"))

    n = F.size("_level")
    middle = (F.element_at("_level", F.floor((n + 1) / 2).cast("int"))
              + F.element_at("_level", F.floor(n / 2).cast("int") + 1)) / 2
    staged = (df.withColumns({
        "_lo": _packed_nearest(points, fmin), "_hi": _packed_nearest(points, fmax),
        "_last": F.array_max(F.transform(points, lambda x: x["pos"]))})
        .withColumn("_level", F.array_sort(F.transform(
            F.filter(points, inside), lambda x: x["a"])))
        .withColumns({"plateau": F.when(n > 0, middle), "n_plateau": n.cast("long")})
        .withColumn("_best", F.array_min(F.transform(F.filter(points, usable), gap))))
    cutoff = F.col("_best")["f"]
    if digits is not None:
        cutoff = round_even(cutoff, digits)
    return (staged.withColumn("cutoff_mhz", cutoff)
            .withColumn("pos", F.col("_best")["pos"])
            .drop("_lo", "_hi", "_last", "_level", "_best", points))
