"""Envelopes of a tolerance sweep from its factors.

The responsivity of a stack is ``qe * A * T``: A, the absorption, depends on the silicon level
and the wavelength, and T = 1 - R, the costly part, on the two thin layers, the wavelength and
the angle.  All three are not negative, and a tolerance sweep is a full grid whose bands are
conditions on one layer each.  The extremes of the product over a band are therefore the
products of the extremes, and the sweep needs no row per silicon level: n * n rows and
reflectances per stack, wavelength and angle instead of n * n * n.

The stacks are dealt by their key ahead of the fan-out, and a group is made of the rows of one
stack, so the grouping needs no shuffle after the fan-out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.functions.optics import absorption, quantum_eff, with_reflectance
from lumisweep.operators.sweepgrid import GEOMETRY, LAYERS, level_column, spread

#: Tells by value, target and "is the target level" whether a level of a layer is in a band.
Inside = Callable[[Column, Column, Column], Column]
THIN = LAYERS[1:]


def everywhere(value: Column, target: Column, is_target: Column) -> Column:
    return F.lit(True)


def at_target(value: Column, target: Column, is_target: Column) -> Column:
    return is_target


def within(width: float) -> Inside:
    """Between target - width and target + width, ends included."""
    return lambda value, target, is_target: value.between(target - width, target + width)


#: The target curve and the envelopes with all factors free and with only one free.
ONE_FACTOR: dict[str, dict[str, Inside]] = {
    "target": dict.fromkeys(LAYERS, at_target), "all": {},
    **{free: {x: at_target for x in LAYERS if x != free} for free in LAYERS}}


def thin_sweep(stacks: DataFrame, keys: Sequence[str], lambdas: Sequence[float],
               bands: dict[str, dict[str, Inside]], indices: Callable[[DataFrame], DataFrame],
               angles: Sequence[float] = (0.0,), n: int = 3,
               dealt: Sequence[str] | None = None) -> DataFrame:
    """One row per stack, wavelength, angle and pair of thin-layer levels.

    The stacks are dealt by ``dealt``, by default the keys.

    ``stacks`` has ``target_<layer>`` and ``tolerance_<layer>`` in m per key; ``indices``
    adds the optical columns of ``lambda_nm``.  Columns: the keys, ``lambda_nm``,
    ``angle_deg``, ``r``, and per band ``<band>_in`` (the pair is in it), ``<band>_low`` and
    ``<band>_high`` (the extremes of the absorption over its silicon levels).
    """
    df = spread(stacks.select(*keys, *GEOMETRY), dealt or keys)
    levels = {x: level_column(F.col(f"target_{x}"), F.col(f"tolerance_{x}"), n) for x in LAYERS}
    df = df.withColumn("_si", levels["si"]).withColumn(
        "lambda_nm", F.explode(F.lit([float(v) for v in lambdas])))
    df = indices(df)

    def absorbed(band: dict[str, Inside]) -> Column:
        inside = band.get("si", everywhere)
        picked = F.filter("_si", lambda s: inside(s["value"], F.col("target_si"), s["is_target"]))
        return F.transform(picked, lambda s: absorption(F.col("alpha_si"), s["value"]))

    # Once per stack and wavelength, before the thin layers fan out.
    df = df.withColumns({f"{b}_{end}": pick(absorbed(band)) for b, band in bands.items()
                         for end, pick in (("low", F.array_min), ("high", F.array_max))})
    df = df.drop("_si")
    for x in THIN:
        df = df.select("*", F.explode(levels[x]).alias(f"_{x}")).withColumn(
            f"thickness_{x}", F.col(f"_{x}.value"))
    df = df.withColumn("angle_deg", F.explode(F.lit([float(a) for a in angles])))
    df = with_reflectance(df, tilted=tuple(angles) != (0.0,))

    def pair_in(band: dict[str, Inside]) -> Column:
        result = F.lit(True)
        for x in THIN:
            if x in band:
                result = result & band[x](F.col(f"thickness_{x}"), F.col(f"target_{x}"),
                                          F.col(f"_{x}.is_target"))
        return result

    return df.select(*keys, "lambda_nm", "angle_deg", "r",
                     *[pair_in(band).alias(f"{b}_in") for b, band in bands.items()],
                     *[f"{b}_{end}" for b in bands for end in ("low", "high")])


def band_extremes(thin: DataFrame, keys: Sequence[str], bands: Sequence[str],
                  value: str = "sabs") -> DataFrame:
    """``<band>_min``, ``<band>_max`` of ``sabs`` or ``r`` per stack, wavelength and angle.

    A band without levels gives NULL.
    """
    by = [*keys, "lambda_nm", "angle_deg"]
    ends = [(b, end, pick) for b in bands for end, pick in (("min", F.min), ("max", F.max))]
    found = thin.groupBy(*by).agg(
        *[pick(F.when(F.col(f"{b}_in"), F.col("r"))).alias(f"_{b}_{end}") for b, end, pick in ends],
        *[F.max(f"{b}_{end}").alias(f"{b}_{end}") for b in bands for end in ("low", "high")])
    if value == "r":
        # Silicon levels do not matter, but there must be one.
        return found.select(*by, *[F.when(F.col(f"{b}_low").isNotNull(), F.col(f"_{b}_{end}"))
                                   .alias(f"{b}_{end}") for b, end, _ in ends])
    qe = quantum_eff(F.col("lambda_nm"))
    other = {"min": ("low", "max"), "max": ("high", "min")}
    return found.select(*by, *[
        (F.col(f"{b}_{other[end][0]}") * qe * (1 - F.col(f"_{b}_{other[end][1]}")))
        .alias(f"{b}_{end}") for b, end, _ in ends])


def over_stacks(extremes: DataFrame, by: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """The extremes of groups of stacks from those of each."""
    return extremes.groupBy(*by).agg(*[pick(f"{b}_{end}").alias(f"{b}_{end}") for b in bands
                                       for end, pick in (("min", F.min), ("max", F.max))])
