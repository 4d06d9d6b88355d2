"""Envelopes of a tolerance sweep.

All of them are one aggregation pass: a band is a condition inside ``min`` and
``max``, not a filter with a scan of its own, and the target curve is taken in the
same pass instead of being joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.functions.rounding import round_even
from lumisweep.operators.sweepgrid import LAYERS


def on_target(layers: Sequence[str] = LAYERS) -> Column:
    """All given factors are at their target level."""
    result = F.lit(True)
    for layer in layers:
        result = result & F.col(f"is_{layer}_target")
    return result


def envelope(sweep: DataFrame, by: Sequence[str], value: str = "sabs") -> DataFrame:
    """Target value, min and max per group (A4, J4; A7, J5 with ``by=["angle_deg"]``).

    A group without a target row keeps its min and max and a NULL target.
    """
    return sweep.groupBy(*by).agg(
        F.max(F.when(on_target(), F.col(value))).alias("target"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def envelope_one_factor(sweep: DataFrame, by: Sequence[str], value: str = "sabs") -> DataFrame:
    """Envelopes with all factors free and with only one free (A6), long by ``varying``."""
    aggs = []
    for varying in ("all", *LAYERS):
        held = on_target([x for x in LAYERS if x != varying]) if varying != "all" else F.lit(True)
        picked = F.when(held, F.col(value))
        aggs += [F.min(picked).alias(f"min_{varying}"), F.max(picked).alias(f"max_{varying}")]
    wide = sweep.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("varying"), F.col(f"min_{v}").alias("min"),
                              F.col(f"max_{v}").alias("max")) for v in ("all", *LAYERS)])
    return wide.select(*by, F.inline(rows))


def within(target: dict[str, Column], width: dict[str, Column]) -> Column:
    """Every factor lies between ``target - width`` and ``target + width``, ends included."""
    result = F.lit(True)
    for layer, middle in target.items():
        result = result & F.col(f"thickness_{layer}").between(
            middle - width[layer], middle + width[layer])
    return result


def envelope_bands(sweep: DataFrame, by: Sequence[str], bands: dict[str, Column],
                   value: str = "r") -> DataFrame:
    """Min and max of several nested bands in one pass (A5): ``<band>_min``, ``<band>_max``."""
    aggs = []
    for name, inside in bands.items():
        picked = F.when(inside, F.col(value))
        aggs += [F.min(picked).alias(f"{name}_min"), F.max(picked).alias(f"{name}_max")]
    return sweep.groupBy(*by).agg(*aggs)


def targets_with_envelope_by_angle(sweep: DataFrame, angle: str = "angle_deg",
                                   value: str = "sabs") -> DataFrame:
    """Target rows with the envelope of their angle over all wavelengths.

    A right join: an angle without target rows stays, with NULL target columns.
    """
    bounds = sweep.groupBy(angle).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return with_angle_bounds(sweep.where(on_target()), bounds, angle)


def with_angle_bounds(targets: DataFrame, bounds: DataFrame, angle: str = "angle_deg") -> DataFrame:
    """The right join of target rows with one row per angle.

    A right join can only broadcast its left side, and the fan-out of a sweep does not show in
    its estimated size.  Here the rows of the few angles are sent to the targets, and angles
    without targets are added.
    """
    met = targets.join(F.broadcast(bounds), angle)
    bare = bounds.join(F.broadcast(targets.select(angle).distinct()), angle, "left_anti")
    return met.unionByName(bare, allowMissingColumns=True)


def point_table(envelopes: DataFrame, lambda_nm: float, digits: int = 4) -> DataFrame:
    """Rows at one wavelength, rounded for display."""
    rows = envelopes.where(F.col("lambda_nm") == lambda_nm)
    return rows.withColumns({c: round_even(F.col(c), digits) for c in ("target", "min", "max")})
