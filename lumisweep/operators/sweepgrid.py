"""Layer-thickness x wavelength x angle sweeps.

A sweep is a fixed fan-out per stack, so it is generated row by row with
``sequence`` / ``explode``: no join, no shuffle after the fan-out.  The stacks,
small before the fan-out, are spread over the tasks first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.functions.optics import absorption

LAYERS = ("si", "sio2", "si3n4")


def level_values(target: float, tolerance: float, n: int = 3) -> list[float]:
    """Distinct levels of one factor, ascending: target and n steps around it."""
    if tolerance == 0 or n < 2:
        return [target]
    half = (n - 1) / 2
    values = [target if i == half else target + (i - half) * tolerance / half
              for i in range(n)]
    return sorted(set(values) | {target})


def level_column(target: Column, tolerance: Column, n: int = 3) -> Column:
    """The same per row: an array of ``struct(value, is_target)`` for odd ``n``."""
    half = (n - 1) // 2
    steps = F.when(tolerance == 0, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(-half), F.lit(half)))
    return F.transform(steps, lambda i: F.struct(
        (target + i * tolerance / F.lit(float(max(half, 1)))).alias("value"),
        (i == 0).alias("is_target")))


def spread(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hash the rows over the configured number of partitions, ahead of a fan-out.

    An explicit number keeps adaptive execution from merging the small input again.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
                spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *(keys or df.columns))


GEOMETRY = [f"{p}_{x}" for x in LAYERS for p in ("target", "tolerance")]
#: Columns that name a set of equal stacks, and the most stacks one set should have.
ALIKE = ["_alike", "_share"]
STACKS_PER_SHARE = 1024


def layers_of(stacks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: ``_layers``, its distinct targets and tolerances (one, where keys differ)."""
    return stacks.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct(*GEOMETRY))).alias("_layers"))


def alike(stacks: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stacks with equal ``_layers`` share one sweep: ``(members, sets)``.

    ``members`` has the keys of every row of ``stacks`` and the ``ALIKE`` columns of its set,
    dealt by these; ``sets`` has one row per set and entry of ``_layers``, as ``GEOMETRY``
    columns.  Sets are told apart by the exact text of their numbers.  A set of very many
    stacks is cut by a hash of the keys, as its counted size asks, into shares of about
    ``STACKS_PER_SHARE``, so that no task writes the curves of one large set alone.
    """
    named = stacks.withColumn("_alike", F.to_json("_layers"))
    sizes = named.groupBy("_alike").agg(F.count("*").alias("_size"))
    share = F.pmod(F.xxhash64(*keys), F.ceil(F.col("_size") / STACKS_PER_SHARE))
    members = named.join(sizes, "_alike").withColumn("_share", share).drop("_size")
    sets = members.groupBy(*ALIKE).agg(F.min("_layers").alias("_layers")).select(
        *ALIKE, F.inline("_layers"))
    return spread(members.select(*keys, *ALIKE), ALIKE), sets


def for_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of every set for each of its stacks; ``found`` is dealt by ``ALIKE``.

    Hash-joined part by part: estimates of size do not see the fan-out of a sweep, and a
    broadcast would send all of it through the driver.
    """
    return found.join(members.hint("shuffle_hash"), ALIKE).drop(*ALIKE)


def wavelength_grid(spark: SparkSession, start: int, stop: int, step: int) -> DataFrame:
    """Wavelengths ``start .. stop`` in nm as doubles, both ends included."""
    return spark.range(start, stop + 1, step).select(F.col("id").cast("double").alias("lambda_nm"))


def stack_sweep(stacks: DataFrame, keys: Sequence[str], lambdas: Sequence[float],
                angles: Sequence[float] = (0.0,), n: int = 3,
                spread_first: bool = True) -> DataFrame:
    """Tolerance sweep of many stacks.

    ``spread_first=False`` saves the shuffle of the stacks where their table is
    already split into more files than there are cores.

    ``stacks`` has one row per key with ``target_<layer>`` and ``tolerance_<layer>``
    in m.  The result has one row per key, level combination, wavelength and angle:
    ``thickness_<layer>``, ``is_<layer>_target``, ``lambda_nm``, ``angle_deg`` and
    ``combo``, the mixed-radix number of the level indexes (R3).
    """
    df = stacks.select(*keys, *[f"{p}_{x}" for x in LAYERS for p in ("target", "tolerance")])
    if spread_first:
        df = spread(df, keys)
    combo = F.lit(0).cast("long")
    for layer in LAYERS:
        levels = level_column(F.col(f"target_{layer}"), F.col(f"tolerance_{layer}"), n)
        df = df.select("*", F.posexplode(levels).alias(f"_i_{layer}", f"_l_{layer}"))
        combo = combo * F.lit(n) + F.col(f"_i_{layer}")
    df = df.select(*keys, combo.alias("combo"),
                   *[F.col(f"_l_{x}.value").alias(f"thickness_{x}") for x in LAYERS],
                   *[F.col(f"_l_{x}.is_target").alias(f"is_{x}_target") for x in LAYERS])
    if len(angles) == 1:
        df = df.withColumn("angle_deg", F.lit(float(angles[0])))
    else:
        df = df.withColumn("angle_deg", F.explode(F.array(*[F.lit(float(a)) for a in angles])))
    return df.withColumn("lambda_nm", F.explode(F.lit([float(v) for v in lambdas])))


def tolerance_sweep(spark: SparkSession, si: Sequence[float], sio2: Sequence[float],
                    si3n4: Sequence[float], lambdas: Sequence[float],
                    targets: Sequence[float], angles: Sequence[float] = (0.0,),
                    n_env: float = 1.0) -> DataFrame:
    """Sweep of one stack over explicit levels.

    Combinations are numbered 0 .. n-1 by ``spark.range`` and decoded from the
    number, so they are generated in parallel and ``combo`` is stable.
    """
    factors = {"angle_deg": [float(a) for a in dict.fromkeys(angles)],
               "thickness_si3n4": list(dict.fromkeys(si3n4)),
               "thickness_sio2": list(dict.fromkeys(sio2)),
               "thickness_si": list(dict.fromkeys(si))}
    total = 1
    for values in factors.values():
        total *= len(values)
    df = spark.range(total).withColumnRenamed("id", "combo")
    left = F.col("combo")
    for name, values in factors.items():
        index = F.pmod(left, F.lit(len(values))).cast("int")
        df = df.withColumn(name, F.element_at(F.lit(values), index + 1))
        left = F.floor(left / len(values))
    for layer, target in zip(LAYERS, targets):
        values = factors[f"thickness_{layer}"]
        df = df.withColumn(f"is_{layer}_target",
                           F.col(f"thickness_{layer}") == F.lit(target)
                           if target in values else F.lit(False))
    return (df.withColumn("n_env", F.lit(float(n_env)))
            .withColumn("lambda_nm", F.explode(F.lit([float(v) for v in dict.fromkeys(lambdas)]))))


def with_indices(sweep: DataFrame, indices: DataFrame) -> DataFrame:
    """Left join of the resampled refractive indices on the wavelength.

    One row per wavelength; the optimizer broadcasts it when its size allows.
    """
    return sweep.join(indices, "lambda_nm", "left")


def thickness_decades(per_decade: int = 91, exponents: Sequence[int] = (-3, -4, -5, -6)
                      ) -> list[float]:
    """Thicknesses 1.0, 1.1 .. 10.0 times each power of ten, distinct (outer product)."""
    mantissas = [round(1 + i * 9 / (per_decade - 1), 10) for i in range(per_decade)]
    return list(dict.fromkeys(float(f"{m:.10g}e{e}") for e in exponents for m in mantissas))


def absorption_sweep(table: DataFrame, thicknesses: Sequence[float],
                     alpha: str = "alpha_si") -> DataFrame:
    """Absorption of each row's material over a list of thicknesses in m."""
    return (spread(table)
            .withColumn("thickness_si", F.explode(F.lit([float(t) for t in thicknesses])))
            .withColumn("absorption", absorption(F.col(alpha), F.col("thickness_si"))))
