"""Interpolation over knot tables: straight segments and cubic splines.

The spline is the interpolating cubic whose end segments match the third
derivative of the cubic through the four end points.  Its coefficients solve a
tridiagonal system over all knots of a key.  The influence of a knot fades by at
least one half per knot, so the system is solved in chunks of ``CHUNK`` knots with
``HALO`` extra knots on either side: exact to the last bit, and no task ever holds
more than ``CHUNK + 2 * HALO`` knots.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisweep.operators import keyed
from lumisweep.operators.keyed import (asof_lookup, dense_positions, join_on, order_splits,
                                       with_next)

# The numpy helper travels with the tasks; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 512
HALO = 64


def _common_splits(points: DataFrame, table: DataFrame, keys: Sequence[str], x: str
                   ) -> list[float]:
    """Cuts that bound both the knots and the points of a bucket.

    None, however many rows there are in all, where one job finds that the largest key fits
    one task.
    """
    value = F.col(x).cast("double").alias(x)
    both = table.select(*keys, value).unionByName(points.select(*keys, value))
    largest = both.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if (largest or 0) <= keyed.ROWS_PER_BUCKET:
        return []
    return order_splits(both, x)


def linear_segments(table: DataFrame, keys: Sequence[str], x: str, y: str,
                    splits: Sequence[float] | None = None) -> DataFrame:
    """One row per segment: ``x, y, x_next, y_next, slope``."""
    pairs = with_next(table.select(*keys, x, y), keys, x, [y], splits=splits).where(
        F.col(f"{x}_next").isNotNull())
    return pairs.withColumn("slope", (F.col(f"{y}_next") - F.col(y)) / (
        F.col(f"{x}_next") - F.col(x)))


def interpolate_linear(points: DataFrame, table: DataFrame, keys: Sequence[str], x: str,
                       y: str) -> DataFrame:
    """Value on the segment that holds each point; NULL outside the knots."""
    splits = _common_splits(points, table, keys, x)
    segments = linear_segments(table, keys, x, y, splits)
    found = asof_lookup(points, segments, keys, x, [y, f"{x}_next", "slope"], splits=splits)
    value = F.col(y) + F.col("slope") * (F.col(x) - F.col("x_at"))
    return (found.withColumn(y, F.when(F.col(x) <= F.col(f"{x}_next"), value))
            .drop("x_at", f"{x}_next", "slope"))


def _second_coefficients(x: np.ndarray, y: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
    """Solve the tridiagonal system; one column per y.  Cut ends get zero curvature."""
    n = len(x)
    c = np.zeros_like(y)
    if n < 3:
        return c
    h = np.diff(x)
    s = np.diff(y, axis=0) / h[:, None]
    main = np.ones(n)
    upper = np.zeros(n)
    lower = np.zeros(n)
    rhs = np.zeros_like(y)
    main[1:-1] = 2 * (h[:-1] + h[1:])
    lower[1:-1] = h[:-1]
    upper[1:-1] = h[1:]
    rhs[1:-1] = s[1:] - s[:-1]
    third = (s[1:] - s[:-1]) / (x[2:] - x[:-2])[:, None]
    if at_start:
        main[0], upper[0] = -h[0], h[0]
        if n > 3:
            rhs[0] = h[0] ** 2 * (third[1] - third[0]) / (x[3] - x[0])
    if at_end:
        main[-1], lower[-1] = -h[-1], h[-1]
        if n > 3:
            rhs[-1] = -h[-1] ** 2 * (third[-1] - third[-2]) / (x[-1] - x[-4])
    for i in range(1, n):
        part = lower[i] / main[i - 1]
        main[i] -= part * upper[i - 1]
        rhs[i] -= part * rhs[i - 1]
    c[-1] = rhs[-1] / main[-1]
    for i in range(n - 2, -1, -1):
        c[i] = (rhs[i] - upper[i] * c[i + 1]) / main[i]
    return c


def spline_coefficients(table: DataFrame, keys: Sequence[str], x: str, columns: Sequence[str],
                        splits: Sequence[float] | None = None) -> DataFrame:
    """Cubic pieces per key and knot: ``x`` and ``<y>``, ``<y>_b``, ``<y>_c``, ``<y>_d``.

    The value at ``u`` in the piece of knot ``x`` is ``y + t(b + t(3c + t d))`` with
    ``t = u - x``.  The last piece repeats the one before, written at its own knot.
    """
    keys, columns = list(keys), list(columns)
    if splits is None:
        splits = order_splits(table, x)
    knots = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in (x, *columns)])
    knots = dense_positions(knots, keys, x, out="_pos", splits=splits)
    if splits:
        ends = knots.groupBy(*keys).agg(F.max("_pos").alias("_end"))
        knots = join_on(knots, ends, keys)
    else:
        knots = knots.withColumn("_end", F.max("_pos").over(Window.partitionBy(*keys)))
    # Each knot goes to its own chunk and, near a border, to the neighbour as well.
    chunks = F.array_distinct(F.array(*[
        F.floor((F.col("_pos") + d) / CHUNK) for d in (-HALO, 0, HALO)]))
    parts = (knots.withColumn("_chunk", F.explode(chunks))
             .where((F.col("_chunk") >= 0) & (F.col("_chunk") * CHUNK <= F.col("_end"))))
    pieces = [f"{y}{tail}" for y in columns for tail in ("", "_b", "_c", "_d")]
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"`{x}` double",
                        *[f"`{p}` double" for p in pieces]])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        xs, ys = part[x].to_numpy(float), part[columns].to_numpy(float)
        pos = part["_pos"].to_numpy()
        c = _second_coefficients(xs, ys, pos[0] == 0, pos[-1] == part["_end"].iloc[0])
        h = np.diff(xs)[:, None]
        b, d = np.zeros_like(ys), np.zeros_like(ys)
        if len(xs) > 1:
            slope = np.diff(ys, axis=0) / h
            b[:-1] = slope - h * (c[1:] + 2 * c[:-1])
            d[:-1] = (c[1:] - c[:-1]) / h
            b[-1] = slope[-1] + h[-1] * (2 * c[-1] + c[-2])
            d[-1] = d[-2]
        own = pos // CHUNK == part["_chunk"].iloc[0]
        out = {k: part[k].to_numpy()[own] for k in keys} | {x: xs[own]}
        for j, y in enumerate(columns):
            for tail, values in (("", ys), ("_b", b), ("_c", c), ("_d", d)):
                out[f"{y}{tail}"] = values[own, j]
        return pd.DataFrame(out)

    return parts.groupBy(*keys, "_chunk").applyInPandas(solve, schema)


def spline_resample(points: DataFrame, table: DataFrame, keys: Sequence[str], x: str,
                    columns: Sequence[str]) -> DataFrame:
    """Spline values of ``columns`` at each point.

    Outside the knots the end pieces extend.
    """
    splits = _common_splits(points, table, keys, x)
    pieces = spline_coefficients(table, keys, x, columns, splits)
    parts = [f"{y}{tail}" for y in columns for tail in ("", "_b", "_c", "_d")]
    found = asof_lookup(points, pieces, keys, x, parts, extend_first=True, splits=splits)
    t = F.col(x) - F.col("x_at")
    values = {y: F.col(y) + t * (F.col(f"{y}_b") + t * (3 * F.col(f"{y}_c") + t * F.col(f"{y}_d")))
              for y in columns}
    return found.withColumns(values).drop("x_at", *[p for p in parts if p not in columns])


def refractive_indices(lambdas: DataFrame, optical: DataFrame,
                       materials: Sequence[str] = ("si", "sio2", "si3n4")) -> DataFrame:
    """One row per wavelength with ``n_<m>``, ``k_<m>``, ``alpha_<m>`` of all materials.

    ``optical`` has ``material, lambda_nm, n, k, alpha``.  One pivot takes the place of
    a chain of joins on the wavelength.
    """
    asked = lambdas.select("lambda_nm").distinct().withColumn(
        "material", F.explode(F.array(*[F.lit(m) for m in materials])))
    long = spline_resample(asked, optical, ["material"], "lambda_nm", ["n", "k", "alpha"])
    return long.groupBy("lambda_nm").agg(*[
        F.max(F.when(F.col("material") == m, F.col(q))).alias(f"{q}_{m}")
        for m in materials for q in ("n", "k", "alpha")])
