"""Layer thicknesses from measured responsivity curves (F3) and their statistics.

Repeats at one wavelength are combined to count, sum and scatter before anything else,
so what is gathered per key is one number triple per distinct wavelength of the key, next
to the optical columns there: a curve, bounded by the wavelengths of ``indices``.  Curves are
fitted in blocks by numpy inside the tasks, without further shuffles; the statistics of
the coefficients are native columns.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.functions.optics import QE_PER_NM, quantum_eff, with_reflectance
from lumisweep.operators.fits import solve_each
from lumisweep.operators.keyed import join_values
from lumisweep.operators.sweepgrid import spread

# The numpy helpers travel with the tasks; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARAMETERS = ("si", "sio2", "si3n4")
STACK_START = {"si": 10.0, "sio2": 15.0, "si3n4": 70.0}     # um, nm, nm
#: Metres per unit of a parameter.
UNITS = {"si": 1e-6, "sio2": 1e-9, "si3n4": 1e-9}
# Silicon thicknesses in um for the first look, about a factor of 1.4 apart.
STACK_LOOKS = tuple(2.0 * 1.4 ** i for i in range(18))
STACK_STEPS = 100
STACK_DONE = 1e-9         # relative length of the last undamped step
STACK_BLOCK = 512         # curves solved together
STACK_KNOWN = 32768       # curves whose fit a task remembers

_OPTICAL = ("n_env", "n_si", "k_si", "alpha_si", "n_sio2", "k_sio2", "n_si3n4", "k_si3n4")
_FIELDS = ("lambda_nm", "_n", "_y", "_within", *_OPTICAL)


def _model(p: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Responsivity and its slopes; ``p`` is (curves, 3), the fields (curves, wavelengths)."""
    si, sio2, si3n4 = (p[:, i:i + 1] for i in range(3))
    lower, upper = x["n_sio2"] + 1j * x["k_sio2"], x["n_si3n4"] + 1j * x["k_si3n4"]
    wave = 2 * np.pi / x["lambda_nm"]
    c2, s2 = np.cos(wave * x["n_sio2"] * sio2), 1j * np.sin(wave * x["n_sio2"] * sio2)
    c1, s1 = np.cos(wave * x["n_si3n4"] * si3n4), 1j * np.sin(wave * x["n_si3n4"] * si3n4)
    silicon = x["n_si"] + 1j * x["k_si"]

    def above(c, s, y, b, h):
        """Fields on top of a layer from those below it."""
        return c * b + s / y * h, s * y * b + c * h

    def turned(c, s, y, b, h):
        """Slope of the same with the phase of the layer."""
        return above(1j * s, 1j * c, y, b, h)

    field = above(c2, s2, lower, 1.0, silicon)
    b, h = above(c1, s1, upper, *field)
    slopes = [above(c1, s1, upper, *turned(c2, s2, lower, 1.0, silicon)),
              turned(c1, s1, upper, *field)]
    top, bottom = x["n_env"] * b - h, x["n_env"] * b + h
    size = np.abs(bottom) ** 2
    r = np.abs(top) ** 2 / size
    steps = [2 * wave * n * (np.real(np.conj(top) * (x["n_env"] * db - dh))
                             - r * np.real(np.conj(bottom) * (x["n_env"] * db + dh))) / size
             for n, (db, dh) in zip((x["n_sio2"], x["n_si3n4"]), slopes)]
    depth = x["alpha_si"] * 1e-4
    ideal, passed = QE_PER_NM * x["lambda_nm"], np.exp(-depth * si)
    absorbed = ideal * (1 - passed)
    return absorbed * (1 - r), np.stack(
        [ideal * depth * passed * (1 - r), *(-absorbed * s for s in steps)], axis=-1)


def _padded(curves: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Fields as (curves, wavelengths); places beyond a curve's end count no measurement."""
    wide = np.ones((len(curves), max([1, *map(len, curves)]), len(_FIELDS)))
    wide[:, :, 1:4] = 0
    for i, curve in enumerate(curves):
        wide[i, :len(curve)] = curve
    fields = {name: wide[:, :, i] for i, name in enumerate(_FIELDS)}
    fields["_mean"] = fields["_y"] / np.maximum(fields["_n"], 1)
    return fields


def _misfit(level: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.sum(x["_n"] * (x["_mean"] - level) ** 2, axis=1)


def _first_look(x: dict[str, np.ndarray]) -> np.ndarray:
    """Start values: the silicon thickness of the smallest misfit over the usual thin layers.

    The thin layers are the same in every look, so their reflectance is computed once.
    """
    p = np.tile([STACK_START[k] for k in PARAMETERS], (len(x["_y"]), 1))
    depth = x["alpha_si"] * 1e-4
    level, _ = _model(p, x)
    rest = level / np.maximum(1 - np.exp(-depth * STACK_START["si"]), 1e-300)
    looks = [_misfit(rest * (1 - np.exp(-depth * si)), x) for si in STACK_LOOKS]
    p[:, 0] = np.array(STACK_LOOKS)[np.argmin(looks, axis=0)]
    return p


def _fit_block(curves: list[np.ndarray], start: Sequence[float] | None) -> dict[str, np.ndarray]:
    """Damped Gauss-Newton steps in units in which every column has length one."""
    x = _padded(curves)
    p = np.tile(np.array(start, float), (len(curves), 1)) if start else _first_look(x)
    damping = np.full(len(curves), 1e-3)
    level, slope = _model(p, x)
    sse = _misfit(level, x)
    converged = np.zeros(len(curves), bool)
    live = np.arange(len(curves))
    for _ in range(STACK_STEPS):
        here = {k: v[live] for k, v in x.items()}
        normal, scale = _normal(slope[live], here["_n"])
        gradient = np.einsum("ij,ijk->ik", here["_n"] * (here["_mean"] - level[live]),
                             slope[live]) / scale
        step = solve_each(normal + damping[live][:, None, None] * np.eye(3), gradient) / scale
        small = (np.abs(step) <= STACK_DONE * np.abs(p[live])).all(axis=1)
        trial = p[live] + step
        t_level, t_slope = _model(trial, here)
        t_sse = _misfit(t_level, here)
        # Next to the end rounding decides which sum is smaller; the step counts all the same.
        better = t_sse <= sse[live] * (1 + 1e-10) + 1e-24
        hit = live[better]
        p[hit], level[hit], slope[hit] = trial[better], t_level[better], t_slope[better]
        sse[hit] = t_sse[better]
        converged[live] = small & better & (damping[live] <= 1e-9)
        damping[live] = np.where(better, damping[live] / 10, np.maximum(damping[live], 1e-9) * 8)
        live = live[~converged[live] & (damping[live] < 1e12)]
        if not len(live):
            break
    normal, scale = _normal(slope, x["_n"])
    sure = np.linalg.cond(normal) < 1e13
    inverse = np.full_like(normal, np.nan)
    inverse[sure] = np.linalg.inv(normal[sure]) / (scale[sure][:, :, None] * scale[sure][:, None, :])
    return {"p": p, "converged": converged & sure, "sse": sse + x["_within"].sum(axis=1),
            "n": x["_n"].sum(axis=1), "inverse": inverse.reshape(-1, 9)}


def _fit_new(flat: list[np.ndarray], start: Sequence[float] | None,
             known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Thicknesses, converged, n, sse and inverse per curve; equal curves are fitted once.

    ``known`` keeps these numbers by a digest of the curve, for ``STACK_KNOWN`` curves at most.
    """
    names = [hashlib.blake2b(c.tobytes(), digest_size=32).digest() for c in flat]
    if len(known) > STACK_KNOWN:
        known.clear()
    order = list({name: i for i, name in enumerate(names) if name not in known}.values())
    for i in range(0, len(order), STACK_BLOCK):
        block = order[i:i + STACK_BLOCK]
        found = _fit_block([flat[j].reshape(-1, len(_FIELDS)) for j in block], start)
        known.update(zip((names[j] for j in block), np.column_stack([
            found[k] for k in ("p", "converged", "n", "sse", "inverse")])))
    return np.array([known[name] for name in names]).reshape(-1, 15)


def _normal(slope: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrix over its columns' lengths, and these lengths."""
    normal = np.matmul((weight[..., None] * slope).transpose(0, 2, 1), slope)
    scale = np.sqrt(np.einsum("ikk->ik", normal))
    scale[~(scale > 0)] = 1.0
    return normal / (scale[:, :, None] * scale[:, None, :]), scale


def fit_layer_stack(measured: DataFrame, indices: DataFrame, keys: Sequence[str], y: str,
                    start: dict[str, float] | None = None) -> DataFrame:
    """Least-squares layer thicknesses from measured responsivity per key.

    ``measured`` has ``lambda_nm`` and ``y``; ``indices`` one row per wavelength with the
    optical columns.  Returns ``thickness_si``, ``thickness_sio2``, ``thickness_si3n4`` in m;
    ``converged``: whether an undamped step changed each by less than 1e-9 of it; ``n``, the
    measurements used; ``sse``; and ``inverse``, the inverse normal matrix in row order (um,
    nm, nm), NULL where it is singular.  Starts from ``start`` (um, nm, nm), or without it from
    the best of the silicon thicknesses ``STACK_LOOKS`` over the usual thin layers.

    Rows whose value or wavelength is NULL or that ``indices`` does not know take no part; a
    key without other rows gives no row, one with fewer than three wavelengths does not
    converge.
    """
    keys = list(keys)
    square = F.col(y) * F.col(y)
    sums = (measured.where(F.col(y).isNotNull() & F.col("lambda_nm").isNotNull())
            .groupBy(*keys, "lambda_nm").agg(
                F.count(y).cast("double").alias("_n"), F.sum(y).alias("_y"),
                F.greatest(F.lit(0.0), F.sum(square) - F.sum(y) * F.avg(y)).alias("_within")))
    fields = F.array(*[F.col(c).cast("double") for c in _FIELDS])
    # Dealt by key in a fixed number of parts: few bytes, but much to compute.
    curves = (spread(sums.join(indices.select("lambda_nm", *_OPTICAL), "lambda_nm"), keys)
              .groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_curve")))
    first = [start[k] for k in PARAMETERS] if start else None

    @F.pandas_udf("si double, sio2 double, si3n4 double, converged boolean, n long, sse double, "
                  "inverse array<double>")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, np.ndarray] = {}
        for flat in batches:
            with np.errstate(all="ignore"):
                found = _fit_new([np.asarray(c, float) for c in flat], first, known)
            out = pd.DataFrame(found[:, :3], columns=list(PARAMETERS))
            yield out.assign(
                converged=(found[:, 3] > 0) & np.isfinite(found[:, :3]).all(axis=1),
                n=found[:, 4].astype(np.int64), sse=found[:, 5],
                inverse=[list(v) if np.isfinite(v).all() else None for v in found[:, 6:]])

    # Fitted where the curve was gathered: dealing equal curves to few tasks costs more than a fit.
    done = curves.select(*keys, fit(F.flatten("_curve")).alias("_fit"))
    return done.select(*keys, *[(F.col(f"_fit.{k}") * UNITS[k]).alias(f"thickness_{k}")
                                for k in PARAMETERS],
                       *[F.col(f"_fit.{c}").alias(c) for c in ("converged", "n", "sse", "inverse")])


def predict_layer_stack(measured: DataFrame, indices: DataFrame, fitted: DataFrame,
                        keys: Sequence[str], y: str) -> DataFrame:
    """Fitted value ``model`` and ``residual`` next to each measured row."""
    thickness = [f"thickness_{k}" for k in PARAMETERS]
    rows = join_values(measured, fitted.select(*keys, *thickness), keys)
    rows = with_reflectance(rows.join(indices, "lambda_nm"), out="_r", tilted=False)
    model = (quantum_eff(F.col("lambda_nm").cast("double")) * (1 - F.col("_r"))
             * (1 - F.exp(-F.col("alpha_si") * 100 * F.col("thickness_si"))))
    return rows.select(*measured.columns, model.alias("model")).withColumn(
        "residual", F.col(y) - F.col("model"))


def residual_summary(predicted: DataFrame, keys: Sequence[str],
                     residual: str = "residual") -> DataFrame:
    """Rows, sum of squares and RMSE per group."""
    square = F.col(residual) * F.col(residual)
    return predicted.groupBy(*keys).agg(
        F.count(residual).alias("n"), F.sum(square).alias("sse"),
        F.sqrt(F.avg(square)).alias("rmse"))


# Numerators of Lanczos' series for the gamma function (g = 7, 9 terms): fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
            1.5056327351493116e-7)
BETA_TERMS = 200


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 0.5."""
    series = _LANCZOS[0]
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + c / (x + float(i))
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * np.log(t) - t + np.log(series)


def _tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """``student_tail`` of many rows at once; NaN where it is not known."""
    square = t * t
    a, b = df / 2, np.full(len(df), 0.5)
    x, rest = df / (df + square), square / (df + square)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log(rest))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, rest, x)

    def guarded(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    d = 1 / guarded(1 - (p + q) * z / (p + 1))
    fraction, c = d, np.ones(len(df))
    for m in range(1, BETA_TERMS + 1):            # two rungs of the fraction
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d1, c1 = 1 / guarded(1 + even * d), guarded(1 + even / c)
        d, c = 1 / guarded(1 + odd * d1), guarded(1 + odd / c1)
        fraction = fraction * d1 * c1 * d * c
    tail = front * fraction / p
    known = (df > 0) & (x > 0) & (rest > 0)
    return np.where(t == 0, np.where(df > 0, 1.0, np.nan),
                    np.where(known, np.where(swap, 1 - tail, tail), np.nan))


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided p value of ``t`` with ``df`` degrees of freedom.

    This is the regularised incomplete beta function I_x(df/2, 1/2) at x = df/(df + t^2), by
    its continued fraction (Lentz), in the form that converges: for x above (a+1)/(a+b+2) that
    of 1 - I_{1-x}(b, a).
    """
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(_tail(t.to_numpy(float), df.to_numpy(float)))

    return tail(t.cast("double"), df.cast("double"))


def coefficient_summary(fitted: DataFrame, keys: Sequence[str],
                        against: dict[str, float] | None = None) -> DataFrame:
    """One row per key and parameter with the usual statistics of its estimate.

    ``parameter``, ``estimate`` and ``std_error`` (um, nm, nm), ``t_value`` and ``p_value``
    (two-sided) of its difference from ``against`` (zero), ``residual_sd`` and ``df``.  They
    come from the inverse normal matrix at the end of the fit; with no more measurements than
    parameters, or a singular matrix, they are NULL.
    """
    against = against or {}
    df = (F.col("n") - len(PARAMETERS)).alias("df")
    rows = F.array(*[F.struct(
        F.lit(k).alias("parameter"), (F.col(f"thickness_{k}") / UNITS[k]).alias("estimate"),
        F.lit(float(against.get(k, 0.0))).alias("null_value"),
        F.get("inverse", F.lit(4 * i)).alias("spread")) for i, k in enumerate(PARAMETERS)])
    sd = F.when(F.col("df") > 0, F.sqrt(F.col("sse") / F.col("df")))
    long = (fitted.select(*keys, df, "sse", F.inline(rows))
            .withColumn("residual_sd", sd)
            .withColumn("std_error", F.col("residual_sd") * F.sqrt("spread"))
            .withColumn("t_value", (F.col("estimate") - F.col("null_value"))
                        / F.nullif(F.col("std_error"), F.lit(0.0))))
    return long.select(*keys, "parameter", "estimate", "std_error", "t_value",
                       student_tail(F.col("t_value"), F.col("df")).alias("p_value"),
                       "residual_sd", "df")
