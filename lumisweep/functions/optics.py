"""Absorption, quantum efficiency, reflectance and responsivity as columns.

One row is one (stack, wavelength, angle).  Expected columns:

``lambda_nm``; ``thickness_si``, ``thickness_sio2``, ``thickness_si3n4`` in m;
``n_si``, ``k_si``, ``alpha_si`` (1/cm); ``n_sio2``, ``k_sio2``; ``n_si3n4``,
``k_si3n4``; ``n_env``; and ``angle_deg`` unless the light comes in at 0 degrees.

Spark has no complex type: a complex value is a pair of columns ``*r``, ``*i``.  The
formula is a list of named steps that refer to earlier ones; ``apply_steps`` puts them
into one select with lateral aliases, so that every value is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Planck constant [J s], speed of light [m/s], elementary charge [C].
PLANCK = 6.62606896e-34
LIGHT_SPEED = 299792458.0
CHARGE = 1.602176487e-19
QE_PER_NM = CHARGE * 1e-9 / (PLANCK * LIGHT_SPEED)


def absorption(alpha_per_cm: Column, thickness_m: Column) -> Column:
    """Absorbed share of the light in one pass."""
    return 1 - F.exp(-alpha_per_cm * 100 * thickness_m)


def quantum_eff(lambda_nm: Column) -> Column:
    """Ideal responsivity in A/W at a wavelength (T4)."""
    return lambda_nm * F.lit(QE_PER_NM)


def layer_angle(n_env: Column, angle_deg: Column, n: Column) -> Column:
    """Angle in radians inside a layer with real index ``n`` (T5)."""
    return F.asin(n_env * F.sin(F.radians(angle_deg)) / n)


Step = tuple[str, str]


def apply_steps(df: DataFrame, steps: Sequence[Step], keep: Sequence[str]) -> DataFrame:
    """Add the columns ``keep`` of a list of ``(name, SQL expression)`` steps."""
    wide = df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in steps])
    return wide.select(*df.columns, *keep)


def reflectance_steps(sio2: str, si3n4: str, out: str, tilted: bool) -> list[Step]:
    """Steps of the reflectance of Si3N4 on SiO2 on Si.

    The field at the substrate, (1, y_si), is carried up through the two layers with
    their characteristic matrices to (B, C); R = |y0 B - C|^2 / |y0 B + C|^2.  The 1/c
    that the admittances of the textbook form share cancels and is left out.
    """
    p = f"_{out}"
    layers = {"2": ("n_sio2", "k_sio2", sio2), "1": ("n_si3n4", "k_si3n4", si3n4)}
    steps: list[Step] = []
    if tilted:
        steps += [(f"{p}sin", "n_env * sin(radians(angle_deg))"),
                  (f"{p}cos0", "cos(radians(angle_deg))"),
                  (f"{p}cos3", f"sqrt(1 - {p}sin * {p}sin / (n_si * n_si))")]
        steps += [(f"{p}cos{i}", f"sqrt(1 - {p}sin * {p}sin / ({n} * {n}))")
                  for i, (n, _, _) in layers.items()]
    for i, (n, _, d) in layers.items():
        slant = f" * {p}cos{i}" if tilted else ""
        steps += [(f"{p}phi{i}", f"2e9D * pi() / lambda_nm * {n} * {d}{slant}"),
                  (f"{p}c{i}", f"cos({p}phi{i})"), (f"{p}s{i}", f"sin({p}phi{i})")]
    for mode in ("te", "tm") if tilted else ("",):
        q = f"{p}{mode}"
        tilt = {"": "", "te": f" * {p}cos%s", "tm": f" / {p}cos%s"}[mode]

        def admittance(column: str, i: str, tilt: str = tilt) -> str:
            return column + (tilt % i if tilt else "")

        steps += [(f"{q}y0", admittance("n_env", "0")), (f"{q}br3", "1.0D"), (f"{q}bi3", "0.0D"),
                  (f"{q}cr3", admittance("n_si", "3")), (f"{q}ci3", admittance("k_si", "3"))]
        for i, below in (("2", "3"), ("1", "2")):
            n, k, _ = layers[i]
            yr, yi, c, s = f"{q}yr{i}", f"{q}yi{i}", f"{p}c{i}", f"{p}s{i}"
            br, bi, cr, ci = (f"{q}{v}{below}" for v in ("br", "bi", "cr", "ci"))
            steps += [
                (yr, admittance(n, i)), (yi, admittance(k, i)),
                (f"{q}q{i}", f"{s} / ({yr} * {yr} + {yi} * {yi})"),
                (f"{q}br{i}", f"{c} * {br} + {q}q{i} * ({yi} * {cr} - {yr} * {ci})"),
                (f"{q}bi{i}", f"{c} * {bi} + {q}q{i} * ({yi} * {ci} + {yr} * {cr})"),
                (f"{q}cr{i}", f"{c} * {cr} - {s} * ({yi} * {br} + {yr} * {bi})"),
                (f"{q}ci{i}", f"{c} * {ci} + {s} * ({yr} * {br} - {yi} * {bi})")]
        steps += [(f"{q}ur", f"{q}y0 * {q}br1"), (f"{q}ui", f"{q}y0 * {q}bi1"),
                  (f"{q}dr", f"{q}ur - {q}cr1"), (f"{q}di", f"{q}ui - {q}ci1"),
                  (f"{q}er", f"{q}ur + {q}cr1"), (f"{q}ei", f"{q}ui + {q}ci1"),
                  (f"{out}_{mode}" if mode else out,
                   f"({q}dr * {q}dr + {q}di * {q}di) / ({q}er * {q}er + {q}ei * {q}ei)")]
    if tilted:
        steps.append((out, f"({out}_te + {out}_tm) / 2"))
    return steps


def with_reflectance(df: DataFrame, sio2: str = "thickness_sio2",
                     si3n4: str = "thickness_si3n4", out: str = "r",
                     tilted: bool = True) -> DataFrame:
    """Add ``<out>_te``, ``<out>_tm`` and their mean ``<out>``.

    With ``tilted=False`` the light comes in at 0 degrees, both polarisations are
    equal and only ``<out>`` is computed.
    """
    keep = [f"{out}_te", f"{out}_tm", out] if tilted else [out]
    return apply_steps(df, reflectance_steps(sio2, si3n4, out, tilted), keep)


def with_responsivity(df: DataFrame, tilted: bool = True) -> DataFrame:
    """Add absorption, quantum_eff, r, t and the responsivity ``sabs``.

    With ``tilted`` also ``r_te``, ``r_tm``, ``t_te``, ``t_tm``.
    """
    steps = reflectance_steps("thickness_sio2", "thickness_si3n4", "r", tilted)
    modes = ["_te", "_tm", ""] if tilted else [""]
    steps += [(f"t{m}", f"1 - r{m}") for m in modes]
    steps += [("absorption", "1 - exp(-alpha_si * 100 * thickness_si)"),
              ("quantum_eff", f"lambda_nm * {QE_PER_NM!r}D"),
              ("sabs", "absorption * quantum_eff * t")]
    return apply_steps(df, steps, [*[f"r{m}" for m in modes], *[f"t{m}" for m in modes],
                                   "absorption", "quantum_eff", "sabs"])
