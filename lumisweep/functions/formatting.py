"""Engineering and SI number text, column name cleaning (scalar group, P3)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SI prefixes by power of ten, -24 .. 24 in steps of 3.
SI_PREFIXES = ["y", "z", "a", "f", "p", "n", "u", "m", "",
               "k", "M", "G", "T", "P", "E", "Z", "Y"]


def _number_text(value: Column) -> Column:
    """Text of a number below 1000 with 15 significant digits at most."""
    size = F.abs(value)
    kept = (F.when(size >= 100, F.round(value, 12))
            .when(size >= 10, F.round(value, 13))
            .otherwise(F.round(value, 14)))
    return F.regexp_replace(kept.cast("string"), r"\.0$", "")


def format_eng(x: Column) -> Column:
    """Mantissa with seven significant digits and an exponent divisible by 3.

    ``123456`` -> ``"123.456e3"``; 0 -> ``"0e0"``.
    """
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    raw = F.round(x / F.pow(F.lit(10.0), exponent), 6)
    carry = F.abs(raw) >= 10
    mantissa = F.when(carry, raw / 10).otherwise(raw)
    exponent = F.when(carry, exponent + 1).otherwise(exponent)
    step = F.pmod(exponent, F.lit(3))
    scaled = F.round(mantissa * F.pow(F.lit(10.0), step), 6)
    text = F.concat(F.regexp_replace(scaled.cast("string"), r"\.0$", ""), F.lit("e"),
                    (exponent - step).cast("string"))
    return F.when(x == 0, F.lit("0e0")).otherwise(text)


def format_si(x: Column, unit: str = "") -> Column:
    """Number with an SI prefix and without blanks: ``1.5e-6, "m"`` -> ``"1.5um"``."""
    # Compared with the factors themselves, so 1e-9 is exactly one nano.
    index = F.lit(0)
    factor = F.lit(1.0)
    for i in range(len(SI_PREFIXES)):
        power = float(f"1e{3 * i - 24}")
        index = F.when(F.abs(x) >= power, F.lit(i + 1)).otherwise(index)
        factor = F.when(F.abs(x) >= power, F.lit(power)).otherwise(factor)
    prefix = F.element_at(F.array(*[F.lit(p) for p in SI_PREFIXES]), F.greatest(index, F.lit(1)))
    prefix = F.when(index == 0, F.lit("")).otherwise(prefix)
    return F.concat(_number_text(x / factor), prefix, F.lit(unit))


def format_fixed(x: Column, digits: int) -> Column:
    """Fixed notation with all digits (no exponent).

    The scaled number is rounded, half away from zero, not its decimal text: 0.06545, which lies
    below the middle, gives 0.0654.
    """
    scale = F.lit(float(10 ** digits))
    return (F.round(x * scale) / scale).cast(f"decimal(38,{digits})").cast("string")


def clean_name(name: str) -> str:
    """``"Wellenlänge [nm]"`` -> ``"wellenlange"``: unit dropped, ASCII, snake case."""
    text = re.sub(r"\[[^\]]*\]\s*$", "", name).strip().replace("ß", "ss").replace("µ", "u")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return text or "x"


def clean_name_column(name: Column) -> Column:
    """The same cleaning as an expression, for names that are data."""
    text = F.trim(F.regexp_replace(name, r"\[[^\]]*\]\s*$", ""))
    text = F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("u"))
    text = F.translate(text, "äöüÄÖÜéèêáàâíìîóòôúùûçñÅåØø", "aouAOUeeeaaaiiiooouuucnAaOo")
    text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2")
    text = F.lower(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"),
                                    r"^_+|_+$", ""))
    return F.when(text == "", F.lit("x")).otherwise(text)


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case all column names; repeated names get a running suffix."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        cleaned = clean_name(name)
        seen[cleaned] = seen.get(cleaned, 0) + 1
        names.append(cleaned if seen[cleaned] == 1 else f"{cleaned}_{seen[cleaned]}")
    return df.toDF(*names)


def title_names(df: DataFrame) -> DataFrame:
    """Title-case all column names: ``run_order`` -> ``Run_order``, ``ubr_V`` -> ``Ubr_v``."""
    return df.toDF(*[" ".join(w.capitalize() for w in n.split(" ")) for n in df.columns])
