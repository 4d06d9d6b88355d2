"""Unit scaling and rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def round_even(col: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back.

    This is how numpy rounds; ``F.round`` rounds half up on the decimal text
    and gives other results for values such as 0.285 or 2.5.
    """
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def round_numeric(df: DataFrame, digits: int, exclude: Iterable[str] = ()) -> DataFrame:
    """Round every fractional column of a table."""
    skip = set(exclude)
    picked = {f.name: round_even(F.col(f.name), digits) for f in df.schema
              if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in skip}
    return df.withColumns(picked) if picked else df


def hz_to_mhz(col: Column) -> Column:
    return col / F.lit(1e6)


def rise_time_ps(cutoff_mhz: Column) -> Column:
    """Rise time in ps of a band limit in MHz: 0.35 / f (W4); NULL for f = 0."""
    return F.lit(0.35) / F.nullif(cutoff_mhz, F.lit(0.0)) * F.lit(1e6)


def decimal_comma_to_double(text: Column) -> Column:
    """``"1236,88"`` -> 1236.88; NULL when it is not a number."""
    return F.trim(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")


def double_to_decimal_comma(col: Column) -> Column:
    """Shortest decimal text of a double with a comma, without exponents.

    Spark writes an exponent from 1e7 up and below 1e-3.  There the point is moved in the
    digits themselves, so every double keeps all its digits.
    """
    plain = col.cast("string")

    def part(number: int) -> Column:
        return F.regexp_extract(plain, r"^(-?)(\d)\.(\d+)E(-?\d+)$", number)

    power = part(4).cast("int")
    digits = F.concat(part(2), F.rtrim(part(3), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    long = F.rpad(digits, F.greatest(power + 2, F.length(digits)), "0")
    large = F.concat(F.substring(long, F.lit(1), power + 1), F.lit("."),
                     F.substring(long, power + 2, F.length(long)))
    fixed = F.concat(part(1), F.when(power < 0, small).otherwise(large))
    return F.translate(F.when(F.contains(plain, F.lit("E")), fixed).otherwise(plain), ".", ",")
