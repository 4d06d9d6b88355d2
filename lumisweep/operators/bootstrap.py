"""Bootstrap intervals of means in one pass.

Every row enters every replicate with a Poisson(1) weight, which is what drawing with
replacement from many rows comes to.  The weight is a hash of the row's number and the
replicate, so a repeated task, another partitioning and another session draw the same, and
no replicate needs a pass of its own.  Sums combine before the shuffle: a task sends one row
per key and replicate, whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.operators.keyed import join_on, with_keys

REPLICATES = 200
PRIME = 2 ** 31 - 1
#: Multipliers of the hash, primitive roots of the prime.
FACTORS = (48271, 69621, 39373)
#: P(Poisson(1) <= k) for k = 0 .. 6; beyond, the weight is 7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def uniform(row: Column, replicate: Column) -> Column:
    """A number from 0 to 1 that both integers determine."""
    h = (row.cast("long") % PRIME * FACTORS[0] + replicate.cast("long") * FACTORS[1] + 1) % PRIME
    for factor in FACTORS:
        h = h.bitwiseXOR(F.shiftright(h, 15)) % PRIME * factor % PRIME
    return h / float(PRIME)


def poisson_weight(u: Column) -> Column:
    out = F.lit(0)
    for limit in POISSON:
        out = out + (u >= limit).cast("int")
    return out


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, row: str,
                   replicates: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """``keys, n, mean, low, high``: mean and the percentile interval of its replicates.

    ``row`` is an integer that tells the rows of a key apart; it need not be dense.  NULL
    values take no part, nor do rows without a number; a replicate that draws no row of a key
    is left out.
    """
    rows, by = with_keys(df, list(keys))
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"), F.col(row).alias("_row")).where(
        F.col("_v").isNotNull() & F.col("_row").isNotNull())
    drawn = rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn(
        "_w", poisson_weight(uniform(F.col("_row"), F.col("_r"))))
    sums = drawn.groupBy(*by, "_r").agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_mean"))
    tail = (1 - level) / 2
    ends = sums.groupBy(*by).agg(F.percentile("_mean", [tail, 1 - tail]).alias("_ends"))
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    return join_on(plain, ends, by).select(
        *keys, "n", "mean", F.get("_ends", F.lit(0)).alias("low"), F.get("_ends", F.lit(1)).alias("high"))
