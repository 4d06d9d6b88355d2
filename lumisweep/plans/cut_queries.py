"""The bucketed plans of the keyed operators on data with NULL keys, and their SQL.

Small tables never reach the row count from which the keyed operators cut their rows into
buckets; these queries ask for many buckets, so that the plans of large tables are compared
too.  Their keys are NULL for a share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisweep.functions.rounding import round_even
from lumisweep.operators import keyed, readout, resample, stats
from lumisweep.plans import views

#: Rows per bucket here; the cut points are taken while the plan is built.
FEW_ROWS = 2_000


@contextmanager
def small_buckets(rows: int = FEW_ROWS) -> Iterator[None]:
    usual = keyed.ROWS_PER_BUCKET
    keyed.ROWS_PER_BUCKET = rows
    try:
        yield
    finally:
        keyed.ROWS_PER_BUCKET = usual


def rounded(df: DataFrame, digits: int, columns: list[str]) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), digits) for c in columns})


def items(spark, sf) -> DataFrame:
    return views.table(spark, sf, "lineitem").withColumn(
        "k", F.nullif(F.col("l_linenumber").cast("int"), F.lit(3)))


def positions_cut(spark, sf):
    with small_buckets():
        found = keyed.dense_positions(items(spark, sf), ["k"], "l_extendedprice",
                                      ["l_orderkey", "l_linenumber"])
    return found.select("k", "l_orderkey", "l_linenumber", "pos")


def value_ecdf_cut(spark, sf):
    events = views.table(spark, sf, "events").select(
        F.nullif(F.col("user_id") % 4, F.lit(0)).alias("k"), "value")
    with small_buckets():
        found = stats.ecdf(events, ["k"], "value")
    return rounded(found, 8, ["ecdf"])


def decile_bands_cut(spark, sf):
    with small_buckets():
        bands = stats.decile_bands(items(spark, sf), ["k"], "l_extendedprice")
    return rounded(bands, 4, [c for c in bands.columns if c != "k"])


def box_stats_cut(spark, sf):
    values = rounded(items(spark, sf).select(
        "k", (F.col("l_extendedprice") * F.col("l_discount")).alias("value")), 4, ["value"])
    with small_buckets():
        found = stats.box_stats(values, ["k"], "value")
    return rounded(found, 8, ["q1", "median", "q3", "whisker_low", "whisker_high"])


def segments_cut(spark, sf):
    sweep = views.event_sweep(spark, sf).withColumn(
        "k", F.nullif(F.col("user_id"), F.lit(3)))
    with small_buckets():
        found = resample.linear_segments(sweep, ["k"], "f", "a")
    return rounded(found.select("k", "f", "a", "f_next", "a_next"), 6, ["a", "a_next"])


def cutoff_events_cut(spark, sf):
    sweep = views.event_sweep(spark, sf).withColumn(
        "k", F.nullif(F.col("user_id"), F.lit(3)))
    with small_buckets():
        found = readout.cutoff_readout(sweep, ["k"], 8.0, 40.0)
    return rounded(found, 6, ["plateau"])


CUT_QUERIES = {f.__name__: f for f in (positions_cut, value_ecdf_cut, decile_bands_cut,
                                       box_stats_cut, segments_cut, cutoff_events_cut)}
