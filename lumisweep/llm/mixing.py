"""Mixing sources to target weights (operator 3): a time-varying curriculum.

Each source has a weight and a schedule of its demand over training time 0..1.  A
schedule is a line from ``start`` to ``end`` times the weight with mean 1, so its integral
is the source's target.  The documents of a source stand in a fixed pseudo-random order
(MD5 of ``doc_id``); a document starts where the earlier ones of its source have used up
``c`` words of the target, and its training position is the time at which the source's
cumulative demand reaches ``c``: the inverse of the integrated schedule.  Sorting all
documents by position gives the training order.

Targets are shares of all words by weight, at most ``max_repeats`` times the source's words;
what exceeds that is shared among the others by weight.  A source is repeated as a whole as
often as the target holds it, then once more up to the target; the document where the
target ends is taken in part, so the words taken are the target rounded down.

Texts without words have size 0 and take nothing.  A null source is a source of its own,
last in the order.  Repeated rows are separate rows with neighbouring places; a null
``doc_id`` comes first in the order of its source.  An empty table gives an empty result.

Running sums never need a whole source in one task: rows are dealt by source and a hash
bucket, the number of buckets being the root of the number of rows, and the sums of earlier
buckets come from a table with one row per source and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisweep.llm.common import WORD, settle

WEIGHTS = (1, 2, 3)
#: Demand at the start and at the end of training, as multiples of the mean; by weight.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """One row per source: ``source, source_size, target`` and the number of its weight.

    ``sizes`` has ``source, source_size``.  The windows see one row per source.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_code) - 1) % len(weights)
    ranked = sizes.withColumn("_nth", place).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_nth") + 1))
    ranked = ranked.withColumn("_most", F.lit(max_repeats) * F.col("source_size"))
    tightest = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("_nth"),
                              F.col("source").asc_nulls_last())
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    onward = tightest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything)
              - F.coalesce(F.sum("_most").over(before), F.lit(0))) / F.sum("_weight").over(onward))
    leveled = ranked.withColumn("_level", level)
    # The common level is that of the first source, in this order, that stays below its most.
    open_level = F.when(F.col("_level") * F.col("_weight") <= F.col("_most"), F.col("_level"))
    common = F.first(open_level, ignorenulls=True).over(
        tightest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.col("_weight") * F.col("_common")
    target = F.when(F.col("_common").isNull() | (share > F.col("_most")),
                    F.col("_most").cast("double")).otherwise(share)
    return leveled.withColumn("_common", common).select(
        "source", "source_size", target.alias("target"), "_nth")


def time_of(used: Column, nth: Column, ramps: Sequence[tuple[float, float]]) -> Column:
    """Training time at which a share ``used`` of a source's demand is met.

    The integral of the schedule is ``start t + (end - start) t**2 / 2``; this is its inverse.
    """
    start = F.element_at(F.array(*[F.lit(float(a)) for a, _ in ramps]), nth + 1)
    slope = F.element_at(F.array(*[F.lit(float(b) - float(a)) for a, b in ramps]), nth + 1)
    return 2 * used / (start + F.sqrt(start * start + 2 * slope * used))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3,
                ramps: Sequence[tuple[float, float]] = RAMPS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, place, position`` of each row.

    ``place`` is where the document starts among its source's words, ``position`` the
    training time of its first copy (null where nothing is taken).
    """
    sized = settle(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    parts = max(1, math.isqrt(sized.count()))
    head = F.coalesce(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(0))
    rows = (sized.withColumn("_order", order)
            .withColumn("_part", F.floor(head * parts / (1 << 32)).cast("int"))
            .withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    here = rows.groupBy("_key", "_part").agg(
        F.min("source").alias("source"), F.sum("size").alias("_here"))
    by_source = Window.partitionBy("_key").orderBy("_part")
    offsets = here.select("_key", "_part", F.coalesce(F.sum("_here").over(
        by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    targets = source_targets(
        here.groupBy("_key").agg(F.min("source").alias("source"),
                                 F.sum("_here").alias("source_size")).drop("_key"),
        weights, max_repeats)
    targets = targets.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"),
                                                    F.lit("-"))).drop("source")
    within = (Window.partitionBy("_key", "_part").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (rows.join(offsets.join(targets, "_key"), ["_key", "_part"])
              .withColumn("place", F.col("_before") + F.sum("size").over(within) - F.col("size")))
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        whole * F.col("size")
        + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("place"))))
    position = F.when(F.col("taken") > 0, time_of(
        F.col("place") / F.greatest(F.col("target"), F.lit(1.0)), F.col("_nth"), ramps))
    return (placed.withColumn("taken", taken.cast("long")).withColumn("position", position)
            .select("doc_id", "source", "size", "source_size", "target", "taken", "place",
                    "position", "_nth"))


def training_order(mixed: DataFrame, ramps: Sequence[tuple[float, float]] = RAMPS) -> DataFrame:
    """One row per taken copy with ``copy``, ``copy_words`` and its own position, in order."""
    whole = F.col("taken") - F.col("size") * F.col("copy")
    copies = (mixed.where(F.col("taken") > 0)
              .withColumn("copy", F.explode(F.sequence(
                  F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int")))))
    used = (F.col("place") + F.col("copy") * F.col("source_size")) / F.greatest(
        F.col("target"), F.lit(1.0))
    return in_order(copies.withColumn("copy_words", F.least(F.col("size"), whole))
                    .withColumn("position", time_of(used, F.col("_nth"), ramps)).drop("_nth"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Range sort by training position; documents that the mix leaves out come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
