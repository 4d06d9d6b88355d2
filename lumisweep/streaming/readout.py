"""The cut-off readout on a stream of sweep files (ST1).

A sweep file is one input row and the packed readout needs only that row, so the
stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.operators.readout import cutoff_packed, with_rise_time
from lumisweep.sources.sweeps import packed_sweeps, parse_sweep_name


def stream_sweep_files(spark: SparkSession, path: str, pattern: str = "*.CSV",
                       files_per_trigger: int = 1000) -> DataFrame:
    """Sweep files of a folder as they arrive."""
    files = (spark.readStream.format("text").option("pathGlobFilter", pattern)
             .option("maxFilesPerTrigger", files_per_trigger).option("wholetext", "true")
             .load(path)
             .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")))
    return files.withColumns(parse_sweep_name(F.col("file")))


def stream_readout(files: DataFrame, fmin: float = 8.0, fmax: float = 100.0,
                   **options) -> DataFrame:
    """One result row per file: identity, plateau, cut-off and rise time."""
    return with_rise_time(cutoff_packed(packed_sweeps(files, **options), fmin=fmin, fmax=fmax),
                          digits=1)


def stream_rollup(results: DataFrame) -> DataFrame:
    """Mean over repeats; for the ``update`` or ``complete`` output mode.

    Its state is one row per (operator, run order, part).
    """
    return results.groupBy("operator", "run_order", "part").agg(
        F.count("*").alias("repeats"), F.avg("cutoff_mhz").alias("cutoff_mhz"),
        F.avg("risetime_ps").alias("risetime_ps"))
