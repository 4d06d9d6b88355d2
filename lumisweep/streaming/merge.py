"""An exact rollup over repeats, kept up to date by a stream of files (ST1).

Results arrive file by file; repeats of a key can come in any batch, late ones too.  Each
batch adds its new files to a table of results and writes new rollup rows for the keys that it
touched, computed from all files of these keys.  Both go to a folder named by the batch, which
a repeated batch overwrites, so a restarted stream leaves what an uninterrupted one does.  A
file name counts once, however often it is fed: the first batch that brings it wins.

Reading takes the newest row per key.  What is shuffled per batch is its files and the results
of the touched keys, not the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumisweep.operators.keyed import join_on
from lumisweep.streaming.readout import stream_rollup

KEYS = ("operator", "run_order", "part")


def prepare(spark: SparkSession, folder: str, results: DataFrame) -> None:
    """Empty tables for results of this shape, unless they are there."""
    files = spark.createDataFrame([], results.schema)
    files.write.mode("ignore").parquet(f"{folder}/files/batch=-1")
    stream_rollup(files).write.mode("ignore").parquet(f"{folder}/rollup/batch=-1")


def merge_into(folder: str, keys: Sequence[str] = KEYS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: add a batch of results per file to the tables in ``folder``."""
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c != "file"]
        once = batch.groupBy("file").agg(F.min(F.struct(*others)).alias("_row")).select(
            "file", "_row.*")
        # Batches from this one on can be there after a restart; they are written again.
        earlier = spark.read.parquet(f"{folder}/files").where(F.col("batch") < number)
        fresh = once.select(*batch.columns).join(earlier.select("file"), "file", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/files/batch={number}")

        added = spark.read.schema(batch.schema).parquet(f"{folder}/files/batch={number}")
        touched = added.select(*keys).distinct()
        files = earlier.drop("batch").unionByName(added)
        rows = join_on(files, touched, list(keys), "left_semi")
        stream_rollup(rows).write.mode("overwrite").parquet(f"{folder}/rollup/batch={number}")

    return merge


def start_rollup(results: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream ``results`` (see ``stream_readout``) into the tables in ``folder``."""
    prepare(results.sparkSession, folder, results)
    return (results.writeStream.foreachBatch(merge_into(folder))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def current_rollup(spark: SparkSession, folder: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest rollup row of every key."""
    rows = spark.read.parquet(f"{folder}/rollup")
    values = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")
