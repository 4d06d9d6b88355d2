"""CSV sinks with decimal commas, the space-separated plan table (K1, K2), tables kept on the way."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lumisweep.functions.rounding import double_to_decimal_comma
from lumisweep.operators.keyed import dense_positions


def decimal_comma_text(df: DataFrame) -> DataFrame:
    """Fractional columns as text with a decimal comma; all others as they are."""
    return df.withColumns({f.name: double_to_decimal_comma(F.col(f.name)) for f in df.schema
                           if isinstance(f.dataType, (DoubleType, FloatType))})


def write_decimal_comma_csv(df: DataFrame, path: str, order: Sequence[str] = (),
                            single_file: bool = False, mode: str = "errorifexists") -> None:
    """``;`` separated with a header and decimal commas (K1).

    Written in parallel, sorted by ``order`` across the files.  ``single_file`` is
    for rolled-up results of known small size.
    """
    out = df.orderBy(*order) if order else df
    out = decimal_comma_text(out)
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).csv(path, sep=";", header=True)


def write_plan_table(df: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """Space separated, text quoted, with a running row name in front (K2)."""
    named = dense_positions(df, [], order, out="_row").select(
        (F.col("_row") + 1).cast("string").alias(" "), *df.columns)
    named.orderBy(F.col("` `").cast("long")).coalesce(1).write.mode(mode).csv(
        path, sep=" ", header=True, quoteAll=True, emptyValue='""')


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once for all results that read them.

    Written now as a table in ``spark.checkpoint.dir``, the folder that all executors share;
    a session without one caches the rows instead.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        return df.persist()
    path = f"{folder}/lumisweep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
