"""Helpers shared by the operators: scratch tables, column picking, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch of whole texts on its way to a Python worker or back.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the workers of the session, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lumisweep-code-")) / "lumisweep_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches of this session by bytes, unless it asks for smaller ones.

    Executor and Python worker both hold a batch outside the heap, in buffers that double as
    they grow; Spark's own limit lets 10,000 long texts go at once.
    """
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", spark.conf.get(_BATCH_CONF).lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master, as in tests, may go without; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lumisweep-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: later steps, repeated tasks and lost executors read the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumisweep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of ``name type, ...`` with the few types the operators return."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def record_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)],
        schema=schema)
