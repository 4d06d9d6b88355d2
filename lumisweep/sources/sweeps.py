"""Sweep files: one instrument file per (operator, run order, part, repeat).

A sweep file is read as one row, so header and footer are cut by position inside
the row and nothing is shuffled.  Its size is bounded by the instrument (about two
thousand samples).  ``read_long_sweeps`` gives the same samples of files of any size, which
are read in blocks by as many tasks as they have blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisweep.functions.rounding import decimal_comma_to_double, round_even

EXCLUDED_PARTS = (1, 2, 3, 4)
NAME_PATTERN = r"^([^_]+)_([^_]*\d[^_]*)_([^_]*\d[^_]*)_([^_.]{3})[^_]*$"


def parse_sweep_name(name: Column) -> dict[str, Column]:
    """Identity columns of a file name such as ``OP_RO85_part6_001.CSV`` (S3)."""
    def group(i: int) -> Column:
        return F.regexp_extract(name, NAME_PATTERN, i)

    def number(i: int) -> Column:
        return F.regexp_replace(group(i), r"\D", "").try_cast("int")

    return {"operator": F.nullif(group(1), F.lit("")), "run_order": number(2),
            "part": number(3), "repeat": F.nullif(group(4), F.lit(""))}


def lines_of(text: Column) -> Column:
    """Lines of a file, whatever the line ends, without an empty last one."""
    # A search in the whole text takes longer than all else; the last end is in the last bytes.
    tail = F.regexp_replace(F.right(text, F.lit(4)), r"(?:\r\n|\n|\r)$", "")
    cut = F.concat(F.substring(text, F.lit(1), F.length(text) - 4), tail)
    one_end = F.replace(F.replace(cut, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(F.when(F.contains(cut, F.lit("\r")), one_end).otherwise(cut), "\n")


def sweep_files(spark: SparkSession, path: str | Sequence[str],
                pattern: str = "*.CSV") -> DataFrame:
    """One row per sweep file: ``file``, its identity, ``content``.

    The name pattern is applied while listing, before a file is opened.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    return files.withColumns(parse_sweep_name(F.col("file")))


def has_identity() -> Column:
    return (F.col("operator").isNotNull() & F.col("run_order").isNotNull()
            & F.col("part").isNotNull() & F.col("repeat").isNotNull())


def rejected_files(files: DataFrame) -> DataFrame:
    """Files whose name does not carry an identity; they never stop a job."""
    return files.where(~has_identity()).select("file")


def _numbers(fields: Column, digits: int | None, round_after_unit: bool, to_mhz: bool
             ) -> tuple[Column, Column]:
    """Frequency and level from the fields of a sample line; see ``packed_sweeps``."""
    def rounded(c: Column) -> Column:
        return c if digits is None else round_even(c, digits)

    raw = decimal_comma_to_double(fields[0])
    f = (rounded(raw) if not to_mhz else
         rounded(raw / 1e6) if round_after_unit else rounded(raw) / 1e6)
    return f, rounded(decimal_comma_to_double(F.get(fields, F.lit(1))))


def _sample_lines(files: DataFrame, skip_head: int, skip_foot: int, max_rows: int | None,
                  exclude_parts: Sequence[int]) -> tuple[DataFrame, Column]:
    """The files that are kept with ``_lines``, and the array of their sample lines."""
    kept = files.where(has_identity())
    if exclude_parts:
        kept = kept.where(~F.col("part").isin(*exclude_parts))
    length = F.greatest(F.size("_lines") - skip_head - skip_foot, F.lit(0))
    if max_rows is not None:
        length = F.least(length, F.lit(max_rows))
    return (kept.withColumn("_lines", lines_of(F.col("content"))),
            F.slice("_lines", F.lit(skip_head + 1), length))


def packed_sweeps(files: DataFrame, skip_head: int = 3, skip_foot: int = 11,
                  digits: int | None = 5, round_after_unit: bool = False,
                  max_rows: int | None = None, to_mhz: bool = True,
                  exclude_parts: Sequence[int] = EXCLUDED_PARTS) -> DataFrame:
    """Parse the samples of each file into an array ``points`` of ``pos, f, a``.

    Frequencies are rounded in Hz and then scaled, or the other way round with
    ``round_after_unit``.  The other reader of these files is
    ``skip_foot=0, max_rows=1000, round_after_unit=True``.  Fields that are not
    numbers become NULL.
    """
    def sample(fields: Column, i: Column) -> Column:
        f, a = _numbers(fields, digits, round_after_unit, to_mhz)
        return F.struct(i.alias("pos"), f.alias("f"), a.alias("a"))

    kept, body = _sample_lines(files, skip_head, skip_foot, max_rows, exclude_parts)
    # Split first: a function of array elements does not share its common parts.
    fields = F.transform(body, lambda line: F.split(line, ";"))
    return (kept.withColumn("points", F.transform(fields, sample))
            .select("file", "operator", "run_order", "part", "repeat", "points"))


def sweep_samples(files: DataFrame, skip_head: int = 3, skip_foot: int = 11,
                  digits: int | None = 5, round_after_unit: bool = False,
                  max_rows: int | None = None, to_mhz: bool = True,
                  exclude_parts: Sequence[int] = EXCLUDED_PARTS) -> DataFrame:
    """The samples of ``packed_sweeps``, one row each; same options.

    Lines become rows before they are parsed, so that the parsing is compiled; inside an array
    it is interpreted.
    """
    kept, body = _sample_lines(files, skip_head, skip_foot, max_rows, exclude_parts)
    names = ["file", "operator", "run_order", "part", "repeat"]
    # The outer form and the condition on its row: see ``unpack_sweep``.
    lines = kept.select(*names, F.posexplode_outer(body).alias("pos", "_line")).where(
        F.col("pos").isNotNull())
    f, a = _numbers(F.col("_fields"), digits, round_after_unit, to_mhz)
    return lines.select(*names, "pos", F.split("_line", ";").alias("_fields")).select(
        *names, "pos", f.alias("f"), a.alias("a"))


def read_sweeps(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.CSV",
                **options) -> DataFrame:
    """Samples of all sweep files of a folder, one row each (S2; S9 for one file)."""
    return sweep_samples(sweep_files(spark, path, pattern), **options)


def numbered_lines(spark: SparkSession, path: str | Sequence[str],
                   pattern: str = "*.CSV") -> DataFrame:
    """``path, file, line, pos, lines``: every line with its place in its file and their number.

    A file is read in blocks.  Inside a block the lines have consecutive row numbers of their
    task, so a line's place is its distance from the block's first line plus the lines of the
    blocks before it.  Only one row per block is shuffled for that, and the lines meet it in a
    join that is broadcast where the table of blocks is small.  Both reads list the same files
    in the same blocks, since they share one plan of the input.
    """
    lines = spark.read.text(path, pathGlobFilter=pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_row"))
    blocks = lines.groupBy("path", "_block").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of_file = Window.partitionBy("path")
    earlier = of_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("path", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                                              - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(of_file).alias("lines"))
    return lines.join(placed, ["path", "_block"]).select(
        "path", "file", "line", (F.col("_row") + F.col("_shift")).alias("pos"), "lines")


def read_long_sweeps(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.CSV",
                     skip_head: int = 3, skip_foot: int = 11, digits: int | None = 5,
                     round_after_unit: bool = False, max_rows: int | None = None,
                     to_mhz: bool = True, exclude_parts: Sequence[int] = EXCLUDED_PARTS
                     ) -> DataFrame:
    """The samples of ``read_sweeps``, read in blocks; same options."""
    lines = numbered_lines(spark, path, pattern)
    rows = lines.withColumns(parse_sweep_name(F.col("file"))).where(has_identity())
    if exclude_parts:
        rows = rows.where(~F.col("part").isin(*exclude_parts))
    at = F.col("pos") - skip_head
    body = (at >= 0) & (F.col("pos") < F.col("lines") - skip_foot)
    if max_rows is not None:
        body = body & (at < max_rows)
    f, a = _numbers(F.split("line", ";"), digits, round_after_unit, to_mhz)
    return rows.where(body).select("file", "operator", "run_order", "part", "repeat",
                                   at.cast("int").alias("pos"), f.alias("f"), a.alias("a"))
