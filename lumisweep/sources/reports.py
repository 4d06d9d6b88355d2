"""Sectioned measurement reports.

Each file is read once, as one row of lines.  Header, recipe, data and errors are
four projections of that row; nothing is shuffled and a bad file becomes a row of
``report_errors``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.functions.formatting import clean_name_column
from lumisweep.functions.rounding import decimal_comma_to_double
from lumisweep.operators.keyed import text_positions
from lumisweep.sources.sweeps import lines_of

# Section marks and the labels of the wanted fields.
SECTIONS = {"header": "[Allgemein]", "recipe": "[Einstellungen Messung]", "data": "[Messwerte]"}
HEADER_LABELS = {"date": "Datum:", "article_name": "Bauteil:", "fa_nr": "Charge:",
                 "wafer_batch": "Wafer:", "device_nr": "Bauteil-Nr.:",
                 "temperature": "Temperatur:"}
RECIPE_LABELS = {"filter_counts": "Filter Counts:", "delay": "Delay:", "nplc": "NPLC:",
                 "voltage": "Spannung:", "channel_b": "Kanal B:",
                 "dark_current": "Id Kanal A:"}
DATA_COLUMNS = ("wellenlange", "empfindlichkeit")


def report_lines(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv",
                 charset: str = "UTF-8") -> DataFrame:
    """One row per report: ``file``, its non-blank ``lines`` and the section positions."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return parse_report_lines(raw.select("path", "content"), charset)


def parse_report_lines(raw: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """The same for a table of ``path`` and binary ``content``."""
    # Function by function: what is used several times is computed in a step of its own.
    text = F.regexp_replace(F.decode("content", charset), "^﻿", "").alias("_text")
    split = raw.select("path", text).select("path", lines_of(F.col("_text")).alias("_split"))
    files = split.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("path"),
                         F.filter("_split", lambda x: F.trim(x) != "").alias("lines"))
    return files.withColumns({f"_{name}": _first_line_with(mark).cast("int")
                              for name, mark in SECTIONS.items()})


def _first_line_with(mark: str) -> Column:
    """1-based number of the first line that contains ``mark``, else 0."""
    found = F.transform("lines", lambda x: F.contains(x, F.lit(mark)))
    return F.array_position(found, True)


def _complete() -> Column:
    return (F.col("_header") > 0) & (F.col("_recipe") > F.col("_header")) & (
        F.col("_data") > F.col("_recipe")) & (F.size("lines") >= F.col("_data") + 2)


def report_errors(reports: DataFrame) -> DataFrame:
    """Files without all three sections in order, and why."""
    reason = (F.when(F.col("_header") == 0, F.lit("no header section"))
              .when(F.col("_recipe") == 0, F.lit("no recipe section"))
              .when(F.col("_data") == 0, F.lit("no data section"))
              .when(F.size("lines") < F.col("_data") + 2, F.lit("no data header"))
              .otherwise(F.lit("sections out of order")))
    return reports.where(~_complete()).select("file", "path", reason.alias("reason"))


def _field(zone: Column, label: str) -> Column:
    """Text after the label in the first line of the zone that has it, else NULL."""
    tokens = F.flatten(F.transform(F.filter(zone, lambda x: F.contains(x, F.lit(label))),
                                   lambda x: F.split(x, ";")))
    at = F.array_position(F.transform(tokens, lambda x: F.contains(x, F.lit(label))), True)
    value = F.get(tokens, at.cast("int"))
    return F.when(at > 0, F.nullif(F.trim(value), F.lit("")))


def report_header(reports: DataFrame) -> DataFrame:
    """Six text fields of the first section, one row per file."""
    zone = F.slice("lines", F.col("_header"), F.col("_recipe") - F.col("_header"))
    return reports.where(_complete()).select("file", "path", *[
        _field(zone, label).alias(name) for name, label in HEADER_LABELS.items()])


def report_recipe(reports: DataFrame) -> DataFrame:
    """Six text fields of the second section, one row per file."""
    zone = F.slice("lines", F.col("_recipe"), F.col("_data") - F.col("_recipe"))
    return reports.where(_complete()).select("file", "path", *[
        _field(zone, label).alias(name) for name, label in RECIPE_LABELS.items()])


def report_values(reports: DataFrame) -> DataFrame:
    """All named fields in long form: ``file, path, pos, column, value`` (text)."""
    pairs = F.filter(F.arrays_zip(F.col("_names").alias("column"),
                                  F.col("_tokens").alias("value")),
                     lambda x: F.coalesce(x["column"], F.lit("")) != "")
    return _data_lines(reports).select("file", "path", "pos", F.inline(pairs))


def _named_lines(reports: DataFrame) -> DataFrame:
    """One row per good file: ``file, path, _names`` and its data lines, ``_rows``.

    The names are computed here, once for a file and not for each of its lines.
    """
    rows = F.slice("lines", F.col("_data") + 3, F.size("lines") - F.col("_data") - 2)
    head = F.split(F.element_at("lines", F.col("_data") + 2), ";")
    names = F.transform(head, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(
        clean_name_column(x)))
    plain = reports.where(_complete()).select("file", "path", names.alias("_plain"),
                                              rows.alias("_rows"))
    return plain.select("file", "path", _numbered("_plain").alias("_names"), "_rows")


def _data_lines(reports: DataFrame) -> DataFrame:
    return (_named_lines(reports)
            .select("file", "path", "_names", F.posexplode("_rows").alias("pos", "_line"))
            .withColumn("_tokens", F.split("_line", ";")))


def _numbered(names: str) -> Column:
    """The names of a file's data columns; a name's later uses end in _2, _3, ..."""
    def numbered(name: Column, at: Column) -> Column:
        uses = F.size(F.filter(F.slice(names, F.lit(1), at + 1), lambda x: x == name))
        return F.when((uses > 1) & (name != ""), F.concat(
            name, F.lit("_"), uses.cast("string"))).otherwise(name)

    return F.transform(names, numbered)


def report_columns(reports: DataFrame) -> DataFrame:
    """``name`` of every data column of any file: one pass over the header lines."""
    return (_named_lines(reports).select(F.explode("_names").alias("name"))
            .where("name <> ''").distinct())


def report_data(reports: DataFrame, columns: Sequence[str] = DATA_COLUMNS) -> DataFrame:
    """Measured rows: ``file, path, pos`` and the wanted columns as doubles.

    A column that a file does not have is NULL there; unnamed columns are dropped.
    ``report_columns`` lists what the files have.
    """
    places = [F.array_position("_names", c).cast("int").alias(f"_at_{i}")
              for i, c in enumerate(columns)]

    def value(tokens: Column, i: int) -> Column:
        at = F.col(f"_at_{i}")
        return F.when(at > 0, decimal_comma_to_double(F.get(tokens, at - 1)))

    # Values are made inside the array, so that a filter on them does not make them again.
    rows = F.transform(F.transform("_rows", lambda x: F.split(x, ";")), lambda t, i: F.struct(
        i.alias("pos"), *[value(t, n).alias(c) for n, c in enumerate(columns)]))
    return (_named_lines(reports).select("file", "path", "_rows", *places)
            .select("file", "path", F.inline(rows)))


def header_ids(reports: DataFrame) -> DataFrame:
    """``path`` and the 1-based ordinal of each good file, ``header_id``.

    All files are numbered, folder by folder and by name within one; files with errors keep
    their number and are then left out.  No task orders a whole folder: files are dealt into
    even ranges of their whole paths.
    """
    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    # Folders come in order, and in each its paths: no path holds the zero between them.
    files = reports.select("path", _complete().alias("_good"),
                           F.concat(folder, F.lit("\0"), F.col("path")).alias("_order"))
    return (text_positions(files, "_order", "_at").where("_good")
            .select("path", (F.col("_at") + 1).alias("header_id")))


def measured_with_header(data: DataFrame, header: DataFrame,
                         columns: Sequence[str] = ("article_name", "fa_nr", "device_nr")
                         ) -> DataFrame:
    """Left join of header columns to the measured rows on the file."""
    return data.join(header.select("path", *columns), "path", "left")
