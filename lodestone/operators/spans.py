"""Joins of lines with line ranges as equi-joins on bins, so that no file's lines meet all of its ranges in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256


def bin_of(line: Column) -> Column:
    """The bin of a line."""
    return F.floor(line / BIN).cast("int")


def binned(ranges: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """ranges with __bin, a row for each bin that a range touches; a range without lines, or a null end, has none."""
    return ranges.filter(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end)))))


def within(ranges: DataFrame, lines: DataFrame, line: str, how: str = "inner", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """binned(ranges) joined with lines of the same file_path that lie in them; columns of lines but file_path must differ from those of ranges.

    A pair of range and line meets in one bin only, so an inner join has it once; a semi-join has a range once per bin.
    """
    placed = lines.withColumnRenamed("file_path", "__file").withColumn("__line_bin", bin_of(F.col(line)))
    near = (F.col("file_path") == F.col("__file")) & (F.col("__bin") == F.col("__line_bin")) & F.col(line).between(F.col(start), F.col(end))
    return binned(ranges, start, end).join(placed, near, how).drop("__bin", "__line_bin", "__file")
