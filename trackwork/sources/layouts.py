"""Timing sheets: many CSV files, each with its own header."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork.functions.cleaning import clean_name, resolve_role, train_number, unique_names
from trackwork.functions.clock import parse_clock
from trackwork.operators.skew import top_per_group
from trackwork.sources.readers import with_lineage

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


#: Lines that a quoted header may run over.
HEADER_LINES = 8


def whole_header(lines: list[str]) -> str:
    """The first line, and those after it that a quoted name with line breaks takes up."""
    for n in range(1, len(lines) + 1):
        header = "\n".join(lines[:n])
        if header.count('"') % 2 == 0:
            return header
    return lines[0]


def header_groups(spark: SparkSession, path) -> dict[str, list[str]]:
    """Header -> files that start with it."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where(F.col("file_block_start") == 0).withColumn("_n", F.monotonically_increasing_id())
    first = top_per_group(first, ["file_path"], ["_n"], HEADER_LINES)
    first = first.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("_n", "value")))["value"].alias("lines"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file_path").toLocalIterator():
        groups.setdefault(whole_header(row.lines).lstrip("\ufeff"), []).append(row.file_path)
    return groups


def read_layout(spark: SparkSession, header: str, files: list[str]) -> DataFrame:
    """Files of one layout, all columns text under their sanitised names."""
    names = unique_names([clean_name(c) for c in next(csv.reader(io.StringIO(header)))])
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return with_lineage(reader.option("escape", '"').option("multiLine", "\n" in header).csv(files))


def union_layouts(frames: list[DataFrame]) -> DataFrame:
    """All rows of all layouts; a column a layout lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_timings(spark: SparkSession, path) -> DataFrame:
    """Every sheet under a path, each read under its own header."""
    groups = header_groups(spark, path)
    return union_layouts([read_layout(spark, h, files) for h, files in groups.items()])


def running_days(df: DataFrame):
    """Days a train runs: the days column, or the weekday columns marked yes."""
    named = resolve_role(df, "days")
    flags = [c for c in WEEKDAYS if c in df.columns]
    marked = F.concat_ws(", ", *(F.when(F.lower(F.trim(c)) == "yes", F.initcap(F.lit(c))) for c in flags))
    if named is None:
        return marked if flags else F.lit(None).cast("string")
    return F.coalesce(F.col(named), F.nullif(marked, F.lit(""))) if flags else F.col(named)


def canonical_timings(df: DataFrame) -> DataFrame:
    """One layout in common columns: who runs, from where to where, when."""

    def role(name: str):
        column = resolve_role(df, name)
        return F.col(column) if column else F.lit(None).cast("string")

    return df.select(
        train_number(role("train_no")).alias("train_no"),
        F.trim(role("train_name")).alias("train_name"),
        F.trim(role("origin")).alias("origin"),
        F.trim(role("destination")).alias("destination"),
        parse_clock(role("arrival")).alias("arrival_min"),
        parse_clock(role("departure")).alias("departure_min"),
        running_days(df).alias("days"),
        *(c for c in ("_source_file", "_ingest_ts") if c in df.columns),
    )


def read_canonical_timings(spark: SparkSession, path) -> DataFrame:
    """Every sheet under a path in common columns, roles resolved per layout."""
    groups = header_groups(spark, path)
    return union_layouts([canonical_timings(read_layout(spark, h, f)) for h, f in groups.items()])
