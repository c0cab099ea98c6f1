"""CSV whose quoted values hold line breaks, read by as many tasks as the files have ranges.

Whether a range of a file begins inside a quoted value depends on all before it. A first pass
says for each range how it ends if it begins outside and if it begins inside quotes; these
small tables, composed in file order, give where each range begins. A second pass then cuts
every range into records, and the few that cross a boundary are put together from their parts.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framewright.session import materialize

_TO_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open behind a line, given whether one is before it.

    A quote opens a value only at its start; elsewhere in an unquoted value it is a character.
    """
    if '"' not in line:
        return inside
    at = 0
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            closing = _TO_CLOSING.match(line, at)
            if closing is None:
                return True
            at = closing.end()
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1
        inside = line.startswith('"', at)
        at += inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range: how it ends when it begins outside and when it begins inside quotes."""
    place, states = None, (False, True)
    for batch in batches:
        for file, block, line in zip(batch["file"], batch["block"], batch["value"]):
            if (file, block) != place:
                if place is not None:
                    yield pd.DataFrame([(*place, *states)], columns=["file", "block", "outside", "inside"])
                place, states = (file, block), (False, True)
            if '"' in line:
                states = ends_inside(line, states[0]), ends_inside(line, states[1])
    if place is not None:
        yield pd.DataFrame([(*place, *states)], columns=["file", "block", "outside", "inside"])


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the ranges of whole files, in order, begin."""
    current, inside = None, False
    for batch in batches:
        begins = []
        for file, outside, within in zip(batch["file"], batch["outside"], batch["inside"]):
            if file != current:
                current, inside = file, False
            begins.append(inside)
            inside = within if inside else outside
        yield batch[["file", "block"]].assign(begins_inside=begins)


RECORDS = "file string, block bigint, line bigint, open boolean, head boolean, text string"


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of each range; ``head`` marks what continues the range before, ``open`` what goes on in the next."""
    place, number, first, inside, head = None, 0, 0, False, False
    parts: list[str] = []

    def record(is_open: bool) -> tuple:
        return (*place, first, is_open, head, "\n".join(parts))

    for batch in batches:
        found = []
        for file, block, line, begins in zip(batch["file"], batch["block"], batch["value"], batch["begins_inside"]):
            if (file, block) != place:
                if parts:
                    found.append(record(True))
                place, number, first, inside, head, parts = (file, block), 0, 0, bool(begins), bool(begins), []
            if not parts:
                first = number
            parts.append(line)
            inside = ends_inside(line, inside)
            number += 1
            if not inside:
                found.append(record(False))
                parts, head = [], False
        yield pd.DataFrame(found, columns=["file", "block", "line", "open", "head", "text"])
    if parts:
        yield pd.DataFrame([record(True)], columns=["file", "block", "line", "open", "head", "text"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text): every record of the files with the place of its first line.

    ``text`` keeps the line breaks of quoted values. Blank lines are no records.
    """
    ranges = _lines(spark, path).mapInPandas(_transitions, "file string, block bigint, outside boolean, inside boolean")
    ranges = materialize(ranges, "ranges")
    begins = (
        ranges.repartition("file")
        .sortWithinPartitions("file", "block")
        .mapInPandas(_compose, "file string, block bigint, begins_inside boolean")
    )
    # One row per range of a file, a few hundred bytes for tens of megabytes.
    begins = materialize(begins, "begins").select(
        F.col("file").alias("of"), F.col("block").alias("from"), "begins_inside"
    )
    lines = _lines(spark, path).join(F.broadcast(begins), (F.col("file") == F.col("of")) & (F.col("block") == F.col("from")))
    found = materialize(lines.select("file", "block", "value", "begins_inside").mapInPandas(_records, RECORDS), "records")
    whole = found.where(~F.col("open") & ~F.col("head")).select("file", "block", "line", "text")
    # A part that is no head begins a record; the heads that follow it belong to it.
    order = W.partitionBy("file").orderBy("block", "line")
    start = F.when(~F.col("head"), F.struct("block", "line"))
    crossing = found.where(F.col("open") | F.col("head")).withColumn("start", F.last(start, True).over(order))
    joined = crossing.groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda part: part["text"]), "\n")
    crossing = joined.select("file", "start.block", "start.line", text.alias("text"))
    return whole.unionByName(crossing).where(F.trim("text") != "").withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header line each, as text columns, with their ``place`` (file, block, line).

    The names are those of the first file's header. Quotes are doubled within quoted values.
    Short rows end in nulls, empty unquoted values are null, and a repeated header name gets a number.
    """
    records = read_records(spark, path)
    header = records.where("block = 0 and line = 0").orderBy("file").first()
    if header is None:
        return spark.createDataFrame([], "place struct<file string, block bigint, line bigint>")
    names: list[str] = []
    for name in next(csv.reader([header["text"].lstrip("\ufeff")])):
        names.append(name if name not in names else f"{name}_{len(names)}")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    quoted = (name.replace("`", "``") for name in names)
    row = F.from_csv("text", ", ".join(f"`{name}` STRING" for name in quoted), options)
    rows = records.where("block > 0 or line > 0").select(row.alias("row"), F.struct("file", "block", "line").alias("place"))
    return rows.select("row.*", "place")
