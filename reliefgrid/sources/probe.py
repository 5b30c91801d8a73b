"""State files told apart before they are trusted: missing, empty, binary, headerless, wrongly delimited or good."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators.repair import Defaults, repair_schema
from reliefgrid.sources.readers import MISSING_TEXT

#: Signs that a file may be cut at by mistake.
DELIMITERS = [",", ";", "\t", "|"]


def _name(path: str, root: str) -> Column:
    """The state that a part file belongs to: what follows the root."""
    below = f"/{root.rstrip('/').rsplit('/', 1)[-1]}/"
    return F.substring_index(F.substring_index(F.col(path), below, -1), "/", 1)


def _fields(line: Column | str, sep: str) -> Column:
    quoted = {"|": r"\|"}.get(sep, sep)
    return F.transform(F.split(line, quoted), lambda x: F.trim(F.btrim(x, F.lit('" ﻿'))))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """``name, part, place, value``: every line, with a place that orders those of a part file."""
    text = spark.read.option("recursiveFileLookup", "true").text(root)
    placed = text.select(
        "value", F.col("_metadata.file_path").alias("part"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    return placed.select(_name("part", root).alias("name"), "part", "place", "value")


def probe_files(spark: SparkSession, root: str, names: Sequence[str], expected: Defaults, sep: str = ",") -> DataFrame:
    """One row for each name: ``name, status, row_count, missing_columns, empty_columns, start_over``.

    A state is a file below ``root``, or a folder of part files. It is ``missing`` without any,
    ``empty`` without a line that shows something, ``binary`` with a line that is no text,
    ``wrong_delimiter`` if its head names expected columns once another sign cuts it, ``headerless`` if
    no sign does, else ``good``. Rows are counted as lines, and columns looked into, of good files
    only; a line break inside quotes counts as a line. Anything but a good file with rows starts over.
    """
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    # A scan does not show files without bytes; the listing that Spark holds of the folder does.
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).inputFiles()
    listed = spark.createDataFrame([(p,) for p in paths], "path string").select(_name("path", root).alias("name"))
    held = listed.join(wanted, "name", "left_semi").groupBy("name").agg(F.count("*").alias("files"))
    lines = _lines(spark, root).join(F.broadcast(wanted), "name")
    shown = F.length(F.trim("value")) > 0
    odd = ~F.is_valid_utf8("value") | F.contains("value", F.lit("\u0000"))
    parts = lines.groupBy("name", "part").agg(
        F.min_by("value", "place").alias("head"), F.min("place").alias("first"), F.count_if(shown).alias("shown"), F.count_if(odd).alias("odd"))
    columns = F.array(*[F.lit(c) for c in expected])
    hits = [F.size(F.array_intersect(_fields("head", s), columns)) for s in [sep, *[d for d in DELIMITERS if d != sep]]]
    own, others = hits[0], F.greatest(*hits[1:])
    part_status = (
        F.when(F.col("odd") > 0, "1 binary").when(F.col("shown") == 0, "9 empty")
        .when((own == 0) & (others > 0), "2 wrong_delimiter").when(own == 0, "3 headerless")
        # A head that another sign cuts into more columns than its own was written with that sign.
        .when(others > own, "2 wrong_delimiter").otherwise("4 good"))
    rated = parts.withColumn("status", part_status)
    # The worst part of a state decides; empty parts do so only where there are no others.
    status = rated.groupBy("name").agg(F.substring(F.min("status"), 3, 99).alias("status"))
    known = wanted.join(held, "name", "left").join(status, "name", "left").select(
        "name", F.when(F.col("files").isNull(), "missing").otherwise(F.coalesce("status", F.lit("empty"))).alias("status"))

    good = rated.where(F.col("status") == "4 good").join(known.where(F.col("status") == "good").select("name"), "name")
    heads = good.select("name", "part", "first", _fields("head", sep).alias("fields"))
    width = heads.agg(F.coalesce(F.max(F.size("fields")), F.lit(1))).head()[0]
    cut_up = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width))), {"sep": sep})
    body = lines.join(F.broadcast(heads), ["name", "part"]).where((F.col("place") != F.col("first")) & shown)
    cells = body.select("name", "fields", F.array(*[cut_up[f"c{i}"] for i in range(width)]).alias("cells"))
    counted = cells.groupBy("name").agg(F.count("*").alias("row_count"))
    filled = (
        cells.select("name", F.explode(F.arrays_zip("fields", "cells")).alias("c")).select("name", F.col("c.fields").alias("column"), F.col("c.cells").alias("cell"))
        .where(F.col("column").isNotNull()).groupBy("name", "column").agg(F.count_if(~F.coalesce(F.trim("cell").isin(MISSING_TEXT), F.lit(True))).alias("n")))
    blank = filled.where((F.col("n") == 0) & F.array_contains(columns, F.col("column"))).groupBy("name").agg(F.collect_set("column").alias("blank"))
    present = heads.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("fields"))).alias("present"))
    none = F.array().cast("array<string>")
    joined = known.join(counted, "name", "left").join(blank, "name", "left").join(present, "name", "left")
    return joined.select(
        "name", "status", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        F.when(F.col("status") == "good", F.array_except(columns, F.coalesce("present", none))).otherwise(none).alias("missing_columns"),
        # Lists follow the order of the expected columns.
        F.filter(columns, lambda c: F.coalesce(F.array_contains("blank", c), F.lit(False))).alias("empty_columns"),
        ((F.col("status") != "good") | F.col("row_count").isNull()).alias("start_over"),
    )


def load_states(spark: SparkSession, root: str, names: Sequence[str], expected: Defaults, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Rows of all good states, widened to the expected columns, with ``state_file``; and the report that names the others.

    Values are texts as the files hold them; columns that a file lacks take their defaults.
    """
    report = probe_files(spark, root, names, expected, sep)
    # One row for each name that the caller gave.
    good = [r["name"] for r in report.where(~F.col("start_over")).select("name").collect()]
    texts = {c: ("string", value if isinstance(value, str) else None) for c, (_, value) in expected.items()}
    rows = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in expected) + ", state_file string")
    for name in good:
        own = spark.read.option("recursiveFileLookup", "true").csv(f"{root}/{name}", header=True, sep=sep, quote='"', escape='"', multiLine=True)
        rows = rows.unionByName(repair_schema(own, texts).select(*expected, F.lit(name).alias("state_file")))
    return rows, report
