"""Batch readers: place file, quoted and damaged CSV, labels, archives of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliefgrid.functions.scalars import split_alternates
from reliefgrid.sources import schemas

# Field texts that mean "missing" in the delimited files.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
DAMAGED = "_damaged"


def blank_to_null(df: DataFrame) -> DataFrame:
    """Turn the missing-value texts of string columns into nulls."""

    def fix(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            col = F.when(~col.isin(MISSING_TEXT), col)
        return col.alias(field.name)

    return df.select([fix(f) for f in df.schema.fields])


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated place file; nine columns kept, alternates split at commas."""
    raw = spark.read.schema(schemas.GAZETTEER_FILE).csv(path, sep="\t", header=False)
    return blank_to_null(raw).select(
        "geonameid",
        "name",
        split_alternates("alternatenames").alias("alternate_list"),
        "countryCode",
        "stateCode",
        "latitude",
        "longitude",
        "featureCode",
        "population",
    )


def read_json_archives(
    spark: SparkSession, paths: str | list[str], schema: str | None = None, lines: bool = False
) -> DataFrame:
    """All JSON files of paths or globs, one union by column name.

    Files hold one array each, or one object per ``lines``, which Spark can split.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema:
        reader = reader.schema(schema)
    return reader.json(paths)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered tab-separated labels; bad bytes become the replacement character."""
    return blank_to_null(spark.read.schema(schema).csv(path, sep="\t", header=True, encoding="UTF-8"))


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered CSV whose quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def _read_damaged(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    return spark.read.schema(f"{schema}, {DAMAGED} string").csv(
        path,
        header=header,
        multiLine=True,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=DAMAGED,
        enforceSchema=True,
    )


def read_complete_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Keep rows with all columns, empty ones too, and cut extra ones; short rows are dropped."""
    raw = _read_damaged(spark, path, schema, header)
    names = [c for c in raw.columns if c != DAMAGED]
    # Commas inside quotes part no fields.
    bare = F.regexp_replace(DAMAGED, '"(?:[^"]|"")*"', "")
    return raw.where(F.col(DAMAGED).isNull() | (F.size(F.split(bare, ",")) >= len(names))).select(names)


def read_padded_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Keep every row: short rows are filled with empty text, extra columns are cut."""
    raw = _read_damaged(spark, path, schema, header)
    return raw.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns if c != DAMAGED])
