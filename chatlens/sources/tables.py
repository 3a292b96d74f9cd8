"""Readers with fixed schemas and checks of names and columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.schemas import SOURCE_SCHEMAS, SOURCE_TABLES, STATIC_SCHEMAS


#: Sources that bring a schema of their own and refuse another.
OWN_SCHEMA = ("jdbc",)


def jdbc_options(schema: T.StructType | None, split_by: str | None, bounds: tuple[int, int] | None, partitions: int | None) -> dict[str, str]:
    """Options for a database table: its types, and one bounded query for each of ``partitions`` ranges of a column.

    Rows below or above the bounds belong to the first and last range, so
    bounds need not be exact.  Without a column to split by it is one query.
    """
    options = {}
    if schema is not None:
        options["customSchema"] = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema.fields)
    if split_by and bounds and partitions and partitions > 1:
        low, high = bounds
        if low > high:
            raise ValueError(f"the lower bound {low} is above the upper bound {high}")
        ranges = min(partitions, max(1, high - low + 1))
        options |= {"partitionColumn": split_by, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(ranges)}
    return options


def read_source(
    spark: SparkSession,
    name: str,
    path: str | None = None,
    source_format: str = "parquet",
    partitions: int | None = None,
    split_by: str | None = None,
    bounds: tuple[int, int] | None = None,
    **options: str,
) -> DataFrame:
    """One catalogued source table, from files or from a database.

    Tables the operators use are read with their fixed schema; the others keep
    the schema found in the source.  ``partitions`` deals the rows of few files
    out anew.  A database brings its own schema, so the fixed one is given as
    the types of its columns; it is read in ``partitions`` ranges of ``split_by``
    between ``bounds``, where these are given, and nothing is shuffled.
    """
    if name not in SOURCE_TABLES:
        raise ValueError(f"{name!r} is not a catalogued source table")
    schema = SOURCE_SCHEMAS.get(name)
    if source_format in OWN_SCHEMA:
        options = {"dbtable": name} | jdbc_options(schema, split_by, bounds, partitions) | options
        df = spark.read.format(source_format).options(**options).load()
        return df if schema is None else df.select(*schema.names)
    reader = spark.read.format(source_format).options(**options)
    df = (reader if schema is None else reader.schema(schema)).load(path)
    return df if partitions is None else df.repartition(partitions)


def check_catalog(spark: SparkSession, present: Iterable[str], expected: Iterable[str] = SOURCE_TABLES) -> DataFrame:
    """(table, problem) for catalogued tables that are missing and for tables
    nobody catalogued."""

    def names(tables: Iterable[str]) -> DataFrame:
        return spark.createDataFrame([(table,) for table in sorted(set(tables))], "table string")

    wanted, found = names(expected), names(present)
    missing = wanted.join(found, "table", "left_anti").withColumn("problem", F.lit("missing"))
    unknown = found.join(wanted, "table", "left_anti").withColumn("problem", F.lit("unaccounted for"))
    return missing.unionByName(unknown)


#: Pairs of types of which the second holds every value of the first.
WIDER = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "int"), ("tinyint", "bigint"), ("float", "double"), ("date", "timestamp")}


def column_problems(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, problem, declared, found) for columns that are missing, undeclared, of another type, or null where they may not be.

    A type whose values all fit into the declared one is no problem.  Nothing
    but the schemas is read; problems come in the order of the declared columns.
    """
    found = {field.name: field for field in df.schema.fields}
    rows = []
    for field in schema.fields:
        declared = field.dataType.simpleString()
        if field.name not in found:
            rows.append((field.name, "missing", declared, None))
            continue
        other = found.pop(field.name)
        kind = other.dataType.simpleString()
        if kind != declared and (kind, declared) not in WIDER:
            rows.append((field.name, "type", declared, kind))
        if other.nullable and not field.nullable:
            rows.append((field.name, "nullable", declared, kind))
    rows += [(name, "undeclared", None, field.dataType.simpleString()) for name, field in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, problem string, declared string, found string")


def check_columns(df: DataFrame, schema: T.StructType, name: str = "table", types: bool = False) -> DataFrame:
    """The frame itself if its columns are exactly the declared ones, and with ``types`` of types that fit."""
    declared, found = set(schema.names), set(df.columns)
    if declared != found:
        raise ValueError(
            f"{name}: missing columns {sorted(declared - found)}, undeclared columns {sorted(found - declared)}"
        )
    wrong = [f"{row.column} is {row.found}, not {row.declared}" for row in column_problems(df, schema).collect() if row.problem == "type"] if types else []
    if wrong:
        raise ValueError(f"{name}: {'; '.join(wrong)}")
    return df


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def path_is_missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def read_static_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A user-kept CSV table with a header; no file means an empty table."""
    schema = STATIC_SCHEMAS[name]
    try:
        raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    except AnalysisException as error:
        if path_is_missing(error):
            return empty_table(spark, schema)
        raise
    check_columns(raw, schema, name)
    return raw.select(*(F.col(field.name).cast(field.dataType) for field in schema.fields))


BAD_ROW = "bad_row"


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the rows of a CSV with a header that fit the schema, and the lines of those that don't.

    Short and long rows and values that are not of their column's type are bad;
    so is a null in a column that may not be null.  bad has the line as it
    stands (bad_row) and the file it is in.  A column of another name, or in
    another place, is an error.  No file means two empty tables.

    Both tables read the file, which is parsed once for each; lines are the
    unit, so a value with a line break in quotes is read by multiLine.
    """
    bad_schema = T.StructType([T.StructField(BAD_ROW, T.StringType()), T.StructField("file", T.StringType())])
    try:
        header = spark.read.csv(path, header=True, escape='"', multiLine=True)
    except AnalysisException as error:
        if path_is_missing(error):
            return empty_table(spark, schema), empty_table(spark, bad_schema)
        raise
    check_columns(header, schema, path)
    if header.columns != schema.names:
        raise ValueError(f"{path}: columns {header.columns}, not in the order {schema.names}")
    # Columns are read as nullable ones, so that a null is found and not taken for a fault of the file.
    parsed = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields] + [T.StructField(BAD_ROW, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW, "enforceSchema": False}
    rows = spark.read.schema(parsed).options(header=True, escape='"', multiLine=True, **options).csv(path)
    # Whether a row fits shows only if all its columns are parsed, whichever are asked for; this holds for all rows and needs all columns.
    rows = rows.where(F.length(F.concat_ws("", *(F.col(name).cast("string") for name in schema.names))) >= 0)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    required = [F.col(f.name).isNull() for f in schema.fields if not f.nullable]
    missing = reduce(lambda a, b: a | b, required, F.lit(False))
    line = F.coalesce(BAD_ROW, F.to_csv(F.struct(*schema.names)))
    good = rows.where(F.col(BAD_ROW).isNull() & ~missing).select(*schema.names)
    return good, rows.where(F.col(BAD_ROW).isNotNull() | missing).select(line.alias(BAD_ROW), "file")
