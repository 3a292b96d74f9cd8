"""Database options, schema differences, and rows of a CSV that don't fit."""

import pytest
from pyspark.sql import types as T

from chatlens.schemas import SOURCE_SCHEMAS
from chatlens.sources import tables


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_database_options():
    schema = SOURCE_SCHEMAS["chat"]
    options = tables.jdbc_options(schema, "ROWID", (1, 1000), 8)
    assert options == {
        "customSchema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields),
        "partitionColumn": "ROWID",
        "lowerBound": "1",
        "upperBound": "1001",
        "numPartitions": "8",
    }
    assert tables.jdbc_options(None, "ROWID", (5, 6), 8)["numPartitions"] == "2"
    assert tables.jdbc_options(None, None, (5, 6), 8) == tables.jdbc_options(None, "ROWID", None, 8) == {}
    with pytest.raises(ValueError, match="above"):
        tables.jdbc_options(None, "ROWID", (2, 1), 8)


def test_a_database_is_not_given_a_schema(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def options(self, **options):
            seen["options"] = options
            return self

        def schema(self, _):
            raise AssertionError("a database has its own schema")

        def load(self):
            return spark.createDataFrame([], T.StructType(SOURCE_SCHEMAS["chat"].fields[::-1]))

    class Session:
        read = Reader()

    found = tables.read_source(Session(), "chat", source_format="jdbc", split_by="ROWID", bounds=(1, 10), partitions=2, url="jdbc:x")
    assert found.columns == SOURCE_SCHEMAS["chat"].names
    assert seen["format"] == "jdbc" and seen["options"]["dbtable"] == "chat" and seen["options"]["url"] == "jdbc:x"
    assert seen["options"]["numPartitions"] == "2"


SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())]
)


def test_schema_differences(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 2.0)], "id int, day string, more double")
    assert rows(tables.column_problems(df, SCHEMA)) == [
        ("day", "type", "date", "string"),
        ("id", "nullable", "bigint", "int"),
        ("more", "undeclared", None, "double"),
        ("name", "missing", "string", None),
    ]
    same = spark.createDataFrame([], SCHEMA)
    assert rows(tables.column_problems(same, SCHEMA)) == [] and tables.check_columns(same, SCHEMA, types=True) is same
    other = spark.createDataFrame([], "id bigint, name string, day string")
    assert tables.check_columns(other, SCHEMA) is other
    with pytest.raises(ValueError, match="day is string, not date"):
        tables.check_columns(other, SCHEMA, "people", types=True)


def test_bad_rows_have_a_place(spark, tmp_path):
    lines = ["id,name,day", '1,"a, ""b""",2024-01-01', "2,short", "3,long,2024-01-03,more", "x,no number,2024-01-04", "5,no day,today", ",no id,2024-01-06", "7,,"]
    (tmp_path / "people.csv").write_text("\n".join([*lines, '8,"two\nlines",2024-01-08']) + "\n")
    good, bad = tables.read_typed_csv(spark, str(tmp_path / "people.csv"), SCHEMA)
    assert [(r.id, r.name, str(r.day)) for r in good.orderBy("id").collect()] == [
        (1, 'a, "b"', "2024-01-01"), (7, None, "None"), (8, "two\nlines", "2024-01-08")
    ]
    assert good.dtypes == [("id", "bigint"), ("name", "string"), ("day", "date")]
    found = bad.collect()
    assert sorted(r.bad_row.split(",")[0] for r in found) == ["", "2", "3", "5", "x"]
    assert all(r.file.endswith("people.csv") for r in found)
    assert bad.count() == 5 and good.count() == 3


def test_typed_csv_without_file_or_of_other_columns(spark, tmp_path):
    good, bad = tables.read_typed_csv(spark, f"{tmp_path}/none.csv", SCHEMA)
    assert good.count() == bad.count() == 0 and good.columns == SCHEMA.names
    (tmp_path / "moved.csv").write_text("id,day,name\n1,2024-01-01,a\n")
    with pytest.raises(ValueError, match="not in the order"):
        tables.read_typed_csv(spark, f"{tmp_path}/moved.csv", SCHEMA)
    (tmp_path / "other.csv").write_text("id,name\n1,a\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_typed_csv(spark, f"{tmp_path}/other.csv", SCHEMA)
