"""Writing tables, appending new rows, CSV files and snapshots."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.sources.commits import TableStore
from chatlens.sources.tables import path_is_missing

# --- fixed values: data sets the dashboard reads -----------------------------
DASHBOARD_DATASETS = (
    "contact_token_usage_from_who",
    "daily_summary",
    "daily_summary_contact",
    "daily_summary_contact_from_who",
    "daily_summary_from_who",
    "message_tokens_unnest",
    "message_user",
    "message_user_text",
    "summary",
    "summary_contact",
    "summary_contact_from_who",
    "contact_group_chat_map",
)

CSV_NULL = "\\N"
VERSIONS = "written bigint, version string"


def materialise(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a new version of the Parquet table at ``path`` and return it as read back.

    Each version has a folder of its own, so whoever reads an older one, the
    written plan among them, keeps its files; read_current finds the newest.
    Old versions are left to the user to remove.  With ``partition_by`` the rows
    are first rebalanced on that column: small values share a file, a hot value
    is split over several tasks.  Tables that change together are better kept in
    a TableStore.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", F.col(partition_by))
    version = f"version-{uuid.uuid4().hex}"
    writer = writer.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/{version}")
    done = df.sparkSession.createDataFrame([(time.time_ns(), version)], VERSIONS)
    done.coalesce(1).write.mode("append").parquet(f"{path}/_versions")
    return _read_version(df.sparkSession, f"{path}/{version}", df.schema)


def _read_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # The given schema keeps column order and types (a partition column would
    # come last and be guessed from folder names).
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest whole version of a table that materialise has written."""
    versions = spark.read.schema(VERSIONS).parquet(f"{path}/_versions")
    newest = versions.agg(F.max_by("version", "written")).first()[0]
    return _read_version(spark, f"{path}/{newest}", schema)


def store_by_key(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Keep a table in the catalogue, dealt into ``buckets`` by a key and sorted by it.

    Joins and groupings by that key then need no shuffle of it: the other side
    is shuffled to its buckets, if these are no fewer than
    spark.sql.shuffle.partitions.  Each bucket is one file; null keys share one.
    """
    dealt = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    dealt.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def new_rows(df: DataFrame, existing: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows whose keys the existing table does not hold yet, one of each key; null keys count as equal.

    Whole keys are compared by plain equality, so an existing table that is
    stored by its key stays where it is; only keys with a null, of which both
    sides are filtered first, take the other way.  Repeated keys of the existing
    table are combined before they cross the network.
    """
    keys = list(keys)
    candidates = df.dropDuplicates(keys)
    holes = reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))
    held = existing.select(*keys).distinct()
    whole = candidates.where(~holes).join(held, keys, "left_anti").select(*df.columns)
    known = held.where(holes).select(*(F.col(key).alias(f"known_{key}") for key in keys))
    same = reduce(lambda a, b: a & b, (F.col(key).eqNullSafe(F.col(f"known_{key}")) for key in keys))
    return whole.unionByName(candidates.where(holes).join(known, same, "left_anti"))


def append_new_rows(df: DataFrame, path: str, keys: Iterable[str]) -> None:
    """Append to the Parquet table at ``path`` the rows with unknown keys."""
    try:
        df = new_rows(df, df.sparkSession.read.schema(df.schema).parquet(path), keys)
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        df = df.dropDuplicates(list(keys))
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder that keeps blanks at the ends of values, and '' apart from null, which is written as CSV_NULL."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        escape='"',
        emptyValue='""',
        nullValue=CSV_NULL,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def dataset_view(df: DataFrame) -> DataFrame:
    """The frame with ``dt`` as a date and ``ts`` as a timestamp without zone."""
    casts = {name: F.col(name).cast(kind) for name, kind in (("dt", "date"), ("ts", "timestamp_ntz")) if name in df.columns}
    return df.withColumns(casts) if casts else df


def extract_datasets(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    out: str,
    names: Iterable[str] = DASHBOARD_DATASETS,
    refresh: bool = False,
) -> dict[str, DataFrame]:
    """The named data sets as one snapshot, reloaded if it exists.

    Each snapshot is a commit of a TableStore, so whoever reads an older one
    keeps it, also while it is made anew, and one cut short by a failure is not
    seen.  Give the tables that refresh_tables returns: each data set is then a
    view of what is written.
    """
    names, store = list(names), TableStore(spark, out)
    saved = store.commit()
    if not refresh and set(names) <= set(saved.tables):
        return {name: store.read(saved, name) for name in names}
    change = store.refresh()
    for name in names:
        change.write(name, dataset_view(tables[name]))
    done = change.commit()
    return {name: store.read(done, name) for name in names}
