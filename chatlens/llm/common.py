"""Helpers that several of these operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that removes a query's shuffle files when it has ended.
SHUFFLE_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read, named by spark.checkpoint.dir.

    A session without that setting gets a temporary folder, which is right for
    local runs only.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once."""
    context = spark.sparkContext
    if getattr(context, "_chatlens_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="chatlens-")) / "chatlens.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for file in sorted(package.rglob("*.py")):
            held.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._chatlens_sent = True


def steady_memory() -> None:
    """Makes this process map arrays of over 1 MB by themselves, so that each is returned to the system when freed."""
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).mallopt(-3, 1 << 20)


def give_back() -> None:
    """Returns free memory of this process to the system, as a worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(frame: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package at hand in the workers.

    Of a frame that this returned, both steps become one.  As two they would
    share a stage, with a Python worker each for every core; idle workers stay
    and take their turns, so all later stages would find twice as many.
    """
    source, before = vars(frame).get("_mapped", (frame, None))

    def steps(batches):
        return run(before(batches) if before else batches)

    def and_give_back(batches):
        steady_memory()
        yield from steps(batches)
        give_back()

    ship(frame.sparkSession)
    out = source.mapInArrow(and_give_back, schema)
    out._mapped = source, steps
    return out


class Scratch:
    """Holds the scratch tables that are written while it is entered, until clear().

    Tables that no Scratch holds stay in the shared folder unless they are
    dropped, as their callers may still read them.
    """

    _entered: list[Scratch] = []

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        self._entered.append(self)
        return self

    def __exit__(self, *_) -> None:
        self._entered.remove(self)

    def clear(self) -> None:
        """Deletes the tables; nothing that reads them may be left."""
        while self.tables:
            drop(self.tables.pop())


def cut(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back, so that its lineage ends here."""
    return written(frame, "cut")


def written(frame: DataFrame, kind: str, scratch: bool = True) -> DataFrame:
    """The frame as a Parquet table in the shared folder: compressed, where checkpoint() is not.

    Once the table is there, the shuffle files that made it go.  A ``scratch``
    table is held by the Scratch that is entered, if any.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/chatlens-{kind}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_FILES_GO, "false")
    spark.conf.set(SHUFFLE_FILES_GO, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_FILES_GO, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_to = path
    if scratch and Scratch._entered:
        Scratch._entered[-1].tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written(); nothing that reads them may be left."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def computed_once(value: Column) -> Column:
    """The value as a generator's output.

    Projections are not merged across a generator, so whatever uses the value
    for each element of an array finds it made, and does not make it again.
    """
    return F.explode(F.array(value))


def words_of(text: Column) -> Column:
    """Words of a text as an array: A-Z lower-cased, runs of 0-9, a-z and all that is not ASCII; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
