"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are encoded where they are and cut into pieces of at most ``most``
tokens.  The plan needs only how many pieces there are of each length: longest
first, the pieces of one length go to the open sequences with the least room
that is enough, many sequences at a time, as sequences of equal room are ranges
of numbers.  So the plan has a few rows per length whatever the number of
documents.  A piece finds its place by its rank among the pieces of its length,
which comes from a sort by ranges and the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import map_arrow, written
from chatlens.llm.textbytes import pieces as cut_batches
from chatlens.llm.textbytes import text_bytes
from chatlens.llm.token_files import library_store

PLAN = "length int, first bigint, last bigint, sequence bigint, each int, offset int"


def best_fit(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan rows (length, first, last, sequence, each, offset) for ``histogram`` pieces of each length.

    Pieces of rank first to last - 1 of a length go to the sequences from
    ``sequence`` on, ``each`` to a sequence, side by side from ``offset``.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        for space in range(length, most + 1):
            if not left:
                break
            if not room[space]:
                if space < most:
                    continue
                new = -(-left // (most // length))
                room[most].append((sequences, new))
                sequences += new
            each = space // length
            while left and room[space]:
                start, count = room[space].pop()
                for per in (each, left % each):
                    # First the sequences that are filled as far as they go, then one that takes what remains.
                    taken = min(count, left // per if per else 0)
                    if taken:
                        plan.append((length, rank, rank + taken * per, start, per, most - space))
                        room[space - per * length].append((start, taken))
                        rank, left, start, count = rank + taken * per, left - taken * per, start + taken, count - taken
                if count:
                    room[space].append((start, count))
    return plan


def cut_pieces(documents: DataFrame, vocabulary: str, most: int, end_id: int) -> DataFrame:
    """A written row per piece: uid, doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit), ids_crc32.

    Every text is encoded and closed by ``end_id``; only longer ones than
    ``most`` ids are cut.  Null and empty texts are the end id alone.  Repeated
    rows and rows without an id stay; other columns are left out.  uid is a
    number of the piece's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, uid = library_store(vocabulary), TaskContext.get().partitionId() << 40
        for batch in cut_batches(batches, "text"):
            flat, begins = store.ids(*text_bytes(batch.column("text")))
            flat = np.insert(flat, begins[1:], end_id).astype("<u4")
            begins = begins + np.arange(len(begins))
            sizes = np.diff(begins)
            n = -(-sizes // most)
            of = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = begins[:-1][of] + piece * most
            length = np.minimum(sizes[of] - piece * most, most)
            raw = flat.tobytes()
            ids = [raw[4 * a : 4 * (a + b)] for a, b in zip(start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": pa.array(uid + np.arange(len(of))),
                    "doc_id": batch.column("doc_id").take(pa.array(of)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(piece * most),
                    "length": pa.array(length, pa.int32()),
                    "ids": pa.array(ids, pa.binary()),
                }
            )
            uid += len(of)

    schema = "uid bigint, doc_id bigint, piece int, start bigint, length int, ids binary"
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(map_arrow(documents, run, schema), "pieces").withColumn("ids_crc32", F.crc32("ids"))


def place(pieces: DataFrame, most: int) -> DataFrame:
    """The pieces, without their ids, with sequence_id and offset.

    Sequences are numbered from 0 and filled without gaps.  Pieces of one
    length are ranked by uid, so ties are decided.  Broadcast is only the plan:
    a few rows for each of at most ``most`` lengths.  An empty table gives none.
    """
    spark = pieces.sparkSession
    in_order = pieces.drop("ids").repartitionByRange("length", "uid").sortWithinPartitions("length", "uid")
    in_order = written(in_order.withColumn("at", F.monotonically_increasing_id()), "ranked")
    # Where a length goes on from one range to the next: one row for each range and length.
    in_order = in_order.withColumn("range", F.shiftright("at", 33))
    parts = in_order.groupBy("length", "range").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.withColumn("before", F.coalesce(before, F.lit(0))), "ranges")
    counts = parts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row for each length
    plan = spark.createDataFrame(best_fit({row.length: row.n for row in counts}, most), PLAN)
    ranked = in_order.join(parts.select("length", "range", "low", "before"), ["length", "range"])
    ranked = ranked.withColumn("rank", F.col("at") - F.col("low") + F.col("before"))
    slot = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    nth = F.col("rank") - F.col("first")
    return (
        ranked.alias("r")
        .join(F.broadcast(plan.alias("p")), slot)
        .select(
            *[F.col(f"r.{c}") for c in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")],
            (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
            (F.col("offset") + nth % F.col("each") * F.col("r.length")).cast("bigint").alias("offset"),
        )
    )


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids, and docs (doc_id, piece, offset, length) in the order of their places.

    A sequence has at most as many pieces as tokens, so its group is bounded.
    """
    rows = placed.join(pieces.select("uid", "ids"), "uid")
    each = F.struct("offset", "doc_id", "piece", "length", "ids")
    whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(each)).alias("held"))
    return whole.select(
        "sequence_id",
        F.aggregate("held.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("docs"),
    )
