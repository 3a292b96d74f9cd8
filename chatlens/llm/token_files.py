"""Token ids on disk: frequency-ranked, in byte-aligned variable-length coding with separate control bytes.

The more often an id occurs in the corpus, the lower its rank, and ranks are
what is stored: 1 to 4 little-endian bytes each.  The lengths of four ranks
share one control byte, two bits each, apart from the data, so a table of 256
entries gives four lengths at a time.

A folder holds two Parquet tables.  ``blocks`` has, in ascending order of
doc_id, the documents of one block (doc_ids, sizes) and their ranks (control,
data); shard and block number that order.  ``ranks`` gives the id of each rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.llm.common import map_arrow, written
from chatlens.llm.textbytes import pieces, text_bytes
from chatlens.llm.tokens import WordStore

#: Ids after which a block is closed.
BLOCK = 1 << 18
#: Words that the library encodes at once.
AT_ONCE = 10_000

_codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: Bytes of the four numbers that a control byte stands for.
LENGTHS = (_codes + 1).astype(np.uint8)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned numbers under 2^32."""
    numbers = numbers.astype(np.uint32)
    code = (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(code.astype(np.int64) + 1)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    starts = ends - code - 1
    for k in range(4):
        longer = np.flatnonzero(code >= k) if k else slice(None)
        data[starts[longer] + k] = numbers[longer] >> np.uint32(8 * k) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers behind control and data bytes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    held = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = held[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= held[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_STORES: dict[str, WordStore] = {}


def library_store(path: str) -> WordStore:
    """Words encoded by the tokenizers library, once in each Python worker."""
    if path not in _STORES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
            for at in range(0, len(words), AT_ONCE):
                own = words[at : at + AT_ONCE]
                found = library.encode(b" ".join(own).decode(), add_special_tokens=False)
                ids.append(np.array(found.ids, np.uint32))
                counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(own)))
            return np.concatenate(ids), np.concatenate(counts)

        _STORES[path] = WordStore(encode, lambda text: library.encode(text, add_special_tokens=False).ids)
    return _STORES[path]


def _encoded(documents: DataFrame, path: str, end_id: int, ids: int, kind: str) -> DataFrame:
    """Rows (doc_id, ids) of all documents, and a row with counts by id for each task."""
    schema = "doc_id bigint, ids binary, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, counts = library_store(path), np.zeros(ids, np.int64)
        names = ["doc_id", "ids", "counts"]
        for batch in pieces(batches, "text"):
            flat, begins = store.ids(*text_bytes(batch.column("text")))
            counts += np.bincount(flat, minlength=ids)
            counts[end_id] += batch.num_rows
            flat = np.insert(flat, begins[1:], end_id).astype(kind)
            begins = begins + np.arange(len(begins))
            data, width = flat.tobytes(), flat.itemsize
            held = [data[width * a : width * b] for a, b in zip(begins.tolist(), begins[1:].tolist())]
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.binary()), none], names=names)
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(last, names=names)

    return map_arrow(documents.select("doc_id", "text"), run, schema)


def write_tokens(documents: DataFrame, vocabulary: str, folder: str, end_id: int) -> None:
    """Writes the token ids of all documents, each closed by ``end_id``, in ascending order of doc_id.

    Texts are encoded where they are; only ids cross the network, once, by
    range of doc_id.  Null and empty texts have the end id alone.  Null ids come
    first; documents of one id are in the order of their ids' bytes; repeated
    rows stay.  An empty table gives empty blocks.  Other columns are left out.
    The counts by id, as many as the vocabulary has, are all that reaches the
    driver.
    """
    from tokenizers import Tokenizer

    ids = max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()) + 1
    ids = max(ids, end_id + 1)
    kind = "<u2" if ids <= 1 << 16 else "<u4"
    spark = documents.sparkSession
    held = written(_encoded(documents, vocabulary, end_id, ids, kind), "ids")
    counts = np.zeros(ids, np.int64)
    total = held.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n"))
    for row in total.where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    by_rank = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank = np.empty(ids, np.uint32)
    rank[by_rank] = np.arange(ids, dtype=np.uint32)
    ranks = [(k, int(v)) for k, v in enumerate(by_rank)]
    spark.createDataFrame(ranks, "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")

    schema = "shard int, block int, doc_ids array<bigint>, sizes array<bigint>, control binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "ids", BLOCK * np.dtype(kind).itemsize):
            data, offsets = text_bytes(batch.column("ids"))
            control, coded = pack(rank[data.view(kind)])
            sizes = (np.diff(offsets) // np.dtype(kind).itemsize).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "control": pa.array([control], pa.binary()),
                    "data": pa.array([coded], pa.binary()),
                }
            )
            block += 1

    in_order = held.where("ids IS NOT NULL").select("doc_id", "ids")
    in_order = in_order.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    map_arrow(in_order, run, schema).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document read from the files: doc_id, start, n_tokens, ids_crc32, ids.

    start counts the ids of all documents before; ids are little-endian
    unsigned 32-bit integers.
    """
    by_rank = np.empty(0, np.uint32)
    table = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # as many rows as the vocabulary has
    by_rank = np.array([row.id for row in table], np.uint32)
    blocks = spark.read.parquet(f"{folder}/blocks")
    schema = "shard int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                ids = by_rank[unpack(row["control"], row["data"], int(ends[-1]))].astype("<u4").tobytes()
                begins = [0, *ends[:-1].tolist()]
                own = [ids[4 * a : 4 * b] for a, b in zip(begins, ends.tolist())]
                n = len(own)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * n, pa.int32()),
                        "block": pa.array([row["block"]] * n, pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "within": pa.array(begins, pa.int64()),
                        "n_tokens": pa.array(row["sizes"], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        "ids": pa.array(own, pa.binary()),
                    }
                )

    documents = map_arrow(blocks, run, schema)
    # Where each block starts: running sums inside a shard, then over the shards, of which there are few.
    sizes = blocks.select("shard", "block", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n"))
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = sizes.select("shard", "block", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    starts = in_shard.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("shard_start")).alias("block_start"))
    return documents.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
