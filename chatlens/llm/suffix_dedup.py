"""Suffix-array deduplication: a distributed merge sort of suffixes that knows common prefixes.

Only suffixes at anchors are sorted: in every MATCH bytes of a text the least
hash of a GRAM marks one, so two equal strings of MATCH bytes have an anchor at
the same place.  The sort is that of distributed string sorting with
distinguishing prefixes:

1. Texts are packed into chunks and written once.
2. Each chunk sends the sorted hashes of its anchors' grams; a bit comes back
   for each that another document has, too.  A suffix whose first GRAM bytes are
   unique has its place in the order already and is not sent.
3. The other suffixes, each with the bytes before it, become a sorted run per
   chunk, front-coded, cut at sampled splitters and sent.
4. A loser tree merges the runs of one range; it passes on how much each suffix
   shares with the one before, and never looks at that part again.  Suffixes
   that share GRAM bytes are compared on both sides, and for each it is found
   at which distances before the anchor a string of MATCH bytes starts that a
   document with a smaller id has.  That is a mask of SPAN bits.
5. Each chunk marks the bytes that these strings cover.

Equal suffixes of one chunk travel once, so a passage that very many documents
share reaches the merge once per chunk.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chatlens.llm.common import give_back, map_arrow, ship, steady_memory, written
from chatlens.llm.suffix_runs import BEFORE, GRAM, MATCH, SPAN, WIDTH, Run, anchors, front_code, merge, records, sorted_run
from chatlens.llm.textbytes import mix, pieces, text_bytes

#: Bytes of text in a chunk, about.
CHUNK = 8 << 20
#: Chunks whose anchors meet in one task, about, on the way of the hashes.
MEETING = 2
#: Bits of a hash that travel.  Grams that agree in them by chance are told apart in the merge.
BITS = 40
#: Suffixes that each chunk offers for splitters, bytes of them, and splitters' sample in all.
OFFERED, HEAD, SAMPLE = 32, 16, 16_384
FEW = 6


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _loosen(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return _squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_loosen(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Chunk:
    """The texts of a chunk, their anchors, and what is known of them."""

    def __init__(self, rows: bytes, places: bytes):
        self.rows = pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]
        self.data, self.offsets = text_bytes(self.rows.column("text"))
        self.at = _unpack_sorted(places).astype(np.int64)
        ids = self.rows.column("doc_id")
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = self.ids[np.searchsorted(self.offsets, self.at, "right") - 1]
        gram = np.lib.stride_tricks.sliding_window_view(self.data, GRAM)[self.at] if len(self.at) else np.empty((0, GRAM), np.uint8)
        words = np.ascontiguousarray(gram).view(np.uint64)
        hashed = mix(words[:, 0])
        for k in range(1, words.shape[1]):
            hashed = mix((hashed + np.uint64(0x9E3779B97F4A7C15)) ^ words[:, k])
        self.hashes, self.which = np.unique(hashed >> np.uint64(64 - BITS), return_inverse=True)

    def shared(self) -> np.ndarray:
        """Of each hash, whether two documents of this chunk have it."""
        least, most = np.full(len(self.hashes), np.iinfo(np.int64).max), np.full(len(self.hashes), np.iinfo(np.int64).min)
        np.minimum.at(least, self.which, self.owner)
        np.maximum.at(most, self.which, self.owner)
        return least != most

    def parts(self, bits: int) -> Iterator[tuple[int, slice]]:
        """The hashes by their first bits."""
        of = (self.hashes >> np.uint64(BITS - bits)).astype(np.int64)
        parts, begins = np.unique(of, return_index=True)
        for part, a, b in zip(parts.tolist(), begins.tolist(), [*begins[1:].tolist(), len(of)]):
            yield part, slice(a, b)

    def run(self, bits: int, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which anchors are repeated, sorted records, the least owner of each, which of them each such anchor is)."""
        hit = np.zeros(len(self.hashes), bool)
        for part, own in self.parts(bits):
            if part in replies:
                hit[own] = np.unpackbits(np.frombuffer(replies[part], np.uint8))[: own.stop - own.start]
        chosen = np.flatnonzero(hit[self.which])
        return chosen, *sorted_run(records(self.data, self.offsets, self.at[chosen]), self.owner[chosen])


def _cuts(run: np.ndarray, splitters: list[bytes]) -> list[int]:
    """Where a sorted run is cut: what is less than a splitter stands before it."""
    heads = np.ascontiguousarray(run[:, :HEAD]).view(f"V{HEAD}").reshape(-1)
    wanted = np.frombuffer(b"".join(splitters), f"V{HEAD}")
    return [0, *np.searchsorted(heads, wanted).tolist(), len(run)]


def _packed(documents: DataFrame) -> DataFrame:
    """Chunks of documents: their rows, where their anchors are, and the heads of a few suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", CHUNK):
            data, offsets = text_bytes(batch.column("text"))
            at, hashed = anchors(data, offsets)
            # A document without an id is neither less nor greater than another.
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            known = named[np.searchsorted(offsets, at, "right") - 1]
            at, hashed = at[known], hashed[known]
            offered = at[np.argsort(hashed, kind="stable")[:OFFERED]]
            heads = [data[p : p + HEAD].tobytes() for p in offered.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([_to_ipc(batch)], pa.binary()),
                    pa.array([_pack_sorted(at)], pa.binary()),
                    pa.array([heads], pa.list_(pa.binary())),
                ],
                names=["chunk", "rows", "places", "heads"],
            )
            number += 1

    return map_arrow(documents, run, "chunk bigint, rows binary, places binary, heads array<binary>")


def _hash_messages(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                chunk = Chunk(row["rows"], row["places"])
                marked = chunk.hashes << np.uint64(1) | chunk.shared().astype(np.uint64)
                found = [(part, _pack_sorted(marked[own])) for part, own in chunk.parts(bits)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in found], pa.int32()),
                        pa.array([row["chunk"]] * len(found), pa.int64()),
                        pa.array([m for _, m in found], pa.binary()),
                    ],
                    names=["part", "chunk", "message"],
                )

    return map_arrow(chunks.select("chunk", "rows", "places"), run, "part int, chunk bigint, message binary")


REPLY = "chunk bigint, kind int, part int, message binary"
HASHES, MASKS = 0, 1


def _hash_replies(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, a bit for each hash that it sent: whether more documents have it."""
    every = np.concatenate([_unpack_sorted(m) >> np.uint64(1) for m in rows.message])
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    out = []
    for chunk, message in zip(rows.chunk, rows.message):
        own = _unpack_sorted(message)
        plain = own >> np.uint64(1)
        hit = np.isin(plain, twice, assume_unique=True) | (own & np.uint64(1)).astype(bool)
        out.append((chunk, HASHES, rows.part.iat[0], np.packbits(hit).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "kind", "part", "message"])


def _runs_of(bits: int, splitters: list[bytes]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        steady_memory()
        out: list[tuple] = []
        for row in left.to_pylist():
            chunk = Chunk(row["rows"], row["places"])
            _, ordered, owners, _ = chunk.run(bits, dict(zip(right.column("part").to_pylist(), right.column("message").to_pylist())))
            if not len(ordered):
                continue
            cuts = _cuts(ordered, splitters)
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    shared, rest = front_code(ordered[a:b])
                    message = _squeeze(np.int64(b - a).tobytes() + owners[a:b].tobytes() + shared + rest)
                    out.append((part, row["chunk"], message))
        columns = list(zip(*out)) or [[], [], []]
        give_back()
        return pa.table(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
            names=["part", "chunk", "message"],
        )

    return run


def _bits(low: int, high: int) -> int:
    return ((1 << (high - low + 1)) - 1) << low if high >= low else 0


def _valid(record: bytes) -> int:
    """The distances before the anchor at which MATCH bytes start that are all there."""
    return _bits(max(0, MATCH - record[MATCH]), record[-1])


def _shared_before(a: bytes, b: bytes) -> int:
    most = min(a[-1], b[-1])
    k = 0
    while k < most and a[MATCH + 1 + k] == b[MATCH + 1 + k]:
        k += 1
    return k


def _group_masks(members: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int]]:
    """(run, mask) of suffixes that share GRAM bytes: (record, shared prefix, run, owner), in order.

    A mask has a bit for each distance at which a document less than the
    record's least owner has the same MATCH bytes.
    """
    different: list[bytes] = []
    least: list[int] = []
    shared: list[int] = []
    number: list[int] = []
    for record, known, _, owner in members:
        if different and known == WIDTH:
            least[-1] = min(least[-1], owner)
        else:
            different.append(record)
            least.append(owner)
            shared.append(min(known, MATCH))
        number.append(len(different) - 1)
    if len(different) == 1:
        valid = _valid(different[0])
        for _, _, run, owner in members:
            yield run, valid if least[0] < owner else 0
        return
    #: For each different record: (bits, owner) of the strings that some record has.
    found: list[list[tuple[int, int]]] = [[(_valid(r), w)] for r, w in zip(different, least)]
    if len(different) <= FEW:
        for i, a in enumerate(different):
            right = MATCH
            for j in range(i + 1, len(different)):
                b = different[j]
                right = min(right, shared[j])
                both = min(right, a[MATCH], b[MATCH])
                bits = _bits(MATCH - both, _shared_before(a, b))
                if bits:
                    found[i].append((bits, least[j]))
                    found[j].append((bits, least[i]))
    else:
        for o in range(SPAN):
            held: dict[tuple[bytes, bytes], int] = {}
            keys = []
            for record, owner in zip(different, least):
                if record[-1] < o or record[MATCH] < MATCH - o:
                    keys.append(None)
                    continue
                key = (record[: MATCH - o], record[MATCH + 1 : MATCH + 1 + o])
                keys.append(key)
                if held.get(key, owner) >= owner:
                    held[key] = owner
            for k, key in enumerate(keys):
                if key is not None:
                    found[k].append((1 << o, held[key]))
    for (_, _, run, owner), k in zip(members, number):
        mask = 0
        for bits, other in found[k]:
            if other < owner:
                mask |= bits
        yield run, mask


def _merge_replies(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs of one range, and gives each chunk the masks of its records, in its order."""
    rows = rows.sort_values("chunk", kind="stable")
    runs = []
    for message in rows.message:
        data = _loosen(message)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        owners = np.frombuffer(data, np.int64, n, 8).tolist()
        runs.append(Run(data[8 + 8 * n : 8 + 9 * n], data[8 + 9 * n :], owners))
    masks = [array("I") for _ in runs]
    members: list[tuple[bytes, int, int, int]] = []

    def close() -> None:
        if len(members) == 1:
            masks[members[0][2]].append(0)
        else:
            for run, mask in _group_masks(members):
                masks[run].append(mask)
        members.clear()

    for record, known, run in merge(runs):
        if known < GRAM and members:
            close()
        own = runs[run]
        members.append((record, known, run, own.owners[own.at]))
    if members:
        close()
    part = int(rows.part.iat[0])
    return pd.DataFrame(
        [(c, MASKS, part, _squeeze(np.array(m, np.uint32).tobytes())) for c, m in zip(rows.chunk, masks)],
        columns=["chunk", "kind", "part", "message"],
    )


def _removed(chunk: Chunk, bits: int, replies: list[dict]) -> np.ndarray:
    """Which bytes of the chunk are covered by a repeat."""
    n = len(chunk.data)
    starts = np.zeros(n + 1, bool)
    hashes = {r["part"]: r["message"] for r in replies if r["kind"] == HASHES}
    chosen, ordered, owners, which = chunk.run(bits, hashes)
    if len(chosen):
        parts = sorted((r["part"], r["message"]) for r in replies if r["kind"] == MASKS)
        mask = np.concatenate([np.frombuffer(_loosen(m), np.uint32) for _, m in parts])
        at = chunk.at[chosen]
        text = np.searchsorted(chunk.offsets, at, "right") - 1
        # A string whose least owner is another document of this chunk is a repeat wherever it is whole.
        again = chunk.owner[chosen] > owners[which]
        whole_left = np.minimum(at - chunk.offsets[text], BEFORE)
        whole_right = chunk.offsets[text + 1] - at
        mask = mask[which]
        for o in range(SPAN):
            hit = (mask >> np.uint32(o) & np.uint32(1)).astype(bool) | (again & (whole_left >= o) & (whole_right >= MATCH - o))
            starts[at[hit] - o] = True
    seen = np.zeros(n + MATCH, np.int32)
    np.cumsum(starts[:n], out=seen[MATCH:])
    return seen[MATCH:] > seen[:n]


def _before(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bytes are marked before each place."""
    if not len(marked):
        return np.zeros(len(places), np.int64)
    return np.where(places > 0, np.cumsum(marked, dtype=np.int32)[places - 1], 0).astype(np.int64)


def _whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """Removed bytes without those of characters of which a byte stays."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(first):
        return removed
    return np.repeat(np.logical_and.reduceat(removed, first), np.diff(np.append(first, len(data))))


def _results(bits: int, schema: pa.Schema, digests: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        steady_memory()
        out = []
        replies = right.select(["kind", "part", "message"]).to_pylist()
        for row in left.to_pylist():
            chunk = Chunk(row["rows"], row["places"])
            removed = _removed(chunk, bits, replies)
            offsets, data = chunk.offsets, chunk.data
            edge = np.diff(removed.astype(np.int8), prepend=0) == 1
            inner = offsets[:-1][np.diff(offsets) > 0]
            edge[inner] = removed[inner]
            made = {
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(np.diff(_before(removed, offsets)), pa.int64()),
                "n_spans": pa.array(np.diff(_before(edge, offsets)), pa.int64()),
            }
            if digests:
                ends = zip(offsets.tolist(), offsets[1:].tolist())
                own = [hashlib.sha256(data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in ends]
                made["kept_sha256"] = pa.array(own, pa.string())
            kept = ~_whole_characters(data, removed)
            buffers = [None, pa.py_buffer(_before(kept, offsets).astype(np.int32)), pa.py_buffer(data[kept])]
            made["text"] = pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)
            columns = [made[f.name] if f.name in made else chunk.rows.column(f.name) for f in schema]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        give_back()
        return pa.concat_tables(out)

    return run


def remove_repeats(documents: DataFrame, digests: bool = True) -> DataFrame:
    """The rows of ``documents``, all columns, without the bytes that smaller documents have, too.

    A byte goes if it lies in MATCH bytes of its text that also start in a
    document with a smaller doc_id, as the texts are given; matches stay inside
    a text.  ``text`` becomes what is left, in whole characters: one of which a
    byte stays, stays.  Added are n_bytes, n_removed, n_spans (runs of removed
    bytes) and, with ``digests``, kept_sha256, of exactly the bytes that are left.

    A null text is an empty one, and stays null in nothing: it comes back empty.
    A row without doc_id is compared with none and stays whole; rows of one
    doc_id leave each other alone.  Texts under MATCH bytes stay; repeated rows
    stay; columns named like the added ones are replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    added = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    if not digests:
        del added["kept_sha256"]
    documents = documents.select(*[c for c in documents.columns if c not in added])
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = T.StructType([*documents.schema.fields, *[T.StructField(n, k) for n, k in added.items()]])
    chunks = written(_packed(documents), "chunks")
    many = chunks.count()
    bits = max(5, (many // MEETING).bit_length())
    heads = chunks.select(F.explode("heads").alias("head")).where(F.length("head") == HEAD)
    # A bounded sample of suffixes; every range between two of its quantiles is one task's merge.
    sample = sorted(bytes(r.head) for r in heads.orderBy(F.xxhash64("head"), "head").limit(SAMPLE).collect())
    ranges = min(len(sample), max(32, many))
    splitters = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if ranges else []

    messages = _hash_messages(chunks, bits).groupBy("part").applyInPandas(_hash_replies, REPLY)
    hashes = written(messages, "hashes")
    plain = chunks.select("chunk", "rows", "places").groupBy("chunk")
    runs = plain.cogroup(hashes.groupBy("chunk")).applyInArrow(_runs_of(bits, splitters), "part int, chunk bigint, message binary")
    masks = written(runs.groupBy("part").applyInPandas(_merge_replies, REPLY), "masks")
    replies = hashes.unionByName(masks).groupBy("chunk")
    return plain.cogroup(replies).applyInArrow(_results(bits, to_arrow_schema(schema), digests), schema)
