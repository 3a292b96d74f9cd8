"""Texts of an Arrow column as bytes in numpy, and the words in them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text is taken alone.
PIECE = 2 << 20
#: Bytes of a run over which it is hashed alone.
LONG = 256
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_byte = np.arange(256)
IS_UPPER = (_byte >= 65) & (_byte <= 90)
IS_LOWER = (_byte >= 97) & (_byte <= 122)
IS_DIGIT = (_byte >= 48) & (_byte <= 57)
#: 0-9, A-Z, a-z and every byte of a character that is not ASCII.
IS_WORD = IS_UPPER | IS_LOWER | IS_DIGIT | (_byte >= 128)
LOWERED = np.where(IS_UPPER, _byte + 32, _byte).astype(np.uint8)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(text_bytes(batch.column(column))[1]))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts side by side, and where each begins; the last entry is the end. Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; none crosses from one text into the next."""
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[begins[begins > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes: eight at a time, chained through mix(); runs over LONG bytes by BLAKE2.

    Runs of one length of up to eight bytes have one hash only if they are equal.
    """
    sizes = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(eights[starts] & FIRST[np.minimum(sizes, 8)])
    todo, at = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(todo):
        left = sizes[todo] - at
        out[todo] = mix((out[todo] + GOLDEN) ^ (eights[starts[todo] + at] & FIRST[np.minimum(left, 8)]))
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out + sizes.astype(np.uint64) * GOLDEN


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *heads: int) -> list[np.ndarray]:
    """64-bit hashes of the lower-cased words, then of their first so many bytes for each of ``heads``."""
    low = LOWERED[data]
    return [run_hashes(low, starts, ends)] + [run_hashes(low, starts, np.minimum(ends, starts + size)) for size in heads]
