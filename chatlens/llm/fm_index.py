"""A bidirectional FM-index over word numbers, in numpy.

Two Burrows-Wheeler transforms, of a sequence and of its reverse, sorted to a
limited depth: enough for patterns of up to that many words.  A pattern is an
interval of rows in either; the symbols beside it in one transform give all its
extensions to that side at once, with their counts and intervals, and the
number of smaller symbols moves the interval in the other.  Number 0 is a
border that no pattern crosses.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Patterns(NamedTuple):
    """Intervals: first rows in the two transforms, sizes (counts), and what each was extended from and by."""

    low: np.ndarray
    back: np.ndarray
    count: np.ndarray
    parent: np.ndarray
    symbol: np.ndarray


def stable_order(key: np.ndarray, largest: int) -> np.ndarray:
    """argsort(kind="stable") of numbers from 0 to ``largest``.

    Where the places fit into the bits below the numbers, values are sorted, which is several times faster.
    """
    bits = len(key).bit_length()
    if int(largest).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = key.astype(np.int64) << bits
    both |= np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def transform(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, in the order of the suffixes' first ``depth`` symbols; ties by place."""
    rank, span = sequence.astype(np.int64), 1
    while True:
        most = int(rank.max(initial=0)) + 1
        after = np.zeros_like(rank)
        after[:-span] = rank[span:]
        key = rank * most + after
        order = stable_order(key, most * most)
        span *= 2
        if span >= depth:
            return sequence[order - 1]
        key = key[order]
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1])[: len(key)])


class BiIndex:
    """Both transforms of a sequence of symbols 0 to ``symbols`` that begins and ends with 0.

    Extensions to one side need one transform only; the other may be None.
    """

    def __init__(self, forward: np.ndarray | None, backward: np.ndarray | None, symbols: int):
        self.forward, self.backward = forward, backward
        self.sizes = np.bincount(backward if forward is None else forward, minlength=symbols + 1)
        self.first = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def build(cls, sequence: np.ndarray, depth: int, symbols: int) -> BiIndex:
        return cls(transform(sequence, depth), transform(sequence[::-1], depth), symbols)

    def words(self) -> Patterns:
        """All single symbols but the border."""
        low, count = self.first[1:], self.sizes[1:]
        symbol = np.arange(1, len(self.first))
        return Patterns(low, low, count, np.full(len(low), -1), symbol)

    def extended(self, low: np.ndarray, back: np.ndarray, count: np.ndarray, left: bool) -> Patterns:
        """All extensions of patterns by one symbol to the left, or to the right; parent is the pattern's place."""
        here = self.forward if left else self.backward
        near, far = (low, back) if left else (back, low)
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(near)), count)
        row = np.arange(len(owner)) + np.repeat(near - (ends - count), count)
        width = len(self.first)
        key = owner * width + here[row]
        order = stable_order(key, max(len(near), 1) * width)
        key = key[order]
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        parent, symbol = np.divmod(key[fresh], width)
        found = np.diff(np.append(fresh, len(key)))
        smaller = fresh - (ends - count)[parent]
        # The first row of the interval that the symbol precedes tells how many of it come before.
        inverse = np.empty(len(here), np.int64)
        inverse[stable_order(here, width)] = np.arange(len(here))
        near, far = inverse[row[order[fresh]]], far[parent] + smaller
        real = symbol > 0
        low, back = (near, far) if left else (far, near)
        return Patterns(low[real], back[real], found[real], parent[real], symbol[real])


def holders(low: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each row the place of the interval that it lies in, -1 for none; intervals don't overlap."""
    order = np.argsort(low, kind="stable")
    at = np.searchsorted(low[order], row, "right") - 1
    place = order[np.maximum(at, 0)] if len(order) else np.zeros(len(row), np.int64)
    inside = (at >= 0) & (row < (low + count)[place]) if len(order) else np.zeros(len(row), bool)
    return np.where(inside, place, -1)
