"""Sorted runs of suffixes: front coding, and a merge that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from chatlens.llm.textbytes import mix

#: Bytes that a repeat has at least, and bytes of the grams that anchor it.
MATCH, GRAM = 50, 24
#: Grams in a match: one of them is the least, and that one is an anchor.
SPAN = MATCH - GRAM + 1
#: An anchor's record: MATCH bytes from it on, how many are there, SPAN - 1 bytes before it
#: from right to left, and how many are there.  Missing bytes are 0.
BEFORE = SPAN - 1
WIDTH = MATCH + 1 + BEFORE + 1
#: Bytes hashed at once.
BLOCK = 1 << 18


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = best(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are least in some MATCH bytes of one text; all of equal ones."""
    n = len(data)
    if n < MATCH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = np.ones(n, bool)
    # A match that starts fewer than MATCH bytes before the end of its text is none.
    for begin, end in zip(offsets[:-1], offsets[1:]):
        whole[max(begin, end - MATCH + 1) : end] = False
    places, hashes = [], []
    for at in range(0, n, BLOCK):
        # Grams that start in this block; the matches that hold them start SPAN - 1 bytes sooner.
        low, high = max(0, at - SPAN + 1), min(n, at + BLOCK + MATCH + SPAN)
        part = data[low:high].astype(np.uint64)
        eight = part
        for shift in (1, 2, 4):
            eight = eight[:-shift] | eight[shift:] << np.uint64(8 * shift)
        gram = mix(eight[: len(part) - GRAM + 1])
        for k in range(8, GRAM, 8):
            gram = mix((gram + np.uint64(0x9E3779B97F4A7C15)) ^ eight[k : k + len(gram)])
        gram |= np.uint64(1)
        if len(gram) < SPAN:
            break
        least = _sliding(gram, SPAN, np.minimum)
        least = np.where(whole[low : low + len(least)], least, np.uint64(0))
        # Gram p lies in the matches from p - SPAN + 1 to p: the greatest of their leasts must be its own.
        padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
        top = _sliding(padded, SPAN, np.maximum)[: len(gram)]
        mine = slice(at - low, min(len(gram), at - low + BLOCK))
        found = np.flatnonzero(top[mine] == gram[mine])
        places.append(found + at)
        hashes.append(gram[mine][found])
    return np.concatenate(places), np.concatenate(hashes)


def records(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The records of the anchors at these positions, as rows of WIDTH bytes."""
    text = np.searchsorted(offsets, at, "right") - 1
    right = np.minimum(offsets[text + 1] - at, MATCH)
    left = np.minimum(at - offsets[text], BEFORE)
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(MATCH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + MATCH)[at]
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, :MATCH] = around[:, BEFORE:]
    out[:, :MATCH][np.arange(MATCH) >= right[:, None]] = 0
    out[:, MATCH] = right
    out[:, MATCH + 1 : -1] = around[:, BEFORE - 1 :: -1][:, :BEFORE]
    out[:, MATCH + 1 : -1][np.arange(BEFORE) >= left[:, None]] = 0
    out[:, -1] = left
    return out


def sorted_run(rows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different records in order, the least owner of each, which of them each row is)."""
    if not len(rows):
        return rows, owners, np.empty(0, np.int64)
    keys = np.ascontiguousarray(rows).view(f"V{WIDTH}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    ordered = rows[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], np.minimum.reduceat(owners[order], np.flatnonzero(new)), which


def front_code(run: np.ndarray) -> tuple[bytes, bytes]:
    """(length of the prefix shared with the record before, the rest of each) of a sorted run."""
    shared = np.zeros(len(run), np.uint8)
    shared[1:] = (run[1:] != run[:-1]).argmax(axis=1)
    return shared.tobytes(), run[np.arange(WIDTH) >= shared[:, None]].tobytes()


class Run:
    """A front-coded run being read: its current record, and how much that shares with the last one taken."""

    __slots__ = ("shared", "rest", "owners", "at", "place", "record", "known")

    def __init__(self, shared: bytes, rest: bytes, owners: list[int]):
        self.shared, self.rest, self.owners = shared, rest, owners
        self.at, self.place, self.known = -1, 0, 0
        self.record = b""

    def step(self) -> bool:
        """Goes to the next record; False at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return False
        known = self.shared[self.at]
        end = self.place + WIDTH - known
        self.record = self.record[:known] + self.rest[self.place : end]
        self.place, self.known = end, known
        return True


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(record, length of the prefix shared with the one before, number of its run) over all runs, in order.

    A tournament tree of losers.  ``known`` of a run is how much its record
    shares with the last winner.  Of two, the one that shares more is the lesser,
    without a look at either; only of equals are the bytes behind the known
    prefix compared, and the loser then knows what it shares with the winner.
    """
    live = [run.step() for run in runs]
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    losers = [-1] * size
    count = len(runs)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two leaves; -1, or a run that has ended, always loses."""
        if b < 0 or b >= count or not live[b]:
            return a, b
        if a < 0 or a >= count or not live[a]:
            return b, a
        x, y = runs[a], runs[b]
        if x.known != y.known:
            return (a, b) if x.known > y.known else (b, a)
        u, v, k = x.record, y.record, x.known
        if u[k:] == v[k:]:
            winner, loser = (a, b) if a < b else (b, a)
            runs[loser].known = WIDTH
            return winner, loser
        while u[k] == v[k]:
            k += 1
        if u[k] < v[k]:
            y.known = k
            return a, b
        x.known = k
        return b, a

    for run in runs:
        run.known = 0  # all against nothing, at first

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if size > 1 else 0
    while 0 <= top < count and live[top]:
        run = runs[top]
        yield run.record, run.known, top
        live[top] = run.step()
        node = (top + size) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1
