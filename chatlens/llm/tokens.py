"""Words of a public tokenizer's vocabulary file, each encoded once and kept.

The file's normaliser and pre-tokenizer (NFC, lower case; contractions, runs of
letters, single digits, runs of other characters) are followed on the bytes of
plain texts, those of characters up to U+00FF, and left to the library for others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from chatlens.llm.textbytes import PIECE, run_hashes

#: Different words that are kept, with their bytes; with more, the store starts anew.
KEPT_WORDS = 500_000
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


def _kind(character: str) -> int:
    if character in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    kind = unicodedata.category(character)
    return ODD if kind == "Cc" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


#: Kinds of single bytes, and of the characters U+0080 to U+00FF by their number from U+0080.
ONE_BYTE = np.array([_kind(chr(b)) if b < 128 else ODD for b in range(256)], np.uint8)
TWO_BYTES = np.array([_kind(chr(c)) for c in range(0x80, 0x100)], np.uint8)
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, where words start, where they end, which texts are odd).

    Odd texts hold other characters, or what may be a special token; they are
    skipped here.
    """
    n = len(data)
    low = LOWERED[data]
    kind = ONE_BYTE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    follow = data[lead + 1]
    kind[lead] = kind[lead + 1] = TWO_BYTES[(follow & 0x3F) + np.where(data[lead] == 0xC3, 64, 0)]
    upper = (data[lead] == 0xC3) & (follow <= 0x9E) & (follow != 0x97)
    low[lead[upper] + 1] += 32
    sizes = np.diff(offsets)
    odd = np.zeros(len(sizes), bool)
    marks = np.flatnonzero(kind == ODD)
    angles = np.flatnonzero(data == 60)
    angles = angles[angles + 1 < n]
    marks = np.concatenate([marks, angles[data[angles + 1] == 124]])
    if len(marks):
        odd[np.searchsorted(offsets, marks, "right") - 1] = True
        kind[np.repeat(odd, sizes)] = SPACE
    begins = offsets[:-1][sizes > 0]
    before = np.empty_like(kind)
    before[:1], before[1:] = SPACE, kind[:-1]
    before[begins] = SPACE
    start = (kind != SPACE) & ((kind != before) | ((kind == NUMBER) & ((data & 0xC0) != 0x80)))
    quotes = np.flatnonzero((low == 39) & start)
    if len(quotes):
        # A quote that begins a run takes the letters of a contraction from the run behind it.
        text_end = offsets[np.searchsorted(offsets, quotes, "right")]
        ahead = lambda i: np.where(quotes + i < text_end, low[np.minimum(quotes + i, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
        for pair in (b"re", b"ve", b"ll"):
            size[(one == pair[0]) & (two == pair[1])] = 3
        quotes, size, text_end = quotes[size > 0], size[size > 0], text_end[size > 0]
        start[quotes + 1] = False
        rest = quotes + size
        rest = rest[rest < text_end]
        start[rest[kind[rest] == LETTER]] = True
    edges = np.flatnonzero(start | (kind == SPACE))
    is_start = start[edges]
    return low, edges[is_start], np.append(edges[1:], n)[is_start[: len(edges)]], odd


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the words."""
    out = run_hashes(low, starts, ends)
    out[out == 0] = 1
    return out


class WordStore:
    """Token ids of words, side by side in one array, found by the words' hashes; each new word is encoded once.

    A hash only says where to look: words are compared with the one that is
    kept there, and one that differs is encoded by itself.

    ``encode`` takes a list of different words as bytes and gives their ids in
    one array, and how many each has.  ``encode_odd`` takes an odd text and
    gives its ids.
    """

    def __init__(self, encode: Callable, encode_odd: Callable):
        self.encode, self.encode_odd = encode, encode_odd
        self._clear()

    def _clear(self) -> None:
        self.slots = 1 << 16
        self.keys = np.zeros(self.slots, np.uint64)
        self.values = np.zeros(self.slots, np.int32)
        self.words = 0
        self.begin = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int32)
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        #: The words' bytes, side by side, where each begins, and how many it has.
        self.letters = np.empty(1 << 17, np.uint8)
        self.place = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.lettered = 0

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 for new ones: open addressing, all at once."""
        mask = np.uint64(self.slots - 1)
        slot = (wanted & mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == wanted, self.values[slot], -1)
        left = np.flatnonzero((held != wanted) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.slots - 1)
            held = self.keys[slot[left]]
            right = held == wanted[left]
            out[left[right]] = self.values[slot[left[right]]]
            left = left[~right & (held != 0)]
        return out

    def _put(self, new: np.ndarray, numbers: np.ndarray) -> None:
        slot = (new & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(new))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = new[free]
            won = free[self.keys[slot[free]] == new[free]]
            self.values[slot[won]] = numbers[won]
            left = left[self.keys[slot[left]] != new[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def _keep(self, words: list[bytes]) -> np.ndarray:
        """Encodes words and gives their numbers."""
        flat, counts = self.encode(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        total = self.words + len(words)
        for name, used, more in (
            *((name, self.words, len(words)) for name in ("begin", "count", "place", "size")),
            ("flat", self.used, len(flat)),
            ("letters", self.lettered, len(letters)),
        ):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate([held[:used], np.empty(max(len(held), more), held.dtype)]))
        own = slice(self.words, total)
        self.begin[own], self.count[own] = self.used + np.cumsum(counts) - counts, counts
        self.place[own], self.size[own] = self.lettered + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.letters[self.lettered : self.lettered + len(letters)] = letters
        self.words, self.used, self.lettered = total, self.used + len(flat), self.lettered + len(letters)
        return np.arange(own.start, own.stop, dtype=np.int32)

    def _add(self, new: np.ndarray, words: list[bytes]) -> None:
        total = self.words + len(new)
        if 2 * total > self.slots:
            known = self.keys != 0
            keys, values = self.keys[known], self.values[known]
            while 2 * total > self.slots:
                self.slots *= 4
            self.keys, self.values = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
            self._put(keys, values)
        self._put(new, self._keep(words))

    def _differing(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The words that are not the kept ones of their hashes."""
        sizes = ends - starts
        wrong = sizes != self.size[number]
        # Hashes of up to eight bytes say all; see run_hashes().
        longer = np.flatnonzero((sizes > 8) & ~wrong)
        upto, at = np.cumsum(sizes[longer]), 0
        while at < len(longer):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, "right")))
            part = longer[at:stop]
            n = sizes[part]
            from_start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            unlike = low[np.repeat(starts[part], n) + from_start] != self.letters[np.repeat(self.place[number[part]], n) + from_start]
            if unlike.any():
                wrong[np.repeat(part, n)[unlike]] = True
            at = stop
        return np.flatnonzero(wrong)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin; the last entry is the end."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        low, starts, ends, odd = split_words(data, offsets)
        wanted = hashes(low, starts, ends)
        number = self._find(wanted)
        if (number < 0).any():
            new, where = np.unique(wanted[number < 0], return_index=True)
            if self.words and self.words + len(new) > KEPT_WORDS:
                self._clear()
                new, where = np.unique(wanted, return_index=True)
            else:
                where = np.flatnonzero(number < 0)[where]
            raw = low.tobytes()
            self._add(new, [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            number = self._find(wanted)
        others = self._differing(low, starts, ends, number)
        if len(others):
            own = [low[a:b].tobytes() for a, b in zip(starts[others].tolist(), ends[others].tolist())]
            different = dict.fromkeys(own)
            known = dict(zip(different, self._keep(list(different)).tolist()))
            number[others] = [known[w] for w in own]
        counts = self.count[number].astype(np.int64)
        to = np.cumsum(counts)
        flat = self.flat[np.repeat(self.begin[number] - (to - counts), counts) + np.arange(to[-1] if len(to) else 0)]
        begins = np.append(0, to)[np.searchsorted(starts, offsets)]
        if not odd.any():
            return flat, begins
        raw = data.tobytes()
        parts = [
            np.array(self.encode_odd(raw[offsets[i] : offsets[i + 1]].decode()), np.uint32) if odd[i] else flat[begins[i] : begins[i + 1]]
            for i in range(len(odd))
        ]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
