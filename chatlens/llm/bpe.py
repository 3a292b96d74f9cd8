"""Byte-pair encoding by a walk over the trie of the distinct words.

The encoding of a prefix is known by its last token: that token and the last
token of the prefix before it must be a pair that merging leaves apart, and of
all tokens that end there just one is.  So a depth-first walk over the trie of
the words needs one state, the last token, for each node, and every shared
prefix is encoded once.  Words in sorted order are that walk: the states of the
prefix shared with the word before stay on the stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm.common import map_arrow
from chatlens.llm.textbytes import pieces, text_bytes
from chatlens.llm.tokens import WordStore

END_OF_WORD = "</w>"
#: Pairs of tokens whose compatibility is remembered; with more, the memory starts anew.
KEPT_PAIRS = 500_000
NEVER = 1 << 60
TAIL = 3


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in printable else next(others) for b in range(256)]


class Vocabulary:
    """A vocabulary file of the library: byte-level BPE with word ends, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.path = path
        vocab = held["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for string, number in [*vocab.items(), *self.special.items()]:
            self.strings[number] = string
        self.merged = {}
        for rank, (a, b) in enumerate(held["model"]["merges"]):
            self.merged.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        of_character = {c: b for b, c in enumerate(byte_characters())}
        #: Bytes of a token -> its id, for tokens inside words and tokens that end them.
        self.inside, self.ending, self.symbols = {}, {}, {}
        base = byte_characters()
        for string, number in vocab.items():
            ends = string.endswith(END_OF_WORD) and string != END_OF_WORD
            held_bytes = bytes(of_character[c] for c in (string[: -len(END_OF_WORD)] if ends else string))
            parts = [vocab[base[b]] for b in held_bytes]
            if ends:
                parts[-1] = vocab[base[held_bytes[-1]] + END_OF_WORD]
            (self.ending if ends else self.inside)[held_bytes] = number
            self.symbols[number] = parts
        self._splits: dict[int, tuple | None] = {}
        self._apart: dict[int, bool] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def at_special(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, self.special)) + ")" if self.special else "(?!)")

    def encode_text(self, text: str) -> list[int]:
        """Ids of any text, split by the library's own normaliser and pre-tokenizer."""
        out: list[int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                words = [bytes(self.byte_of[c] for c in word) for word, _ in shown]
                flat, counts = self.encode_words(different := list(dict.fromkeys(words)))
                ends = np.cumsum(counts)
                ids = {w: flat[e - n : e].tolist() for w, e, n in zip(different, ends.tolist(), counts.tolist())}
                out += [x for word in words for x in ids[word]]
        return out

    @cached_property
    def byte_of(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(byte_characters())}

    def split_of(self, token: int) -> tuple[int, int, int] | None:
        """(left, right, rank) of the merge that makes a token of its own symbols; None if they don't make it."""
        if token not in self._splits:
            parts, last = list(self.symbols[token]), None
            while len(parts) > 1:
                rank, at = min((self.merged.get((a, b), (NEVER,))[0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                last = (parts[at], parts[at + 1], rank)
                parts[at : at + 2] = [self.merged[last[:2]][1]]
            self._splits[token] = last if parts == [token] else None
        return self._splits[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge while a token is merged, each with the rank of the merge that takes it."""
        out = [(token, NEVER)]
        while split := self.split_of(out[-1][0]):
            out.append((split[side], split[2]))
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a and b, side by side, as they are."""
        key = a << 32 | b
        known = self._apart.get(key)
        if known is None:
            # A merge across the border happens while both its parts are at the
            # border; of equal ranks the left one is first, so b's must be lower.
            known = not any(
                (found := self.merged.get((x, y))) and found[0] < x_ends and found[0] <= y_ends
                for x, x_ends in self._edge(a, 1)
                for y, y_ends in self._edge(b, 0)
            )
            if len(self._apart) >= KEPT_PAIRS:
                self._apart.clear()
            self._apart[key] = known
        return known

    @cached_property
    def usable(self) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """The tokens inside and at the end of words that merging can make at all."""
        made = lambda t: len(self.symbols[t]) == 1 or self.split_of(t) is not None
        return tuple({w: t for w, t in own.items() if made(t)} for own in (self.inside, self.ending))

    @cached_property
    def reach(self) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """By the last bytes of a token, TAIL of them: how long a token may be that ends so."""
        out = ({}, {})
        for own, longest in zip(self.usable, out, strict=True):
            for token in own:
                tail = token[-TAIL:]
                longest[tail] = max(len(token), longest.get(tail, 0))
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, side by side in the order given, and how many each has."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list = [None] * len(words)
        # By length of the prefix: its last token, and the length of what is before that.
        last: list[int] = [-1]
        since: list[int] = [0]
        previous = b""
        inside, ending = (own.get for own in self.usable)
        inner_reach, ending_reach = (own.get for own in self.reach)
        known, apart = self._apart, self.apart
        for i in order:
            word = words[i]
            size = len(word)
            shared, most = 0, min(len(last), size)
            # The states of the prefix shared with the word before stay.
            while shared < most and shared < len(previous) and word[shared] == previous[shared]:
                shared += 1
            shared = min(shared + 1, most)
            del last[shared:], since[shared:]
            for end in range(shared, size + 1):
                if end < size:
                    tokens, far = inside, inner_reach
                else:
                    tokens, far = ending, ending_reach
                # No token that ends with these bytes is longer; shorter ones than TAIL always remain.
                begin = max(0, end - max(far(word[max(0, end - TAIL) : end], 0), TAIL - 1))
                while True:
                    token = tokens(word[begin:end])
                    if token is not None:
                        if not begin:
                            break
                        left = last[begin]
                        fits = known.get(left << 32 | token)
                        if apart(left, token) if fits is None else fits:
                            break
                    begin += 1
                last.append(token)
                since.append(begin)
            ids, end = [], size
            while end:
                ids.append(last[end])
                end = since[end]
            ids.reverse()
            out[i] = ids
            # The state of the whole word holds for its end only, not as a prefix.
            last.pop()
            since.pop()
            previous = word
        counts = np.array([len(ids) for ids in out], np.int64)
        return np.fromiter((x for ids in out for x in ids), np.uint32, int(counts.sum())), counts

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode() with special tokens: this file has no decoder, so tokens with blanks between."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_LOADED: dict[str, tuple[Vocabulary, WordStore]] = {}


def loaded(path: str) -> tuple[Vocabulary, WordStore]:
    """The vocabulary and the words met so far, once in each Python worker."""
    if path not in _LOADED:
        vocabulary = Vocabulary(path)
        _LOADED[path] = vocabulary, WordStore(vocabulary.encode_words, vocabulary.encode_text)
    return _LOADED[path]


def _fields(frame: DataFrame, *added: T.StructField) -> T.StructType:
    return T.StructType([f for f in frame.schema.fields if f.name not in {a.name for a in added}] + list(added))


def encode(documents: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids``: the token ids of each text as little-endian unsigned 32-bit integers.

    Every row is encoded where it is; nothing is shuffled.  Null and empty
    texts, and texts of white space, have no ids.  Repeated rows stay; a column
    named ids is replaced.  ``keep`` names the other columns that come back, all
    if it is not given.
    """
    kept = [c for c in documents.columns if c != "ids"]
    shown = kept if keep is None else [c for c in kept if c in keep]
    fields = _fields(documents.select(*shown), T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, store = loaded(path)
        for batch in pieces(batches, text):
            flat, begins = store.ids(*text_bytes(batch.column(text)))
            data = flat.astype("<u4").tobytes()
            ids = pa.array([data[4 * a : 4 * b] for a, b in zip(begins, begins[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in shown], ids], names=[*shown, "ids"])

    return map_arrow(documents.select(*kept), run, fields)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text that ids stand for; null ids are none. A column of that name is replaced.

    What encode() returned is decoded where it is encoded, in the same worker.
    """
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(path)
        for batch in pieces(batches, ids):
            texts = [vocabulary.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, "decoded"]
            )

    fields = _fields(encoded, T.StructField("decoded", T.StringType()))
    return map_arrow(encoded if kept == encoded.columns else encoded.select(*kept), run, fields)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
