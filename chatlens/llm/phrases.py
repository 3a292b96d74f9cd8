"""Phrase collocations from an FM-index for each shard of the corpus.

Texts are cut into shards of some SHARD bytes.  The words of all shards are
counted; of a phrase that occurs often enough all words do, so each shard's
index is of the numbers of such words, everything else being a border.  Then
phrases grow by a word at a time: a shard extends the intervals of the phrases
that are frequent in the whole corpus, to the left or to the right by turns,
and sends one row with its count for each extension whose other part is
frequent too.  Sums over the shards give the frequent phrases of the next size.
Up to a bound these are sent to all shards, beyond it only to those that hold
them, by a shuffle.

A phrase is known by its two parts, without its last and without its first
word, so counts of parts and extensions come from joins on numbers.  What a
task holds is one shard; what is shuffled is a row per shard and phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import drop, give_back, map_arrow, ship, steady_memory, written
from chatlens.llm.fm_index import BiIndex, holders, transform
from chatlens.llm.textbytes import LOWERED, pieces, text_bytes

#: Bytes of text in a shard; a longer text is one alone.
SHARD = 6 << 20
#: Frequent phrases of one size, two or three numbers or one word each, that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: What stands for a language that is null.
NO_LANGUAGE = "und"
#: Scores are parts of so many halves: twice the share of a phrase in its parts.
PER_UNIT = 2_000_000

_byte = np.arange(256)
IS_BLANK = (_byte == 0x20) | (_byte == 0x09)
IS_BORDER = np.isin(_byte, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, their low bytes apart from their high ones."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(held, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _matched(frame: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join with frequent phrases, which are broadcast if there are at most BROADCAST_ROWS of them."""
    return frame.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent, keys)


def shard_words(data: np.ndarray, offsets: np.ndarray, language: np.ndarray, languages: int) -> tuple:
    """(distinct words as bytes, their languages, counts, sequence) of texts side by side.

    The sequence has the number of each word, from 1, and 0 before each piece
    of a text and at the end.  A word of two languages is two words.
    """
    inside = ~(IS_BLANK | IS_BORDER)[data]
    before = np.append(False, inside[:-1])[: len(inside)]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False
    after = np.append(inside[1:], False)[: len(inside)]
    after[begins[begins > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    letters = LOWERED[data[inside]]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(letters)])
    coded = column.dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    both = coded.indices.to_numpy().astype(np.int64) * languages + language[text]
    counts = np.bincount(both, minlength=len(coded.dictionary) * languages)
    used = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int64)
    number[used] = np.arange(1, len(used) + 1)
    # The words before which a piece begins: those next to a border, and the first ones of texts.
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[np.searchsorted(starts, np.flatnonzero(IS_BORDER[data]))] = True
    fresh[np.searchsorted(starts, begins)] = True
    sequence = np.append(np.insert(number[both], np.flatnonzero(fresh[:-1]), 0), 0)
    return coded.dictionary.take(pa.array(used // languages)), used % languages, counts[used], sequence


def _shards(documents: DataFrame) -> DataFrame:
    """Written rows (shard, length, sequence) for each shard, and (shard, lang, word, number, n) for each of its words."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in pieces(batches, "text", SHARD):
            own = int(text_bytes(batch.column("text"))[1][-1])
            if held and size + own > SHARD:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for table in gathered(batches):
            table = table.combine_chunks()
            names = table.column("lang").combine_chunks().dictionary_encode()
            data, offsets = text_bytes(table.column("text").combine_chunks())
            words, language, n, sequence = shard_words(data, offsets, names.indices.to_numpy(), len(names.dictionary))
            if not len(words):
                continue
            rows = len(words)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard]),
                    "length": pa.array([len(sequence)]),
                    "sequence": pa.array([_packed(sequence)], pa.binary()),
                    "lang": pa.nulls(1, pa.string()),
                    "word": pa.nulls(1, pa.string()),
                    "number": pa.nulls(1, pa.int32()),
                    "n": pa.nulls(1, pa.int64()),
                }
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(np.full(rows, shard)),
                    "length": pa.nulls(rows, pa.int64()),
                    "sequence": pa.nulls(rows, pa.binary()),
                    "lang": names.dictionary.take(pa.array(language)).cast(pa.string()),
                    "word": words.cast(pa.large_string()).cast(pa.string()),
                    "number": pa.array(np.arange(1, rows + 1), pa.int32()),
                    "n": pa.array(n),
                }
            )
            shard += 1

    schema = "shard bigint, length bigint, sequence binary, lang string, word string, number int, n bigint"
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return written(map_arrow(texts, run, schema), "phrase-shards")


PAIRS = "shard bigint, low int, back int, n bigint, head bigint, tail bigint"


def _pair_rows(shard: int, low, back, n, head, tail) -> pa.Table:
    columns = [np.full(len(low), shard, np.int64), low.astype(np.int32), back.astype(np.int32), n, head, tail]
    return pa.table([pa.array(c) for c in columns], names=["shard", "low", "back", "n", "head", "tail"])


def grown(index: BiIndex, low: np.ndarray, back: np.ndarray, n: np.ndarray, number: np.ndarray, left: bool) -> tuple:
    """(low, back, n, head, tail) of the phrases one word longer, both parts of which are among those given.

    head and tail are the numbers of the phrase without its last and without its first word.
    """
    found = index.extended(low, back, n, left)
    # The other part is a prefix in the transform that was extended, so its interval holds this one.
    other = holders(low if left else back, n, found.low if left else found.back)
    whole = other >= 0
    other, own = number[other[whole]], number[found.parent[whole]]
    return found.low[whole], found.back[whole], found.count[whole], *((other, own) if left else (own, other))


def _sequences(shards: DataFrame, words: DataFrame) -> DataFrame:
    """Written rows (shard, grams, length, sequence): each shard's numbers of frequent words, by place in ``grams``."""
    known = _matched(shards.where("word IS NOT NULL"), words.select("lang", "word", "gram"), ["lang", "word"])

    def run(sequences: pa.Table, known: pa.Table) -> pa.Table:
        if not sequences.num_rows or not known.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        shard, length, held = (sequences.column(c)[0].as_py() for c in ("shard", "length", "sequence"))
        gram, local, n = (known.column(c).to_numpy() for c in ("gram", "number", "n"))
        steady_memory()
        # Common words have low numbers, which take little room.
        order = np.lexsort((gram, -n))
        symbol = np.zeros(int(length) + 1, np.int64)
        symbol[local[order]] = np.arange(1, len(order) + 1)
        sequence = symbol[_unpacked(held, length)]
        # Borders side by side are one.
        sequence = sequence[np.append(True, (sequence[1:] != 0) | (sequence[:-1] != 0))]
        give_back()
        row = [[shard], [gram[order].astype("<i8").tobytes()], [len(sequence)], [_packed(sequence)]]
        return pa.table([pa.array(c, t) for c, t in zip(row, kinds)], names=names)

    names, kinds = ["shard", "grams", "length", "sequence"], [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    sequences = shards.where("sequence IS NOT NULL").select("shard", "length", "sequence")
    known = known.select(F.col("shard").alias("of"), "number", "gram", "n")
    both = sequences.groupBy("shard").cogroup(known.groupBy("of"))
    return written(both.applyInArrow(run, "shard bigint, grams binary, length bigint, sequence binary"), "phrase-sequences")


class Frequent:
    """Numbers of the frequent phrases of one size, found by the numbers of their two parts."""

    def __init__(self, head: np.ndarray, tail: np.ndarray, gram: np.ndarray):
        self.heads, first = np.unique(head, return_inverse=True)
        self.tails, second = np.unique(tail, return_inverse=True)
        key = first.astype(np.int64) * max(len(self.tails), 1) + second
        order = np.argsort(key)
        self.keys, self.grams = key[order], gram[order]

    def find(self, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of these phrases are frequent, their numbers)."""
        if not len(self.keys):
            return np.zeros(len(head), bool), np.empty(0, np.int64)
        first = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        second = np.minimum(np.searchsorted(self.tails, tail), len(self.tails) - 1)
        key = first * len(self.tails) + second
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.heads[first] == head) & (self.tails[second] == tail) & (self.keys[at] == key)
        return hit, self.grams[at[hit]]


def _to_left(size: int) -> bool:
    """The side to which phrases grow to this size: by turns."""
    return size % 2 == 0


def _pairs(sequences: DataFrame, smaller: list[Frequent], depth: int) -> DataFrame:
    """The phrases in each shard one word longer than the largest of ``smaller``, both parts of which are frequent.

    Each shard is searched anew from its words on; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                numbers, sequence = np.frombuffer(row["grams"], "<i8"), _unpacked(row["sequence"], row["length"])
                both = len(smaller) > 0
                index = BiIndex(transform(sequence, depth), transform(sequence[::-1], depth) if both else None, len(numbers))
                single = index.words()
                low, back, n, head, tail = grown(index, single.low, single.back, single.count, numbers, _to_left(2))
                for size, frequent in enumerate(smaller, 3):
                    hit, gram = frequent.find(head, tail)
                    low, back, n, head, tail = grown(index, low[hit], back[hit], n[hit], gram, _to_left(size))
                yield from _pair_rows(row["shard"], low, back, n, head, tail).to_batches()

    return map_arrow(sequences, run, PAIRS)


def _pairs_of(sequences: DataFrame, known: DataFrame, depth: int, left: bool) -> DataFrame:
    """The same from written rows (shard, low, back, n, gram) of the frequent phrases in each shard."""

    def run(sequence: pa.Table, known: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        if not sequence.num_rows or not known.num_rows:
            return _pair_rows(0, none, none, none, none, none)
        steady_memory()
        shard, held, length, packed = (sequence.column(c)[0].as_py() for c in ("shard", "grams", "length", "sequence"))
        one = _unpacked(packed, length)
        one = transform(one if left else one[::-1], depth)
        index = BiIndex(*((one, None) if left else (None, one)), len(held) // 8)
        known = known.sort_by("low")
        low, back, n, gram = (known.column(c).to_numpy().astype(np.int64) for c in ("low", "back", "n", "gram"))
        rows = _pair_rows(shard, *grown(index, low, back, n, gram, left))
        give_back()
        return rows

    ship(sequences.sparkSession)
    known = known.withColumnRenamed("shard", "of")
    return sequences.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(run, PAIRS)


def phrase_counts(documents: DataFrame, longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all phrases of 1 to ``longest`` words that occur ``least`` times or more, and the words of each language.

    phrases: gram (a number), lang, size, phrase, last (its last word), a (its
    count), heads and tails (counts of its first 1, 2 ... and last 1, 2 ...
    words), longer (the largest count of a frequent phrase one word longer that
    holds it; 0 for none).  totals: lang, n.

    A-Z are lower-cased; pieces are what is between ``.,;:!?`` and line breaks,
    words what is between blanks and tabs.  Null and empty texts have no words;
    a null language is NO_LANGUAGE; repeated rows count each time; other columns
    are left out; an empty table gives none.
    """
    spark = documents.sparkSession
    shards = _shards(documents)
    ship(spark)
    counted = shards.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    totals = written(shards.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = written(counted.where(F.col("a") >= least).withColumn("gram", F.monotonically_increasing_id()), "phrase-grams")
    level = words.select(
        "gram",
        "lang",
        F.col("word").alias("phrase"),
        F.col("word").alias("last"),
        "a",
        F.array("a").alias("heads"),
        F.array("a").alias("tails"),
    )
    sequences = _sequences(shards, words)
    drop(shards)
    levels, smaller, known = [], [], None
    for size in range(2, longest + 1):
        pairs = _pairs(sequences, smaller, longest) if known is None else _pairs_of(sequences, known, longest, _to_left(size))
        grams = pairs.groupBy("head", "tail").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        grams = written(grams.withColumn("gram", F.monotonically_increasing_id()), "phrase-grams")
        either = grams.select(F.explode(F.array("head", "tail")).alias("gram"), "a")
        longer = either.groupBy("gram").agg(F.max("a").alias("longer"))
        done = level.join(longer, "gram", "left").withColumns({"longer": F.coalesce("longer", F.lit(0)), "size": F.lit(size - 1)})
        levels.append(done)
        heads = level.select(F.col("gram").alias("head"), "lang", "phrase", "heads")
        tails = level.select(F.col("gram").alias("tail"), "last", "tails")
        level = written(
            grams.join(heads, "head")
            .join(tails, "tail")
            .select(
                "gram",
                "lang",
                F.concat_ws(" ", "phrase", "last").alias("phrase"),
                "last",
                "a",
                F.concat("heads", F.array("a")).alias("heads"),
                F.concat("tails", F.array("a")).alias("tails"),
            ),
            "phrase-level",
        )
        if size == longest:
            break
        numbered = grams.select("head", "tail", "gram")
        if known is None and numbered.count() <= BROADCAST_ROWS:
            found = numbered.toArrow()  # at most BROADCAST_ROWS rows of three numbers
            smaller.append(Frequent(*(found.column(c).to_numpy() for c in ("head", "tail", "gram"))))
        else:
            spent = known
            known = written(pairs.join(numbered, ["head", "tail"]).select("shard", "low", "back", "n", "gram"), "phrase-known")
            if spent is not None:
                drop(spent)
    if known is not None:
        drop(known)
    drop(sequences)
    levels.append(level.withColumns({"longer": F.lit(0).cast("bigint"), "size": F.lit(longest)}))
    phrases = levels[0]
    for each in levels[1:]:
        phrases = phrases.unionByName(each)
    return phrases, totals


def collocations(documents: DataFrame, longest: int = 4, least: int = 30, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a, cut in two parts of counts l and r, scores
    floor(PER_UNIT * a / (l + r)); the cut with the lowest score counts, then the
    one with the fewest words before it.  A phrase that a frequent longer one
    holds in four fifths of its occurrences is left out; as counts fall with
    length, it is enough to look one word further.  Ties go by count, then by
    phrase in the order of its bytes.  As for odd rows see phrase_counts().
    """
    phrases, totals = phrase_counts(documents, longest, least)
    kept = phrases.where("size > 1 AND 5 * longer < 4 * a")
    size = F.col("size")

    def cut(k):
        l, r = F.element_at("heads", k), F.element_at("tails", (size - k).cast("int"))  # noqa: E741
        share = F.expr(f"CAST({PER_UNIT} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))")
        both = (l.cast("decimal(19,0)") + r.cast("decimal(19,0)")).alias("both")
        return F.struct(F.call_function("div", share, both).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    scored = kept.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
