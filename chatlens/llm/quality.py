"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled documents, and
flattened into arrays: node i of a tree has its children at 2i + 1 and 2i + 2,
so all rows walk all trees in as many array steps as trees are deep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm.common import map_arrow
from chatlens.llm.textbytes import IS_DIGIT, IS_LOWER, IS_UPPER, mix, pieces, text_bytes, word_bounds, word_hashes

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS = 80, 4, 64
RATE, L2, LEAST_WEIGHT = 0.15, 1.0, 2.0

_spaces = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_letters, _high = IS_UPPER | IS_LOWER, np.arange(256) >= 128
_marks = ~(_letters | _high | IS_DIGIT | _spaces)
_common_marks = np.isin(np.arange(256), list(b".,"))
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "digits", "marks", "rare_marks", "spaces", "high", "top_mark",
    "word_bytes", "word_bytes_spread", "distinct_words", "top_word", "doubled_words", "doubled_run",
    "line_words", "distinct_lines", "most_upper_line", "most_marked_line", "upper_lines", "marked_lines",
)


def _runs(flags: np.ndarray) -> np.ndarray:
    """At each place, how many flags in a row end there."""
    at = np.arange(1, len(flags) + 1)
    return at - np.maximum.accumulate(np.where(flags, 0, at))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    column = {name: out[:, i] for i, name in enumerate(STATISTICS)}
    text_of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text_of * 256 + data, minlength=n * 256).reshape(n, 256)
    per_byte = 1.0 / np.maximum(sizes, 1)
    letters = np.maximum(counts[:, _letters].sum(axis=1), 1)
    column["log_bytes"][:] = np.log1p(sizes)
    column["upper"][:] = counts[:, IS_UPPER].sum(axis=1) / letters
    for name, kind in (("digits", IS_DIGIT), ("marks", _marks), ("spaces", _spaces), ("high", _high)):
        column[name][:] = counts[:, kind].sum(axis=1) * per_byte
    rare = counts[:, _marks & ~_common_marks]
    column["rare_marks"][:] = rare.sum(axis=1) * per_byte
    column["top_mark"][:] = rare.max(axis=1) * per_byte

    starts, ends = word_bounds(data, offsets)
    hashed = word_hashes(data, starts, ends)[0]
    own = text_of[starts]
    words = np.bincount(own, minlength=n)
    per_word = 1.0 / np.maximum(words, 1)
    long = (ends - starts).astype(float)
    mean = np.bincount(own, long, n) * per_word
    column["log_words"][:] = np.log1p(words)
    column["word_bytes"][:] = mean
    column["word_bytes_spread"][:] = np.sqrt(np.maximum(np.bincount(own, long**2, n) * per_word - mean**2, 0))
    _, where, times = np.unique(
        mix(hashed ^ own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True
    )
    column["distinct_words"][:] = np.bincount(own[where], minlength=n) * per_word
    np.maximum.at(column["top_word"], own[where], times)
    column["top_word"][:] *= per_word
    doubled = np.append(False, (hashed[1:] == hashed[:-1]) & (own[1:] == own[:-1])) if len(own) else np.empty(0, bool)
    column["doubled_words"][:] = np.bincount(own[doubled], minlength=n) * per_word
    np.maximum.at(column["doubled_run"], own, np.log1p(_runs(doubled)))

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][sizes > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_of = text_of[line_starts]
    lines = np.bincount(line_of, minlength=n)
    per_line = 1.0 / np.maximum(lines, 1)
    column["log_lines"][:] = np.log1p(lines)
    column["line_words"][:] = words * per_line
    keys = mix(word_hashes(data, line_starts, line_ends)[0] ^ line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    column["distinct_lines"][:] = np.bincount(line_of[np.unique(keys, return_index=True)[1]], minlength=n) * per_line

    def share(kind: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = [np.append(0, np.cumsum(k[data])) for k in (kind, of)]
        part, whole = (s[line_ends] - s[line_starts] for s in sums)
        return part / np.maximum(whole, 20)

    for name, found in (("upper", share(IS_UPPER, _letters)), ("marked", share(_marks & ~_common_marks, ~_spaces))):
        np.maximum.at(column[f"most_{name}_line"], line_of, found)
        column[f"{name}_lines"][:] = np.bincount(line_of, found > 0.15, n) * per_line
    return out


@dataclass
class Trees:
    """Flattened trees: by tree and node the statistic asked and its limit; by tree and leaf the value."""

    base: float
    asked: np.ndarray
    limits: np.ndarray
    values: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for asked, limits, values in zip(self.asked, self.limits, self.values):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, asked[node]] > limits[node])
            total += values[node - len(asked)]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosts TREES trees on the logistic loss; without rows of both labels the score is that of the one label there is.

    No labelled rows at all give a score of nearly 1: nothing speaks against a text.
    """
    inner = 2**DEPTH - 1
    flat = Trees(0.0, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)))
    share = labels.mean() if len(labels) else 1.0
    flat.base = float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / np.clip(1 - share, 1e-9, 1)))
    if not 0 < share < 1:
        return flat
    n, wide = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.arange(1, BINS) / BINS)) for j in range(wide)]
    binned = np.stack([np.searchsorted(c, rows[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(n, flat.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, weight = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            at = (node - first) * BINS
            best, choice = np.full(many, 1e-6), np.full((many, 2), -1)
            for j in range(wide):
                if not len(cuts[j]):
                    continue
                sums = [
                    np.bincount(at + binned[:, j], w, many * BINS).reshape(many, BINS).cumsum(axis=1) for w in (slope, weight)
                ]
                (g, h), (g_all, h_all) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                gain = g**2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
                gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                choice[better] = np.stack([np.full(many, j), top], axis=1)[better]
            for k, (j, b) in enumerate(choice):
                if j >= 0:
                    flat.asked[t, first + k], flat.limits[t, first + k] = j, cuts[j][b]
            asked, limits = flat.asked[t][node], flat.limits[t][node]
            node = 2 * node + 1 + (rows[np.arange(n), asked] > limits)
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, weight, inner + 1)
        flat.values[t] = -RATE * g / (h + L2)
        total += flat.values[t][leaf]
    return flat


def _mapped(documents: DataFrame, columns: list[str], field: T.StructField, value) -> DataFrame:
    """The columns and one more, made from the statistics of ``text``."""
    kept = documents.select(*[c for c in columns if c != field.name])
    schema = T.StructType([*kept.schema.fields, field])
    names = schema.names
    # A text that is among the columns is sent once.
    text, more = ("text", []) if "text" in kept.columns else ("__text", [F.col("text").alias("__text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            made = value(statistics(*text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], made], names=names)

    return map_arrow(documents.select(*kept.columns, *more), run, schema)


def fit(documents: DataFrame, labels: DataFrame) -> Trees:
    """Trees from rows (doc_id, label) and the texts of those documents.

    Of more than SAMPLE labelled rows, those with the least hash of doc_id are
    taken.  Rows without an id or a label are left out; of an id's several
    labels the greatest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE rows of two numbers are sent to all executors.
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    field = T.StructField("statistics", T.ArrayType(T.DoubleType()))
    found = _mapped(rows, ["label", "doc_id"], field, lambda x: pa.array(list(x), pa.list_(pa.float64())))
    held = found.orderBy("doc_id", "statistics").limit(2 * SAMPLE).toPandas()
    shape = (len(held), len(STATISTICS))
    return grow(np.array(held.statistics.tolist(), float).reshape(shape), held.label.to_numpy(float))


def score(documents: DataFrame, trees: Trees, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the column ``name``, 0 to 1, to ``columns`` (all by default), from the text alone.

    A null text is an empty one, whose statistics are all 0.  Repeated rows
    stay; a column of that name is replaced; an empty table gives none.
    """
    made = lambda x: pa.array(trees.score(x), pa.float64())
    return _mapped(documents, columns or documents.columns, T.StructField(name, T.DoubleType()), made)
