"""Toxicity: a linear-chain conditional random field over the words of a text.

Words bear one of two tags.  Features of a word are itself and its first letters,
hashed; a transition weight joins the tags of neighbours.  Forward-backward
marginals give each word a probability, toxic spans are runs of likely words,
and a document's score is a logistic function of sums of the marginals.

Labels are given for documents.  They become labels of words by the features
that toxic documents have and clean ones lack: such words of toxic documents are
tagged, all others are not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import map_arrow
from chatlens.llm.textbytes import pieces, text_bytes, word_bounds, word_hashes

#: Labelled documents of either label that the model is fitted on, at most, and their largest size in bytes.
SAMPLE, SAMPLE_BYTES = 1_500, 40_000
#: First letters (bytes) of a word that are features of it, and hashed features in all.
HEADS = (4, 5, 6)
SPACE = 1 << 18
ROUNDS, RATE, L2 = 30, 0.5, 1e-6
#: A feature may mark words if so many toxic documents have it, so large a share
#: of them, and so many times the share of the clean ones that have it.
LEAST_DOCUMENTS, LEAST_SHARE, LIFT = 3, 0.002, 50
#: Share of the toxic documents from which on such a feature marks words.
OFTEN = 0.1
SPAN_LIMIT = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words x features as numbers under SPACE, where words start and end, first word of each text and the end)."""
    starts, ends = word_bounds(data, offsets)
    found = word_hashes(data, starts, ends, *HEADS)
    salted = [(h ^ np.uint64(0xA5A5A5A5 * (k + 1))) % np.uint64(SPACE) for k, h in enumerate(found)]
    return np.stack(salted, axis=1).astype(np.int32), starts, ends, np.searchsorted(starts, offsets)


def _chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r where r[t] = (a[t] + b[t] r[t-1]) / (c[t] + d[t] r[t-1]), from r[-1] = 1.

    Such steps compose like 2 x 2 matrices.  The steps are cut into blocks:
    first the matrix of each block is made, for all blocks at once; a walk over
    the blocks gives the value at which each begins; then all blocks are walked
    at once.
    """
    n = len(a)
    if not n:
        return np.empty(0)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)

    def cut(x: np.ndarray, fill: float) -> np.ndarray:
        return np.concatenate([x, np.full(blocks * size - n, fill)]).reshape(blocks, size).T.copy()

    a, b, c, d = cut(a, 0.0), cut(b, 1.0), cut(c, 1.0), cut(d, 0.0)
    # Numerator and denominator of the composed steps, as p + q r and u + v r.
    p, q, u, v = np.zeros(blocks), np.ones(blocks), np.ones(blocks), np.zeros(blocks)
    for t in range(size):
        p, q, u, v = a[t] * u + b[t] * p, a[t] * v + b[t] * q, c[t] * u + d[t] * p, c[t] * v + d[t] * q
        top = np.maximum(np.maximum(p, q), np.maximum(u, v))
        p, q, u, v = p / top, q / top, u / top, v / top
    begin, r = np.empty(blocks), 1.0
    for k in range(blocks):
        begin[k] = r
        r = (p[k] + q[k] * r) / (u[k] + v[k] * r)
    out, r = np.empty((size, blocks)), begin
    for t in range(size):
        r = (a[t] + b[t] * r) / (c[t] + d[t] * r)
        out[t] = r
    return out.T.reshape(-1)[:n]


@dataclass
class Tagger:
    """Weights of features, of neighbouring tags (2 x 2), of the first tag, and of the document score."""

    weights: np.ndarray
    neighbours: np.ndarray
    first: float
    document: np.ndarray

    def emission(self, found: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[found].sum(axis=1) + self.document[3], -30, 30))

    def ratios(self, found: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By word: the emission, and the forward and backward messages, each as tag 1 over tag 0."""
        n = len(found)
        g, t = self.emission(found), np.exp(self.neighbours)
        heads = firsts[:-1][np.diff(firsts) > 0]
        a, b, c, d = g * t[0, 1], g * t[1, 1], np.full(n, t[0, 0]), np.full(n, t[1, 0])
        a[heads], b[heads], c[heads], d[heads] = g[heads] * np.exp(self.first), 0.0, 1.0, 0.0
        forward = _chain(a, b, c, d)
        # Backwards, each step takes in the emission of the word behind it; a last word starts anew.
        after = np.append(g[1:], 1.0)
        a, b, c, d = np.full(n, t[1, 0]), t[1, 1] * after, np.full(n, t[0, 0]), t[0, 1] * after
        tails = np.append(heads[1:], n)[: len(heads)] - 1
        a[tails], b[tails], c[tails], d[tails] = 1.0, 0.0, 1.0, 0.0
        backward = _chain(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]
        return g, forward, backward

    def marginals(self, found: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Probability of the toxic tag for each word."""
        _, forward, backward = self.ratios(found, firsts)
        joint = forward * backward
        return joint / (1 + joint)

    def summed(self, p: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """By text: the log odds of any toxic word, and the log of the expected number of them."""
        own = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        none = np.bincount(own, np.log1p(-np.clip(p, 0, 1 - 1e-12)), len(firsts) - 1)
        count = np.bincount(own, p, len(firsts) - 1)
        any_word = np.log(np.maximum(-np.expm1(none), 1e-12)) - none
        return np.stack([np.clip(any_word, -20, 20), np.log1p(count)], axis=1)

    def score(self, p: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        x = self.summed(p, firsts) @ self.document[:2] + self.document[2]
        return np.where(np.diff(firsts) > 0, 1 / (1 + np.exp(-x)), 0.0)


def _marked(found: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of words: those that bear a marking feature in a toxic text.

    Features are chosen greedily, each time the one in most of the toxic texts
    that no chosen one explains, out of those that clean texts all but lack.  So
    what merely stands beside an offence, as in copies of one text, is not chosen.
    Features in many toxic texts are chosen in any case.
    """
    pairs = np.unique(np.concatenate([text.astype(np.int64) * SPACE + column for column in found.T]))
    of, feature = pairs // SPACE, pairs % SPACE
    bad = toxic[of] == 1
    clean = np.bincount(feature[~bad], minlength=SPACE) / max(1, (toxic == 0).sum())
    of, feature = of[bad], feature[bad]
    many, n = np.bincount(feature, minlength=SPACE), (toxic == 1).sum()
    telling = (many >= max(LEAST_DOCUMENTS, LEAST_SHARE * n)) & (many / n >= LIFT * clean)
    of, feature = of[telling[feature]], feature[telling[feature]]
    chosen = (many >= OFTEN * n) & telling
    left = ~np.isin(of, of[chosen[feature]])
    of, feature = of[left], feature[left]
    while len(of):
        counts = np.bincount(feature, minlength=SPACE)
        best = int(counts.argmax())
        if counts[best] < max(LEAST_DOCUMENTS, LEAST_SHARE * n):
            break
        chosen[best] = True
        explained = np.zeros(len(toxic), bool)
        explained[of[feature == best]] = True
        left = ~explained[of]
        of, feature = of[left], feature[left]
    return chosen[found].any(axis=1) & (toxic[text] == 1)


def fit_texts(column: pa.Array, labels: np.ndarray) -> Tagger:
    """A tagger from texts and their labels; without toxic texts among them all scores are near 0."""
    tagger = Tagger(np.zeros(SPACE), np.zeros((2, 2)), -6.0, np.array([0.0, 0.0, -8.0, -6.0]))
    if not len(labels) or not (labels == 1).any():
        return tagger
    # Copies of one text count once.
    _, once = np.unique(np.array([zlib.crc32(t.encode()) << 1 | int(y) for t, y in zip(column.to_pylist(), labels)]), return_index=True)
    column, labels = column.take(pa.array(once)), labels[once]
    found, _, _, firsts = features(*text_bytes(column))
    text = np.repeat(np.arange(len(labels)), np.diff(firsts))
    tags = _marked(found, text, labels).astype(float)
    squares = {"weights": np.zeros(SPACE), "neighbours": np.zeros((2, 2))}
    heads = firsts[:-1][np.diff(firsts) > 0]
    inner = np.ones(len(text), bool)
    inner[heads] = False
    inner = np.flatnonzero(inner)
    was = (tags[inner - 1] * 2 + tags[inner]).astype(np.int64)
    counted = np.bincount(was, minlength=4).reshape(2, 2)
    for _ in range(ROUNDS):
        g, forward, backward = tagger.ratios(found, firsts)
        joint = forward * backward
        p = joint / (1 + joint)
        t = np.exp(tagger.neighbours)
        before, here = forward[inner - 1], g[inner] * backward[inner]
        pairs = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] * here, before * t[1, 0], before * t[1, 1] * here])
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2)
        slope = np.zeros(SPACE)
        for column_of in found.T:
            slope += np.bincount(column_of, tags - p, SPACE)
        slopes = {"weights": slope - L2 * tagger.weights, "neighbours": counted - expected}
        for name, own in slopes.items():
            squares[name] += own**2
            step = RATE * own / np.sqrt(squares[name] + 1e-9)
            setattr(tagger, name, np.clip(getattr(tagger, name) + step, -12, 12))
    # The document score: a logistic regression on two sums, by Newton's method.
    x = np.column_stack([tagger.summed(tagger.marginals(found, firsts), firsts), np.ones(len(labels))])
    w, y = np.zeros(3), (labels == 1).astype(float)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    tagger.document[:3] = w
    return tagger


def fit(documents: DataFrame, labels: DataFrame) -> Tagger:
    """A tagger from rows (doc_id, label) and the texts of those documents.

    Of each label the SAMPLE documents with the least hash of doc_id are taken,
    out of those of SAMPLE_BYTES at most.  Rows without an id or a label are
    left out; of an id's several labels the greatest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    small = documents.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
    picked = [known.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE) for which in ("label = 1", "label <> 1")]
    # At most 4 * SAMPLE rows of two numbers are sent to all executors.
    rows = small.join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id")
    held = [
        rows.where(which).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).select("text", "label").toArrow()
        for which in ("label = 1", "label <> 1")
    ]
    both = pa.concat_tables(held).combine_chunks()
    texts = both.column("text").combine_chunks() if both.num_rows else pa.array([], pa.string())
    return fit_texts(texts, (both.column("label").to_numpy() == 1).astype(int))


def tag(documents: DataFrame, tagger: Tagger, columns: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and spans (begin, end, score) to ``columns`` (all by default).

    begin and end are offsets in code points, a span is a run of neighbouring
    words with a marginal of SPAN_LIMIT or more, and its score is the greatest
    of these.  A text without words, null ones among them, has score 0 and no
    spans.  Repeated rows stay; columns named score or spans are replaced.
    """
    names = [c for c in (columns or documents.columns) if c not in ("score", "spans")]
    # A text that is among the columns is sent once.
    words, more = ("text", []) if "text" in names else ("__text", [F.col("text").alias("__text")])
    source = documents.select(*names, *more)
    of_name = {f.name: f for f in source.schema.fields}
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = ", ".join(
        [*[f"`{c}` {of_name[c].dataType.simpleString()}" for c in names], "score double", "spans array<struct<begin:bigint,end:bigint,score:double>>"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, words):
            data, offsets = text_bytes(batch.column(words))
            found, starts, ends, firsts = features(data, offsets)
            p = tagger.marginals(found, firsts)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            likely = np.flatnonzero(p >= SPAN_LIMIT)
            if len(likely):
                text = np.searchsorted(firsts, likely, "right") - 1
                opens = np.flatnonzero(np.append(True, (np.diff(likely) > 1) | (np.diff(text) > 0)))
                closes = np.append(opens[1:], len(likely))
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                for a, b in zip(opens, closes):
                    i, base = text[a], points[offsets[text[a]]]
                    spans[i].append(
                        {
                            "begin": int(points[starts[likely[a]]] - base),
                            "end": int(points[ends[likely[b - 1]]] - base),
                            "score": float(p[likely[a:b]].max()),
                        }
                    )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(tagger.score(p, firsts), pa.float64()), pa.array(spans, pa.list_(span))],
                names=[*names, "score", "spans"],
            )

    return map_arrow(source, run, schema)
