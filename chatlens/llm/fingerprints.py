"""Document fingerprints by winnowing word k-grams.

Of every WINDOW consecutive k-gram hashes the least is kept, the rightmost of
equal ones, together with its position.  Any two texts that share a passage of
GRAM + WINDOW - 1 words have a kept hash of that passage in common.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chatlens.llm.common import words_of

GRAM = 5
WINDOW = 8
#: Documents that meet in one bucket when neighbours are looked up, about.
BUCKET = 1000
#: Quantiles of the ids that buckets are laid along.
PIECES = 128
_BORDER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Of a text read backwards: the word at its end, which may go on behind it, and GRAM - 1 words more.
LAST_WORDS = rf"\A[^{_BORDER}]*+(?:[{_BORDER}]++[^{_BORDER}]++){{0,{GRAM - 1}}}"


def _rolling(words: Column) -> Column:
    """32-bit hashes of the k-grams of k words or more."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - GRAM),
        lambda i: F.hash(*[F.get(words, i + j) for j in range(GRAM)]),
    )


def _grams(words: Column) -> Column:
    """32-bit hashes of the k-grams; fewer than k words are one gram, no words none."""
    few = F.when(F.size(words) > 0, F.array(F.hash(F.array_join(words, " ")))).otherwise(_none())
    return F.when(F.size(words) >= GRAM, _rolling(words)).otherwise(few)


def _none() -> Column:
    return F.expr("CAST(array() AS array<int>)")


def _least(grams: Column, start: Column) -> Column:
    """Positions of the rightmost least hashes of the windows that begin at ``start`` or later; grams that fill no window are one."""

    def least_at(i: Column) -> Column:
        own = [F.get(grams, i + j) for j in range(WINDOW)]
        value = F.least(*own)
        # Equality is tried from the right, so that the rightmost wins.
        return reduce(
            lambda rest, j: F.when(own[j] == value, i + j).otherwise(rest), range(1, WINDOW), i
        )

    full = F.array_distinct(F.transform(F.sequence(start, F.size(grams) - WINDOW), least_at))
    last = F.size(grams) - F.array_position(F.reverse(grams), F.array_min(grams))
    short = F.when(F.size(grams) > 0, F.array(last.cast("int"))).otherwise(_none())
    return F.when(F.size(grams) >= WINDOW, full).otherwise(short)


def _picked(least: str, grams: str) -> Column:
    return F.transform(least, lambda at: F.struct(at.alias("at"), F.get(F.col(grams), at).alias("gram")))


def with_fingerprint(rows: DataFrame, text: str, name: str, keep: bool = False) -> DataFrame:
    """Adds ``name``: array of (at, gram), the winnowed k-grams of a text in order of position.

    Null and empty texts, and texts without words, have an empty one; a text of
    fewer than WINDOW k-grams has the least of all.  With ``keep`` all the
    grams and the number of words stay, as <name>_grams and <name>_n_words.
    """
    words, n_words, grams, least = f"{name}_words", f"{name}_n_words", f"{name}_grams", f"{name}_least"
    rows = rows.withColumn(words, words_of(F.col(text)))
    rows = rows.withColumns({grams: _grams(F.col(words)), n_words: F.size(words)}).drop(words)
    rows = rows.withColumn(least, _least(F.col(grams), F.lit(0)))
    return rows.withColumn(name, _picked(least, grams)).drop(least, *(() if keep else (grams, n_words)))


def _with_edited_fingerprint(rows: DataFrame, stays: Column, end: Column) -> DataFrame:
    """Adds edited_fingerprint, of the first ``stays`` characters of ``text`` with ``end`` behind them.

    It equals that of with_fingerprint, which must have been called for ``text``
    with its grams kept.  The tail, from the last GRAM - 1 whole words that stay
    on, is all that is taken apart: grams that begin before it, and what is
    least in windows of such grams alone, are those of the text itself.
    """
    backwards = F.reverse(F.substr("text", F.lit(1), stays))
    rows = rows.withColumn("begin", stays - F.length(F.regexp_extract(backwards, LAST_WORDS, 0)))
    tail = F.concat(F.substr("text", F.col("begin") + 1, stays - F.col("begin")), end)
    gone = F.size(words_of(F.substr("text", F.col("begin") + 1, F.length("text"))))
    rows = rows.withColumns({"tail": words_of(tail), "same": F.col("fingerprint_n_words") - gone})
    beyond = F.when(F.size("tail") >= GRAM, _rolling(F.col("tail"))).otherwise(_none())
    grams = F.when(F.col("same") == 0, _grams(F.col("tail"))).otherwise(
        F.concat(F.slice("fingerprint_grams", F.lit(1), F.col("same")), beyond)
    )
    rows = rows.withColumn("grams", grams)
    # Later positions are least in a window that begins less than twice its length before the tail.
    known = F.filter("fingerprint.at", lambda at: at <= F.col("same") - WINDOW)
    found = _least(F.col("grams"), F.greatest(F.col("same") - 2 * (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn("least", F.array_distinct(F.concat(known, found)))
    return rows.withColumn("edited_fingerprint", _picked("least", "grams")).drop("begin", "tail", "same", "grams", "least")


def as_text(fingerprint: str) -> Column:
    """A fingerprint as 'position:hash' in hexadecimal, with blanks between."""
    return F.array_join(
        F.transform(fingerprint, lambda f: F.concat(F.hex(f["at"]), F.lit(":"), F.hex(f["gram"].bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))))), " "
    )


def likeness(one: str, other: str) -> Column:
    """Jaccard index of the hashes of two fingerprints; 1 for two empty ones."""
    a, b = F.array_distinct(F.col(f"{one}.gram")), F.array_distinct(F.col(f"{other}.gram"))
    common = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def _buckets(documents: DataFrame) -> Column:
    """A bucket number that grows with doc_id and holds about BUCKET documents.

    PIECES quantiles of the ids, a bounded list, follow their density; between
    two of them buckets are equally wide.  Rows without an id come first.
    """
    steps = [i / PIECES for i in range(PIECES)]
    found = documents.select(
        F.count("*").alias("n"), F.max("doc_id").alias("top"), F.percentile_approx("doc_id", steps, 10_000).alias("cuts")
    ).first()
    cuts = sorted(set(found.cuts or [0]))
    each = max(1, found.n // len(cuts) // BUCKET)
    ends = [*cuts[1:], (found.top or 0) + 1]
    widths = [max(1, -(-(end - start) // each)) for start, end in zip(cuts, ends, strict=True)]
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    piece = F.greatest(F.size(F.filter(longs(cuts), lambda c: c <= F.col("doc_id"))), F.lit(1))
    within = F.call_function("div", F.col("doc_id") - F.get(longs(cuts), piece - 1), F.get(longs(widths), piece - 1))
    return F.coalesce(piece.cast("bigint") * F.lit(1 << 40) + F.greatest(within, F.lit(-1)), F.lit(-1).cast("bigint"))


def with_next(documents: DataFrame, prepare=lambda rows: rows, carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """Rows (doc_id, text) with next_<column>: what the next document, by doc_id, has; the first follows the last.

    Equal ids are ordered by their text.  Texts cross the network once, by
    bucket.  The first document of each bucket also comes to the end of the
    bucket before, as a guest, so no bucket has to look into another.
    ``prepare`` adds columns to the bucketed rows, which ``carry`` may name.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _buckets(documents))
    first = rows.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", F.xxhash64("text"), "text")).alias("first"))
    # Buckets in order: within a piece by a window, between the pieces (a bounded list) by another.
    order = first.select("bucket", F.shiftright("bucket", 40).alias("piece"))
    heads = order.groupBy("piece").agg(F.min("bucket").alias("head"))
    by_piece = Window.orderBy("piece")
    everything = by_piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "piece", F.coalesce(F.lead("head").over(by_piece), F.first("head").over(everything)).alias("after")
    )
    following = F.lead("bucket").over(Window.partitionBy("piece").orderBy("bucket"))
    links = order.withColumn("following", following).join(heads, "piece")
    links = links.select(F.col("bucket").alias("host"), F.coalesce("following", "after").alias("bucket"))
    guests = first.join(links, "bucket").select("first.doc_id", "first.text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    met = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")
    met = prepare(met)
    in_order = Window.partitionBy("bucket").orderBy("guest", "doc_id", F.xxhash64("text"), "text")
    nexts = {f"next_{c}": F.lead(c).over(in_order) for c in carry}
    return met.withColumns(nexts).where(~F.col("guest")).drop("bucket", "guest")


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    The edited text has its last quarter of code points replaced by as many of
    the next document's first ones, or all it has.  Gives doc_id, n_chars,
    edited, fingerprint and edited_fingerprint (arrays), near_edited and
    near_next.  A null text is an empty one; other columns are left out;
    repeated rows stay; an only document is its own next.
    """
    rows = with_next(
        documents, lambda met: with_fingerprint(met, "text", "fingerprint", keep=True), ("text", "fingerprint")
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.call_function("div", F.col("n_chars"), F.lit(4)).cast("int")
    rows = rows.withColumns({"stays": F.col("n_chars").cast("int") - quarter, "end": F.substr("next_text", F.lit(1), quarter)})
    rows = _with_edited_fingerprint(rows, F.col("stays"), F.col("end"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.concat(F.substr("text", F.lit(1), "stays"), "end").alias("edited"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
