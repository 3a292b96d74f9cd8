"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item; a shorter item is one
window as a whole.  Documents and windows are both cut into word k-grams, of
which the least hash in every span of WINDOW words is kept (all of equal ones).
A document that holds a whole window has kept that window's least k-gram too, so
the join of both sets of fingerprints finds every such place.  Hits are then
extended: each place where a window could start is compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import computed_once, cut, words_of

WINDOW = 10
GRAM = 5
#: Benchmark fingerprints up to this number of rows (about 24 bytes each) are
#: sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _gram_hashes(words: str, k: int) -> Column:
    """Hash of the k words from each position on; none for fewer words."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])
    )
    return F.when(F.size(words) >= k, hashed).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def _least(hashes: str, span: int) -> Column:
    """The least of the ``span`` hashes from each position on."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - span),
        lambda i: F.least(*[F.get(F.col(hashes), i + j) for j in range(span)]),
    )


def _winnowed(rows: DataFrame, k: int, window: int) -> DataFrame:
    """Rows (key, gram, at) from rows (key, words): k-grams that are least in some full window of words over them."""
    span = window - k + 1
    hashed = rows.where(F.size("words") >= window).select("key", _gram_hashes("words", k).alias("hashes"))
    if span == 1:
        return hashed.select("key", F.posexplode("hashes").alias("at", "gram"))
    least = hashed.select("key", "hashes", _least("hashes", span).alias("least"))
    # Window i holds the hashes i to i + span - 1, so hash x lies in the windows x - span + 1 to x.
    over = [lambda h, x, j=j: F.coalesce(F.get(F.col("least"), x - j) == h, F.lit(False)) for j in range(span)]
    kept = F.transform(
        "hashes",
        lambda h, x: F.when(reduce(lambda a, b: a | b, [is_least(h, x) for is_least in over]), F.struct(h.alias("gram"), x.alias("at"))),
    )
    return least.select("key", F.explode(F.array_compact(kept)).alias("f")).select("key", "f.gram", "f.at")


def _joined(start: Column, size: Column) -> Column:
    """``size`` of the array ``words`` from ``start`` on, with blanks between; slice() would copy the whole array."""
    return F.concat_ws(" ", *[F.when(size > j, F.get(F.col("words"), start + j)) for j in range(WINDOW)])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct rows (window, size, item_id): the windows of each item as their words with blanks between."""
    words = benchmark.select("item_id", computed_once(words_of(F.col("text"))).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - size))
    return (
        words.select("item_id", "words", size.alias("size"), starts.alias("start"))
        .select(_joined(F.col("start"), F.col("size")).alias("window"), "size", "item_id")
        .distinct()
    )


def _window_grams(windows: DataFrame, size: int, k: int) -> DataFrame:
    """Distinct rows (gram, off): the least k-grams of the windows of one size, and where in them they stand."""
    own = windows.where(F.col("size") == size).select(F.split("window", " ").alias("words")).distinct()
    rows = own.select("words", _gram_hashes("words", k).alias("hashes"))
    least = rows.select(F.posexplode("hashes").alias("off", "gram"), F.array_min("hashes").alias("least"))
    return least.where("gram = least").select("gram", "off").distinct()


def find_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per row of ``documents``: doc_id, text_key, n_words, n_hit, items and n_items.

    n_hit counts words inside any occurrence of a benchmark window, items holds
    the sorted ids of the items that such windows come from.  text_key is the
    MD5 of the text: equal texts share all work behind the first fingerprints.
    Null and empty texts have no words and no hits; items without words have no
    windows; repeated rows keep a row each; an empty table on either side gives
    no hits.  Other columns are left out, so their names cannot clash.
    """
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", F.md5(text).alias("key"), "text")
    windows = cut(benchmark_windows(benchmark))
    sizes = sorted(row.size for row in windows.select("size").distinct().collect())  # at most WINDOW values
    words = texts.select("key", computed_once(words_of(F.col("text"))).alias("words"))
    starts = texts.select("key", F.lit(0).alias("start"), F.lit(0).alias("size")).limit(0)
    for k, own in ((GRAM, [WINDOW]), (2, range(2, WINDOW)), (1, [1])):
        if not (own := [size for size in own if size in sizes]):
            continue
        grams = reduce(
            DataFrame.unionAll, [_window_grams(windows, n, k).withColumn("size", F.lit(n)) for n in own]
        )
        grams = cut(grams)
        if grams.count() <= BROADCAST_ROWS:
            grams = F.broadcast(grams)
        found = _winnowed(words, k, WINDOW if k == GRAM else k)
        starts = starts.unionAll(
            found.join(grams, "gram").select("key", (F.col("at") - F.col("off")).alias("start"), "size")
        )
    # Distinct starts of one text: no more than its words, times the sizes of short items.
    starts = starts.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("starts"))
    places = F.transform(
        F.filter("starts", lambda s: (s["start"] >= 0) & (s["start"] + s["size"] <= F.size("words"))),
        lambda s: F.struct(s["start"].alias("start"), _joined(s["start"], s["size"]).alias("window")),
    )
    rows = cut(
        texts.join(starts, "key", "left")
        .select("doc_id", "key", computed_once(words_of(F.col("text"))).alias("words"), "starts")
        .select("doc_id", "key", F.size("words").cast("bigint").alias("n_words"), places.alias("places"))
    )
    hits = (
        rows.select("key", F.explode("places").alias("p"))
        .select("key", "p.start", "p.window")
        .distinct()
        .join(windows.select("window", "size").distinct(), "window")
    )
    # The words of all hits of one text, each once.
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word")
    n_hit = hits.select("key", covered).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    items = (
        hits.select("key", "window")
        .distinct()
        .join(windows.select("window", "item_id"), "window")
        .select("key", F.col("item_id").cast("string").alias("item"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    none = F.expr("CAST(array() AS array<string>)")
    return (
        rows.select("doc_id", "key", "n_words")
        .join(n_hit.join(items, "key"), "key", "left")
        .select(
            "doc_id",
            F.col("key").alias("text_key"),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", none).alias("items"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        )
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, whose text holds no benchmark window."""
    found = find_contamination(documents, benchmark).where("n_hit > 0")
    found = found.select(F.col("text_key").alias("__text_key")).distinct()
    return documents.join(found, F.md5(F.coalesce("text", F.lit(""))) == F.col("__text_key"), "left_anti")
