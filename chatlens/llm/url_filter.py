"""URL filter: host and path rules first, then a ratio of two character language models.

Accepted and rejected URLs each train a variable-order Markov model over the
characters of host and path.  A URL that no rule decides is scored by the mean,
per character, of log P(c | accepted) - log P(c | rejected), and blocked when
that lies under a threshold calibrated on URLs held back from training.

All counting and scoring are joins, windows and aggregates, so the models may
grow with the corpus; nothing is collected but the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import cut

#: Longest context in characters.
ORDER = 4
#: Weight of the shorter context's estimate, in pseudo counts.
BACKOFF = 2.0
#: Characters a URL may hold, for the estimate below the shortest context.
ALPHABET = 128
#: One labelled URL in so many calibrates the threshold and trains nothing.
HELD_BACK = 4
#: Steps of the scale on which thresholds are tried.
SCALE = 100


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and a path prefix, as 'host/path', allowed or blocked."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What stands after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def url_path(url: Column) -> Column:
    """What stands after the host up to '?', '#' or the end; '' for null or no '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; of equally long ones the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _not_broadcast(frame: DataFrame) -> DataFrame:
    """The frame for a sort-merge join of both sides.

    Spark takes a cut() table for as large as its compressed files, and what
    explode() makes of a row for one row, so it would broadcast tables of
    which the driver can't hold the rows.
    """
    return frame.hint("merge")


def _grams(urls: DataFrame) -> DataFrame:
    """A row per character of a URL: the character behind the ORDER before it, as one string.

    URLs are padded in front, so that first characters have contexts, and
    closed by an end mark.
    """
    padded = F.concat(F.lit("\x02" * ORDER), "host", "path", F.lit("\x03")).alias("padded")
    starts = F.explode(F.sequence(F.lit(1), F.length("padded") - ORDER)).alias("start")
    return (
        urls.select("*", padded)
        .select("*", starts)
        .withColumn("gram", F.substr("padded", F.col("start"), F.lit(ORDER + 1)))
        .drop("padded", "start")
    )


def _contexts(grams: DataFrame) -> DataFrame:
    """Each gram once for every length of context: order, ctx and ch."""
    orders = grams.select("*", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order"))
    context = F.substr("gram", F.lit(ORDER + 1) - F.col("order"), F.col("order"))
    return orders.withColumn("ctx", context).withColumn("ch", F.right("gram", F.lit(1)))


def train(labelled: DataFrame) -> DataFrame:
    """Counts of both models from rows (host, path, accepted, n): n copies of each URL.

    A row per context (order, ctx) and character: yes and no, how often it
    followed among accepted and among rejected URLs, and yes_all and no_all,
    how often the context was seen.
    """
    whole = _grams(labelled).groupBy("gram").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no"),
    )
    seen = _contexts(whole).groupBy("order", "ctx", "ch").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    context = Window.partitionBy("order", "ctx")  # as many rows as there are characters, at most
    return seen.select("*", F.sum("yes").over(context).alias("yes_all"), F.sum("no").over(context).alias("no_all"))


def _estimate(count: str, total: str) -> Column:
    """P(character) in one model: each longer context weighed against the estimate of the shorter one."""
    return F.aggregate(
        "levels",
        F.lit(1.0 / ALPHABET),
        lambda below, level: (level[count] + BACKOFF * below) / (level[total] + BACKOFF),
    )


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (host, path) with score: the mean over their characters of the log ratio of both models."""
    grams = _grams(urls.select("host", "path"))
    totals = model.select("order", "ctx", "yes_all", "no_all").distinct()
    zero = F.lit(0).cast("bigint")
    level = F.struct("order", *[F.coalesce(c, zero).cast("double").alias(c) for c in ("yes", "no", "yes_all", "no_all")])
    ratios = (
        _contexts(grams.select("gram").distinct())
        .join(_not_broadcast(model.select("order", "ctx", "ch", "yes", "no")), ["order", "ctx", "ch"], "left")
        .join(_not_broadcast(totals), ["order", "ctx"], "left")
        .groupBy("gram")
        .agg(F.sort_array(F.collect_list(level)).alias("levels"))
        .select("gram", (F.log(_estimate("yes", "yes_all")) - F.log(_estimate("no", "no_all"))).alias("ratio"))
    )
    # Rounded sums do not depend on the order in which rows arrive.
    mean = F.round(F.sum(F.round("ratio", 9).cast("decimal(28,9)")).cast("double") / F.count("*"), 6)
    return grams.join(_not_broadcast(ratios), "gram").groupBy("host", "path").agg(mean.alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on rows (score, accepted, n); the one nearest 0 of equals.

    0 where either kind is missing.  Only counts per step of the scale, which is
    bounded, reach the driver.
    """
    step = F.least(F.greatest(F.floor(F.col("score") * SCALE), F.lit(-10 * SCALE)), F.lit(10 * SCALE))
    bins = (
        scored.groupBy(step.alias("step"))
        .agg(
            F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"),
            F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no"),
        )
        .orderBy("step")
        .collect()
    )
    yes_all, no_all = sum(b.yes for b in bins), sum(b.no for b in bins)
    if not yes_all or not no_all:
        return 0.0
    best, at, yes_below, no_below = -1.0, 0, 0, 0
    for b in [*bins, None]:
        edge = b.step if b else bins[-1].step + 1
        good = no_below / no_all + (yes_all - yes_below) / yes_all
        if good > best or (good == best and abs(edge) < abs(at)):
            best, at = good, edge
        if b:
            yes_below, no_below = yes_below + b.yes, no_below + b.no
    return at / SCALE


def judge(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """The rows of ``urls`` with host, path, rule, verdict ('allow' or 'block') and score.

    The URLs that a rule decides train the models, with the rule's verdict as
    their label; score is null for them.  A null or broken URL has an empty
    host and path, which fit no rule, and is scored like any other.  Without
    any training URLs all scores are 0, and 0 is allowed.  Columns named like
    the added ones are replaced; repeated rows are kept.
    """
    added = ("host", "path", "rule", "verdict", "score")
    judged = (
        urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
        .withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
        .withColumns({"rule": F.col("found.rule"), "verdict": F.col("found.verdict")})
        .drop("found")
    )
    distinct = cut(judged.groupBy("host", "path", "rule", "verdict").agg(F.count("*").alias("n")))
    labelled = distinct.where("rule IS NOT NULL").select("host", "path", (F.col("verdict") == "allow").alias("accepted"), "n")
    held_back = F.pmod(F.xxhash64("host", "path"), F.lit(HELD_BACK)) == 0
    model = cut(train(labelled.where(~held_back)))
    checked = labelled.where(held_back)
    threshold = calibrate(checked.join(_not_broadcast(score(checked, model)), ["host", "path"]))
    scores = score(distinct.where("rule IS NULL"), model)
    by_model = F.when(F.coalesce("score", F.lit(0.0)) < threshold, "block").otherwise("allow")
    rest = [c for c in urls.columns if c not in added]
    return judged.join(scores, ["host", "path"], "left").select(
        *rest, "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "score"
    )
