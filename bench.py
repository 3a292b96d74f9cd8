"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the folder of tables, BENCH_CPUS the local cores.  Each
query runs once to warm up, then three times; the median counts.  Results go
to the noop sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chatlens.operators import insights, tokens  # noqa: E402
from chatlens.session import local_session  # noqa: E402
from checks.queries import AS_OF, Tables  # noqa: E402
from chatlens.operators import summaries  # noqa: E402

RUNS = 3


def headline(spark, folder):
    """Query name -> function that builds its frame."""
    chats = Tables(spark, folder, "conversations")
    texts = Tables(spark, folder, "documents", partitions=spark.sparkContext.defaultParallelism)
    events = Tables(spark, folder, "events")

    def favourites():
        daily = events.shown("daily_summary_contact")
        best = insights.favourite_contacts(daily, events["contact_group_chat_map"], 10)
        return insights.cumulative_volume(daily, best, "Week")

    return {
        "message_table": lambda: chats["message_user"],
        "tokens_with_stopwords": lambda: texts["message_tokens_unnest"],
        "token_usage_daily": lambda: texts["contact_token_usage_daily_from_who"],
        "token_usage_contact": lambda: texts["contact_token_usage"],
        "token_dictionary": lambda: tokens.token_dictionary(
            texts["message_tokens_unnest"], texts["stopwords"], texts["emoji_text_map"]
        ),
        "emoji_map": lambda: texts["message_emoji_map"],
        "word_frequency": lambda: tokens.word_frequency(
            texts["contact_token_usage_from_who"], texts["stopwords"], limit=tokens.WORD_CLOUD_SIZE
        ),
        "daily_facts": lambda: events["daily_summary_contact_from_who"],
        "daily_rollup": lambda: events["daily_summary"],
        "all_rollups": lambda: summaries.rollup_summary(events["daily_summary_contact_from_who"]),
        "contact_lifetime": lambda: events["summary_contact"],
        "contact_stats": lambda: summaries.contact_stats(events["daily_facts"], AS_OF),
        "day_ranks": lambda: events["contact_daily_message_volume"],
        "top_contacts": lambda: events["message_count_top_contacts"],
        "weekly_volume": lambda: insights.message_volume(events.shown("daily_summary"), "Week"),
        "cumulative_favourites": favourites,
        "tapbacks": lambda: insights.tapbacks(events["message_user"]),
    }


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, **{"spark.sql.shuffle.partitions": cores.replace("*", "8")})
    seconds = {}
    for name, build in headline(spark, folder).items():
        df = build()
        run(df)
        seconds[name] = round(statistics.median(run(df) for _ in range(RUNS)), 4)
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_median_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
