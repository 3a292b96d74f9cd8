"""Sources, sinks, the address book and the full refresh."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatlens.operators import contacts, insights, quality, summaries
from chatlens.operators.display import for_display
from chatlens.plans.tables import TableSet, refresh_tables, register_views
from chatlens.schemas import ADDRESS_BOOK_SCHEMAS, DIMENSION_SCHEMAS, MEASURES, SOURCE_TABLES, STATIC_SCHEMAS
from chatlens.sources import dimensions, sinks, tables
from checks.bindings import Bound
from checks.queries import Tables

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_read_source(spark, tmp_path):
    raw = Bound(spark, SMALL).raw_tables()
    raw["message"].withColumn("attributedBody", F.lit(b"x")).write.parquet(f"{tmp_path}/message")
    message = tables.read_source(spark, "message", f"{tmp_path}/message")
    assert "attributedBody" not in message.columns
    assert message.count() == raw["message"].count()
    with pytest.raises(ValueError):
        tables.read_source(spark, "notes", str(tmp_path))


def test_check_catalog(spark):
    present = [name for name in SOURCE_TABLES if name != "chat"] + ["surprise"]
    assert rows(tables.check_catalog(spark, present)) == [("chat", "missing"), ("surprise", "unaccounted for")]


def test_static_csv(spark, tmp_path):
    good = tmp_path / "contacts_manual.csv"
    good.write_text('contact_name,chat_identifier\n"Ann ""A"" B",+1\n,+2\n')
    assert rows(tables.read_static_csv(spark, "contacts_manual", str(good)).na.fill("-")) == [
        ("+1", 'Ann "A" B'),
        ("+2", "-"),
    ]
    for header in ("chat_identifier", "chat_identifier,contact_name,extra"):
        bad = tmp_path / f"bad{len(header)}.csv"
        bad.write_text(header + "\n")
        with pytest.raises(ValueError):
            tables.read_static_csv(spark, "contacts_manual", str(bad))
    absent = tables.read_static_csv(spark, "contacts_ignored", str(tmp_path / "none.csv"))
    assert absent.schema == STATIC_SCHEMAS["contacts_ignored"]
    assert absent.isEmpty()


def test_dimensions(spark):
    stops = dimensions.stopword_dim(spark)
    assert stops.columns == ["stopword"]
    assert stops.distinct().count() == len(dimensions.STOPWORDS) == 179
    emoji = dimensions.emoji_dim(spark)
    assert emoji.count() == emoji.select("emoji").distinct().count()
    found = {row.emoji: row.plain_text for row in emoji.where(F.col("emoji").isin("👍", "👍🏽", "❤️", "🇫🇷")).collect()}
    assert found["👍"] == ":thumbs_up_sign:" and set(found) == {"👍", "👍🏽", "❤️", "🇫🇷"}
    own = spark.createDataFrame([("x",)], DIMENSION_SCHEMAS["stopwords"])
    assert rows(dimensions.stopword_dim(spark, own)) == [("x",)]
    with pytest.raises(ValueError):
        dimensions.emoji_dim(spark, own)


def test_append_new_rows(spark, tmp_path):
    path = f"{tmp_path}/dictionary"
    frame = lambda *words: spark.createDataFrame([(w, len(w)) for w in words], "token string, length int")
    sinks.append_new_rows(frame("a", "bb"), path, ["token"])
    sinks.append_new_rows(frame("bb", "ccc"), path, ["token"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("bb", 2), ("ccc", 3)]


def test_materialise_and_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), "x"), (2, None, 'a "b"'), (3, dt.date(2024, 1, 2), None)], "id int, dt date, t string"
    )
    for _ in range(2):
        back = sinks.materialise(df, f"{tmp_path}/t", "dt")
    assert back.columns == df.columns and back.dtypes == df.dtypes
    assert sorted(back.collect(), key=lambda r: r.id) == df.collect()
    sinks.write_csv(df.select("id", "t"), f"{tmp_path}/csv")
    again = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"', nullValue=sinks.CSV_NULL, schema="id int, t string")
    assert sorted(again.collect()) == sorted(df.select("id", "t").collect())


def test_refreshing_twice_keeps_what_readers_hold(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    first = sinks.materialise(df, f"{tmp_path}/t")
    second = sinks.materialise(first.where("id = 2"), f"{tmp_path}/t")
    assert rows(first) == [(1, "a"), (2, "b")] and rows(second) == [(2, "b")]
    assert rows(sinks.read_current(spark, f"{tmp_path}/t", df.schema)) == [(2, "b")]


def test_csv_values_come_back(spark, tmp_path):
    values = [" padded ", "", None, 'a "b"', "two\nlines", "a,b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    options = {"header": True, "escape": '"', "multiLine": True, "nullValue": sinks.CSV_NULL, "schema": "id int, t string"}
    back = spark.read.csv(f"{tmp_path}/csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options)
    assert [r.t for r in back.orderBy("id").collect()] == values
    notes = tmp_path / "ignored.csv"
    notes.write_text('chat_identifier,notes\nx,"two\nlines"\n')
    assert rows(tables.read_static_csv(spark, "contacts_ignored", str(notes))) == [("x", "two\nlines")]


def test_appending_repeats_and_null_keys(spark, tmp_path):
    path = f"{tmp_path}/keys"
    frame = lambda *words: spark.createDataFrame([(w,) for w in words], "token string")
    sinks.append_new_rows(frame("a", "a", None, None), path, ["token"])
    sinks.append_new_rows(frame("a", None, "b", "b"), path, ["token"])
    assert sorted(str(r.token) for r in spark.read.parquet(path).collect()) == ["None", "a", "b"]


def test_text_is_cleaned_once_under_filters(spark):
    chats = Tables(spark, SMALL, "conversations")
    one = chats["message_user"]._jdf.queryExecution().optimizedPlan().toString().count("replace(")
    for name in ("message_user_text", "qc_message_special_types", "qc_missing_contact_names"):
        plan = chats[name]._jdf.queryExecution().optimizedPlan().toString()
        uses = max(1, plan.count("Generate inline"))
        assert plan.count("replace(") <= one * uses + 4, name


def test_extract_datasets(spark, tmp_path):
    source = spark.createDataFrame([("2024-01-02", "2024-01-02 03:04:05", 1)], "dt string, ts string, n int")
    out = f"{tmp_path}/extract"
    first = sinks.extract_datasets(spark, {"daily": source}, out, ["daily"])
    assert first["daily"].dtypes == [("dt", "date"), ("ts", "timestamp_ntz"), ("n", "int")]
    changed = {"daily": source.withColumn("n", F.lit(2))}
    assert sinks.extract_datasets(spark, changed, out, ["daily"])["daily"].first().n == 1
    assert sinks.extract_datasets(spark, changed, out, ["daily"], refresh=True)["daily"].first().n == 2


def test_unfinished_snapshot_is_rebuilt(spark, tmp_path):
    out = f"{tmp_path}/extract"
    one = spark.createDataFrame([(1,)], "n int")
    one.write.parquet(f"{out}/daily")
    assert sinks.extract_datasets(spark, {"daily": one.withColumn("n", F.lit(5))}, out, ["daily"])["daily"].first().n == 5


def book(spark, people, phones, emails):
    return {
        "person": spark.createDataFrame(people, ADDRESS_BOOK_SCHEMAS["person"]),
        "email": spark.createDataFrame(emails, ADDRESS_BOOK_SCHEMAS["email"]),
        "phone": spark.createDataFrame(phones, ADDRESS_BOOK_SCHEMAS["phone"]),
    }


def test_contact_map(spark):
    one = book(
        spark,
        [(1, "Ann", "Lee"), (2, "Ann", "Lee"), (3, None, "Bo"), (4, "Error", None), (5, "No", "Details")],
        [(1, "4155552671"), (1, None), (3, "911"), (4, "912")],
        [(2, "b@x"), (2, "a@x"), (3, None)],
    )
    two = book(spark, [(7, "Ann", "Lee")], [(7, "415 555 2671")], [(7, "c@x;d@x")])
    compact = contacts.address_book(**one)
    assert rows(compact.na.fill("-")) == [
        ("", "Bo", "", "911"),
        ("Ann", "Lee", "a@x;b@x", ";4155552671"),
        ("Error", "", "-", "912"),
    ]
    everyone = contacts.all_address_books([compact, compact, contacts.address_book(**two)])
    assert everyone.count() == 4
    assert contacts.contact_load_counts(everyone).first().asDict() == {"n_names": 3, "n_kept": 3, "n_ignored": 1}
    mapped = contacts.contact_map(contacts.all_address_books([contacts.identifiers(**each) for each in (one, one, two)]))
    assert rows(mapped) == [
        ("Ann Lee", "(415) 555-2671", "phone"),
        ("Ann Lee", "+1 415-555-2671", "phone"),
        ("Ann Lee", "+14155552671", "phone"),
        ("Ann Lee", "a@x", "email"),
        ("Ann Lee", "b@x", "email"),
        ("Ann Lee", "c@x", "email"),
        ("Ann Lee", "d@x", "email"),
        ("Bo", "911", "phone"),
    ]


def test_refresh_equals_lazy_tables(spark, tmp_path):
    lazy = TableSet(spark, Bound(spark, SMALL).raw_tables(), dt.date(2024, 3, 31))
    written = refresh_tables(lazy, f"{tmp_path}/tables")
    for name in ("message_user", "summary_contact", "contact_token_usage", "daily_summary", "qc_null_flags"):
        assert written[name].columns == lazy[name].columns
        assert [str(row) for row in rows(written[name].na.fill("-"))] == [
            str(row) for row in rows(lazy[name].na.fill("-"))
        ]
    register_views(written)
    assert spark.sql("SELECT count(*) FROM message_user").first()[0] == written["message_user"].count()
    assert spark.sql("SELECT max(messages) FROM summary_vw").first()[0] == written["message_user"].count()
    assert not spark.catalog.tableExists("message_user_vw")
    ordered = [row.message_id for row in for_display("message_user", written["message_user"]).collect()]
    assert ordered == sorted(ordered, reverse=True)


def test_a_day_range_prunes_files(spark, tmp_path):
    lazy = TableSet(spark, Bound(spark, SMALL).raw_tables())
    stored = sinks.materialise(lazy["message_user"], f"{tmp_path}/m", "dt")
    chosen = insights.in_range(stored, dt.date(2024, 1, 2), dt.date(2024, 1, 2), "Contact 5").select("message_id")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(contact_name)" in plan
    assert "text" not in plan.split("ReadSchema: ")[1]


def test_null_keys(spark):
    tables_ = Tables(spark, SMALL, "events")
    daily = tables_["daily_summary_contact_from_who"]
    assert daily.where("contact_name IS NULL AND tokens IS NOT NULL").isEmpty()
    assert daily.where("is_from_me IS NULL AND tokens IS NOT NULL").isEmpty()
    assert not daily.where("contact_name IS NULL").isEmpty()
    unnamed = tables_["summary_contact"].where("contact_name IS NULL").first()
    assert unnamed.first_message_ts is None and unnamed.first_message_dt is not None
    assert not tables_["contact_stats"].where("contact_name IS NULL AND tokens IS NOT NULL").isEmpty()


def test_measure_sums_and_require_rows(spark):
    schema = ", ".join(["dt date", *(f"{m} long" for m in MEASURES)])
    base = {m: 0 for m in MEASURES}
    good = base | {"messages": 5, "text_messages": 2, "emotes": 1, "messages_attachment_only": 1, "urls": 1}
    bad = base | {"messages": 1, "app_for_imessage": 1, "messages_attachment_only": 1}
    daily = spark.createDataFrame(
        [(dt.date(2024, 1, i + 1), *(row[m] for m in MEASURES)) for i, row in enumerate((good, bad))], schema
    )
    assert rows(quality.measure_sums_disagree(daily)) == [(dt.date(2024, 1, 2), 1, 2)]
    assert quality.require_rows(daily, "daily") is daily
    with pytest.raises(ValueError):
        quality.require_rows(daily.where("dt IS NULL"), "daily")


def test_gaps_are_filled_only_for_one_series(spark):
    daily = spark.createDataFrame(
        [(dt.date(2024, 1, 6), "A", 3), (dt.date(2024, 1, 22), "A", 4), (dt.date(2024, 1, 7), "B", None)],
        "dt date, contact_name string, display_message_count long",
    )
    one = daily.where("contact_name = 'A'").drop("contact_name")
    weeks = [dt.date(2024, 1, d) for d in (7, 14, 21, 28)]
    assert rows(insights.resample(one, "Week")) == list(zip(weeks, (3, 0, 0, 4)))
    assert rows(insights.resample(one, "Day")) == rows(one)
    assert rows(insights.resample_by(daily, "Week", ["contact_name"])) == [
        ("A", weeks[0], 3),
        ("A", weeks[3], 4),
        ("B", weeks[0], 0),
    ]


def label(day, granularity):
    if granularity == "Week":
        return day + dt.timedelta(days=6 - day.weekday())
    return day.replace(day=1) if granularity == "Month" else day.replace(month=1, day=1)


def after(period, granularity):
    if granularity == "Week":
        return period + dt.timedelta(days=7)
    months = period.year * 12 + period.month - 1 + (1 if granularity == "Month" else 12)
    return dt.date(months // 12, months % 12 + 1, 1)


@pytest.mark.parametrize("granularity", ["Week", "Month", "Year"])
def test_resampling_against_brute_force(spark, granularity):
    draw = random.Random(granularity)
    days = {dt.date(2019, 11, 3) + dt.timedelta(days=draw.randrange(1500)) for _ in range(40)}
    daily = [(day, draw.choice("ABC"), draw.randrange(9)) for day in sorted(days)] + [(None, "A", 5)]
    df = spark.createDataFrame(daily, "dt date, contact_name string, display_message_count long")

    def totals(rows_):
        sums = {}
        for day, _, n in rows_:
            if day:
                sums[label(day, granularity)] = sums.get(label(day, granularity), 0) + n
        period, filled = min(sums), []
        while period <= max(sums):
            filled.append((period, sums.get(period, 0)))
            period = after(period, granularity)
        return filled, sums

    everyone, seen = totals(daily)
    assert rows(insights.resample(df.drop("contact_name"), granularity)) == everyone
    own, _ = totals([row for row in daily if row[1] == "A"])
    expected = [(day, n, seen[day], n / seen[day] if seen[day] else None) for day, n in own if day in seen]
    assert [tuple(r) for r in insights.contact_share(df, "A", granularity).orderBy("dt").collect()] == expected


def test_complete_ranks_are_those_of_a_sort(spark):
    draw = random.Random(4)
    daily = [(dt.date(2024, 1, 1), f"c{k:04}", draw.randrange(50)) for k in range(3000)]
    df = spark.createDataFrame(daily, "dt date, contact_name string, display_message_count long").repartition(5)
    kinds = df.select("contact_name", F.lit(False).alias("is_group_chat"))
    found = {r.contact_name: r["rank"] for r in insights.favourite_contacts(df, kinds).collect()}
    wanted = sorted(daily, key=lambda r: (-r[2], r[1]))
    assert found == {name: k + 1 for k, (_, name, _) in enumerate(wanted)}


def test_ranks_and_running_totals(spark):
    daily = spark.createDataFrame(
        [(dt.date(2024, 1, d), name, n) for d, name, n in ((1, "A", 1), (2, "A", 1), (3, "B", 5), (3, "C", 5), (4, None, 9))],
        "dt date, contact_name string, display_message_count long",
    )
    kinds = spark.createDataFrame(
        [("A", False), ("A", True), ("B", False), ("C", False)], "contact_name string, is_group_chat boolean"
    )
    best = insights.favourite_contacts(daily, kinds, 2)
    assert rows(best) == [("B", 5, 1), ("C", 5, 2)]
    assert rows(insights.favourite_group_chats(daily, kinds)) == [("A", 2, 1)]
    running = insights.cumulative_volume(daily, insights.favourite_contacts(daily, kinds), "Day")
    assert rows(running.where("contact_name = 'A'").select("display_message_count")) == [(1,), (2,)]


def test_duplicated_ids_are_reported(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "message_id long")
    assert rows(quality.duplicate_message_ids(df)) == [(1, 2)]


def test_rollup_levels_match_single_summaries(spark):
    daily = Tables(spark, SMALL, "events")["daily_summary_contact_from_who"]
    rolled = summaries.rollup_summary(daily)
    single = summaries.daily_summary(daily).select("dt", "messages", "tokens")
    assert rows(rolled.where("level = 'day'").select("dt", "messages", "tokens")) == rows(single)
