"""Tables that change together, and batches of messages carried through them by day."""

import datetime as dt
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from chatlens.operators import insights, quality
from chatlens.plans.changes import messages_of, refresh_days, touched_days
from chatlens.plans.tables import DAILY_TABLES, WRITTEN_TABLES, TableSet, committed_tables, refresh_tables
from chatlens.sources import sinks
from chatlens.sources.commits import CommitConflict, TableStore
from checks.bindings import Bound
from checks.queries import Tables, spark_queries

SMALL = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 3, 31)


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def committed(store, **tables):
    change = store.refresh()
    for name, df in tables.items():
        change.write(name, df)
    return change.commit()


def test_readers_see_one_commit(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    assert store.commit().number == 0 and store.tables() == {}
    first = committed(store, a=numbers(spark, 1), b=numbers(spark, 10))
    held = {name: store.read(first, name) for name in first.tables}
    change = store.refresh()
    change.write("a", numbers(spark, 2))
    assert rows(store.tables()["a"]) == [(1,)] and rows(change.read("a")) == [(2,)]
    change.commit()
    now = store.tables()
    assert [rows(t) for t in (held["a"], held["b"], now["a"], now["b"])] == [[(1,)], [(10,)], [(2,)], [(10,)]]
    assert rows(store.tables(1)["a"]) == [(1,)]


def test_of_two_writers_one_fails(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    committed(store, a=numbers(spark, 1), b=numbers(spark, 1))
    one, other = store.refresh(), store.refresh()
    one.write("a", numbers(spark, 2))
    other.write("b", numbers(spark, 3))
    one.commit()
    with pytest.raises(CommitConflict):
        other.commit()
    assert store.numbers() == [1, 2]
    assert rows(store.tables()["a"]) == [(2,)] and rows(store.tables()["b"]) == [(1,)]


def test_of_two_writers_at_the_same_time_one_fails(spark, tmp_path, monkeypatch):
    store = TableStore(spark, f"{tmp_path}/s")
    one, other = store.refresh(), store.refresh()
    one.write("a", numbers(spark, 2))
    other.write("a", numbers(spark, 3))
    monkeypatch.setattr(TableStore, "numbers", lambda self: [])
    one.commit()
    with pytest.raises(CommitConflict):
        other.commit()
    assert rows(store.tables(1)["a"]) == [(2,)]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    committed(store, a=numbers(spark, 1))
    dying = store.refresh()
    dying.write("a", numbers(spark, 2))
    with pytest.raises(PySparkException):
        dying.write("b", spark.range(1).select(F.raise_error(F.lit("gone")).cast("int").alias("n")))
    assert rows(store.tables()["a"]) == [(1,)] and set(store.tables()) == {"a"}
    committed(store, a=numbers(spark, 4))
    assert rows(store.tables()["a"]) == [(4,)]


def test_expired_commits_take_only_their_own_files(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    committed(store, a=numbers(spark, 1), b=numbers(spark, 9))
    for value in (2, 3, 4):
        committed(store, a=numbers(spark, value))
    assert store.expire(2) == [1, 2] and store.numbers() == [3, 4]
    assert rows(store.tables(3)["a"]) == [(3,)] and rows(store.tables()["b"]) == [(9,)]
    assert len(list((tmp_path / "s" / "a").iterdir())) == 2
    assert store.expire(5) == [] and committed(store, a=numbers(spark, 5)).number == 5


def days_of(spark, *pairs):
    return spark.createDataFrame([(day and dt.date.fromisoformat(day), n) for day, n in pairs], "dt date, n int")


def test_of_each_day_the_latest_version_counts(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/s")
    change = store.refresh()
    change.write("t", days_of(spark, ("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3), (None, 4)), "dt")
    change.commit()
    for days, new in ((["2024-01-02", None], [("2024-01-02", 20), (None, 40)]), (["2024-01-02", "2024-01-03"], [("2024-01-02", 21)])):
        change = store.refresh()
        assert rows(change.write_days("t", days_of(spark, *new), days)) == rows(days_of(spark, *new))
        change.commit()
    assert sorted(r.n for r in store.tables()["t"].collect()) == [1, 21, 40]
    assert sorted(r.n for r in store.tables(2)["t"].collect()) == [1, 3, 20, 40]
    with pytest.raises(ValueError, match="other columns"):
        store.refresh().write_days("t", numbers(spark, 1), [None])


def test_a_snapshot_outlives_its_rewriting(spark, tmp_path):
    out = f"{tmp_path}/extract"
    old = sinks.extract_datasets(spark, {"daily": numbers(spark, 1)}, out, ["daily"])["daily"]
    new = sinks.extract_datasets(spark, {"daily": old.withColumn("n", F.col("n") + 1)}, out, ["daily"], refresh=True)["daily"]
    assert rows(old) == [(1,)] and rows(new) == [(2,)]


@pytest.fixture(scope="module")
def raw(spark):
    return Bound(spark, SMALL).raw_tables()


def sources(raw, part):
    """The sources when only some messages have come: links, messages and titles of the others are missing."""
    come = F.pmod(F.xxhash64(F.col("ROWID")), F.lit(4)) < part
    message = raw["message"].where(come)
    links = raw["chat_message_join"].join(message.select(F.col("ROWID").alias("message_id")), "message_id", "left_semi")
    return {**raw, "message": message, "chat_message_join": links.select(*raw["chat_message_join"].columns)}


def test_batches_by_day_equal_a_full_refresh(spark, raw, tmp_path):
    out = f"{tmp_path}/tables"
    refresh_tables(TableSet(spark, sources(raw, 1), AS_OF), out)
    store = TableStore(spark, out)
    for part in (2, 3, 4):
        before, full = store.tables(), TableSet(spark, sources(raw, part), AS_OF)
        arrived = full["message"].select(F.col("ROWID").alias("message_id"))
        arrived = arrived.join(sources(raw, part - 1)["message"].select(F.col("ROWID").alias("message_id")), "message_id", "left_anti")
        done = refresh_days(store, full, arrived)
        for name in WRITTEN_TABLES:
            got = store.read(done, name)
            assert got.columns == full[name].columns
            assert rows(got) == rows(full[name]), (part, name)
            assert before[name].count() >= 0  # older commits stay readable
    tables = committed_tables(spark, out, raw, AS_OF)
    assert rows(tables["summary_contact"]) == rows(full["summary_contact"])


def test_only_touched_days_are_written_and_read(spark, raw, tmp_path):
    out = f"{tmp_path}/tables"
    tables = TableSet(spark, raw, AS_OF)
    refresh_tables(tables, out)
    store = TableStore(spark, out)
    written = store.tables()
    one = written["message_user"].where("NOT is_threaded_reply AND dt IS NOT NULL").orderBy("message_id").limit(1)
    days = touched_days(written, tables, one.select("message_id"))
    assert days == [str(one.first().dt)]
    done = refresh_days(store, tables, one.select("message_id"))
    for name in DAILY_TABLES:
        assert done.tables[name].versions[-1].days == tuple(days)
        new = spark.read.parquet(f"{out}/{done.tables[name].versions[-1].path}")
        assert {str(r.dt) for r in new.select("dt").distinct().collect()} <= set(days)
        assert rows(store.read(done, name)) == rows(written[name])
    # The days of older files that count no more are left out by their folders.
    text = store.read(done, "message_user")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [NOT" in text or "PartitionFilters: [(NOT" in text
    pushed = messages_of(tables, days)._jdf.queryExecution().executedPlan().toString()
    assert "date" in pushed
    assert refresh_days(store, tables, one.select("message_id").limit(0)).tables["message_user"] == done.tables["message_user"]


def test_a_new_title_touches_its_chats_days(spark, raw, tmp_path):
    out = f"{tmp_path}/tables"
    refresh_tables(TableSet(spark, raw, AS_OF), out)
    store = TableStore(spark, out)
    chat = store.tables()["message_user"].where("contact_name IS NULL AND chat_identifier IS NOT NULL").first().chat_identifier
    manual = spark.createDataFrame([(chat, "New Name")], "chat_identifier string, contact_name string")
    manual = raw["contacts_manual"].unionByName(manual.select(*raw["contacts_manual"].columns))
    full = TableSet(spark, {**raw, "contacts_manual": manual}, AS_OF)
    done = refresh_days(store, full, spark.createDataFrame([], "message_id bigint"))
    for name in WRITTEN_TABLES:
        assert rows(store.read(done, name)) == rows(full[name]), name
    assert store.read(done, "message_user").where(F.col("chat_identifier") == chat).select("contact_name").distinct().first()[0] == "New Name"


def test_checks_are_counted_in_passing(spark, raw, tmp_path):
    lazy = TableSet(spark, raw, AS_OF)
    seen = Observation("checks")
    written = refresh_tables(lazy, f"{tmp_path}/tables", seen)
    assert seen.get["qc_null_flags"] == lazy["qc_null_flags"].count() > 0
    whole = {r.check_name: r.n_rows for r in quality.run_quality_control(lazy).collect()}
    assert whole == {name: lazy[name].count() for name in quality.CHECKS}
    assert {r.check_name: r.n_rows for r in quality.run_quality_control(written, counted=seen.get).collect()} == whole


def nodes(df):
    """Names of the plan's operators, without those of subqueries that give one value."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [re.match(r"\W*(\w+)", line).group(1) for line in lines if line.strip() and not re.match(r"\s*:", line)]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan")


def test_report_reads_messages_once(spark, raw):
    lazy = TableSet(spark, raw, AS_OF)
    parts = (lazy["message_user"], lazy[quality.CHECKS[0]], lazy["contacts_ignored"])
    assert scans(quality.run_quality_control(lazy)) <= sum(map(scans, parts))


def test_emoji_are_found_inside_the_row(spark, raw, tmp_path):
    stored = sinks.materialise(TableSet(spark, raw, AS_OF)["message_user"], f"{tmp_path}/m", "dt")
    found = TableSet(spark, {"message_user": stored}, AS_OF)["message_emoji_map"]
    assert set(nodes(found)) <= {"AdaptiveSparkPlan", "Project", "FileScan"} and found.where("has_emoji").count()
    none = spark.createDataFrame([], "emoji string, plain_text string")
    assert TableSet(spark, {"message_user": stored, "emoji_text_map": none}, AS_OF)["message_emoji_map"].where("has_emoji").count() == 0


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_required_rows_are_checked_when_read(spark):
    daily = Tables(spark, SMALL, "events")["daily_summary"]
    some, n_jobs = jobs_of(spark, lambda: quality.with_required_rows(daily, "the days"))
    assert n_jobs == 0 and rows(some) == rows(daily)
    none = quality.with_required_rows(insights.in_range(daily, dt.date(1999, 1, 1), dt.date(1999, 1, 2)), "the range")
    for read in (none.collect, none.count):
        with pytest.raises(PySparkException, match="no rows in the range"):
            read()


def test_rankings_read_their_table_once(spark):
    t = Tables(spark, SMALL, "events")
    daily = t.shown("daily_summary_contact")
    frames = [
        insights.sms_ranking(t["summary_contact_from_who"], n=5),
        insights.favourite_contacts(daily, n=5),
        insights.favourite_group_chats(daily, n=5),
        insights.cumulative_volume(daily, 5, "Week"),
    ]
    assert [scans(df) for df in frames] == [scans(daily)] * 4


def above_scans(df, table, column):
    """For each scan of a table that gives a column: the operators above it, up to the first join."""
    out = []

    def walk(node, above):
        name, children = node.nodeName(), node.children()
        if name.endswith(f".{table}") and f"{column}#" in node.output().mkString(","):
            joins = [k for k, other in enumerate(above) if "Join" in other]
            out.append(above[: joins[0] + 1] if joins else above)
        for k in range(children.size()):
            walk(children.apply(k), [name, *above])

    walk(df._jdf.queryExecution().executedPlan().initialPlan(), [])
    return out


def test_joins_by_a_stored_key_leave_the_large_side_in_place(spark, raw, tmp_path):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plain = TableSet(spark, raw, AS_OF)["message_user"]
        message = sinks.store_by_key(raw["message"], "stored_message", f"{tmp_path}/m", "ROWID", 8)
        stored = TableSet(spark, {**raw, "message": message}, AS_OF)["message_user"]
        wide = above_scans(stored, "stored_message", "text")
        assert wide and all("Exchange" not in path and "SortMergeJoin" in path for path in wide)
        assert rows(stored) == rows(plain)
        known = sinks.store_by_key(plain, "stored_messages", f"{tmp_path}/u", "message_id", 8)
        fresh = sinks.new_rows(plain.where("message_id % 3 = 0"), known.where("message_id % 2 = 0"), ["message_id"])
        large = above_scans(fresh, "stored_messages", "message_id")
        assert any(path[-1] == "SortMergeJoin" and "Exchange" not in path for path in large)
        assert sorted(r.message_id for r in fresh.collect()) == sorted(
            r.message_id for r in plain.where("message_id % 3 = 0 AND message_id % 2 <> 0").collect()
        )
    finally:
        spark.conf.set(limit, before)
        for table in ("stored_message", "stored_messages"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def under_exchanges(df):
    """For each shuffle of the plan the operators below it, down to the next shuffle, aggregate or broadcast."""
    ends, out = ("Exchange", "HashAggregate", "BroadcastExchange"), []

    def names(node):
        held = [node.nodeName()]
        return held if held[0] in ends else held + [n for k in range(node.children().size()) for n in names(node.children().apply(k))]

    def walk(node):
        for k in range(node.children().size()):
            if node.nodeName() == "Exchange":
                out.append(names(node.children().apply(k)))
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return out


def test_new_rows_send_no_repeats_and_no_tokens(spark, tmp_path):
    texts = [(i, "s", "en", text) for i, text in enumerate(("a, b", "b. b c", None, "c d, a", "c.")) for _ in range(2)] + [(None, "s", "en", "z")]
    spark.createDataFrame(texts, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        known = spark.range(1000).select((F.col("id") % 10).alias("token"))
        fresh = sinks.new_rows(spark.range(20).select(F.col("id").alias("token")), known, ["token"])
        assert {row.token for row in fresh.collect()} == set(range(10, 20))
        assert all(below == ["HashAggregate"] for below in under_exchanges(fresh))
        found = spark_queries()["new_rows_documents"](spark, str(tmp_path))
        assert sorted((row.token or "", row.is_group_chat) for row in found.collect()) == [(".", False), ("d", False)]
        assert under_exchanges(found) and not any("Generate" in below for below in under_exchanges(found))
    finally:
        spark.conf.set(limit, before)
