"""One golden row per label rule and flag of the message table."""

import datetime as dt

import pytest

from chatlens.operators import messages
from chatlens.operators.contacts import contact_group_names, contacts_user
from chatlens.schemas import EMOTE_LABELS, MESSAGE_USER_COLUMNS, SOURCE_SCHEMAS, STATIC_SCHEMAS

DEFAULTS = {
    "guid": None,
    "date": 726753600123456789,
    "text": "hello there",
    "associated_message_type": 0,
    "balloon_bundle_id": None,
    "service": "iMessage",
    "is_from_me": 1,
    "thread_originator_guid": None,
    "cache_has_attachments": 0,
    "was_data_detected": 0,
    "cache_roomnames": None,
    "group_title": None,
}

LABELS = [
    ({"balloon_bundle_id": "x.PEERPaymentMessagesExtension", "associated_message_type": 2000}, "apple_cash"),
    ({"balloon_bundle_id": "PeerPaymentMessagesExtension.x"}, None),
    ({"balloon_bundle_id": "com.iMessagePoll.x", "associated_message_type": 2}, "poll"),
    ({"balloon_bundle_id": "com.iMessagePoll.x", "associated_message_type": 3}, None),
    ({"balloon_bundle_id": "com.GamePigeon.x", "associated_message_type": 2}, "game_pigeon"),
    ({"balloon_bundle_id": "com.GamePigeon.x", "associated_message_type": 3}, "game_pigeon"),
    ({"balloon_bundle_id": "com.GamePigeon.x"}, None),
    ({"balloon_bundle_id": "a.Messages.Business.Extension", "associated_message_type": 3}, "business_extension"),
    ({"text": "Ann EARNED an achievement.", "associated_message_type": 3}, "activity"),
    ({"text": "Ann completed a workout.", "associated_message_type": 3}, "activity"),
    ({"text": "Ann closed all three activity rings.", "associated_message_type": 3}, "activity"),
    ({"text": "Ann completed a workout. Twice", "associated_message_type": 3}, None),
    ({"text": "requested $5 with apple pay.", "associated_message_type": 3}, "apple_cash"),
    ({"text": "a new Poll", "associated_message_type": 3}, "poll"),
    ({"text": "Ann VOTED", "associated_message_type": 3}, "poll"),
    ({"text": "Cup Pong", "associated_message_type": 3}, "game_pigeon"),
    ({"text": "cup pong", "associated_message_type": 3}, None),
    ({"text": "8 Ball", "associated_message_type": 3}, "game_pigeon"),
    ({"text": "(null)", "associated_message_type": 3}, "null_message"),
    ({"text": "(null)"}, None),
    ({"associated_message_type": 1000, "cache_has_attachments": 1, "was_data_detected": 1}, "sticker"),
    ({"associated_message_type": 1000, "cache_has_attachments": 1}, None),
    ({"associated_message_type": None}, None),
    *(({"associated_message_type": code}, label) for code, label in EMOTE_LABELS.items()),
]


def message_rows(spark, rows):
    names = SOURCE_SCHEMAS["message"].names
    full = [{**DEFAULTS, "ROWID": i, "guid": f"g{i}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in full], SOURCE_SCHEMAS["message"])


def build(spark, rows, links=None, chats=None, contacts=()):
    message = message_rows(spark, rows)
    links = links if links is not None else [(1, i, 10) for i in range(len(rows))]
    chat = spark.createDataFrame(chats or [(1, "+14155550001")], SOURCE_SCHEMAS["chat"])
    link = spark.createDataFrame(links, SOURCE_SCHEMAS["chat_message_join"])
    names = spark.createDataFrame(list(contacts), "chat_identifier string, contact_name string, source string")
    built = messages.message_user(message, chat, link, names)
    assert tuple(built.columns) == MESSAGE_USER_COLUMNS
    return {row.message_id: row for row in built.collect()}


def test_special_types(spark):
    built = build(spark, [row for row, _ in LABELS])
    assert [built[i].message_special_type for i in range(len(LABELS))] == [label for _, label in LABELS]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ({}, {"text": "hello there", "is_text": True, "has_no_text": False, "is_emote": False}),
        ({"text": None}, {"text": None, "is_text": False, "has_no_text": True}),
        ({"text": ""}, {"text": None, "is_text": False, "has_no_text": True}),
        ({"text": "￼"}, {"text": None, "is_text": False, "has_no_text": True}),
        ({"text": "�"}, {"text": None, "is_text": True, "has_no_text": False}),
        ({"text": " a\r\nb "}, {"text": "a  b", "is_text": True}),
        ({"text": "HTTPS://x.org"}, {"text": None, "is_url": True, "is_text": False, "has_no_text": False}),
        ({"text": "http:x"}, {"is_url": True}),
        ({"text": "see http://x"}, {"is_url": False, "is_text": True}),
        ({"is_from_me": None}, {"is_from_me": None}),
        ({"is_from_me": 0}, {"is_from_me": False}),
        ({"is_from_me": 7}, {"is_from_me": None}),
        (
            {"cache_has_attachments": 1},
            {"has_attachment": True, "is_attachment": False, "has_attachment_image": True, "is_attachment_image": False},
        ),
        (
            {"cache_has_attachments": 1, "text": "￼"},
            {"has_attachment": True, "is_attachment": True, "has_attachment_image": True, "is_attachment_image": True},
        ),
        (
            {"cache_has_attachments": 1, "was_data_detected": 1, "associated_message_type": 1000},
            {"has_attachment": True, "is_attachment": True, "has_attachment_image": False, "is_attachment_image": False},
        ),
        (
            {"cache_has_attachments": 1, "text": "http://x"},
            {"has_attachment": True, "is_attachment": False, "has_attachment_image": False},
        ),
        (
            {"cache_has_attachments": 1, "associated_message_type": 2001},
            {"has_attachment": False, "is_attachment": False, "is_emote": True, "text": None},
        ),
        ({"cache_has_attachments": None}, {"has_attachment": False, "is_attachment": False}),
        ({"associated_message_type": None}, {"is_emote": False, "is_text": True}),
    ],
)
def test_flags(spark, row, expected):
    built = build(spark, [row])[0]
    assert {name: built[name] for name in expected} == expected


def test_time_is_cut_to_whole_seconds(spark):
    built = build(spark, [{}])[0]
    assert built.ts == dt.datetime(2024, 1, 12, 12, 0)
    assert built.dt == dt.date(2024, 1, 12)


def test_chats_contacts_and_threads(spark):
    rows = [
        {},
        {"thread_originator_guid": "g0"},
        {"thread_originator_guid": "g0"},
        {"thread_originator_guid": "g9"},
        {"thread_originator_guid": "g1"},
        {},
    ]
    links = [(1, 0, 10), (2, 0, 20), (1, 1, 10), (2, 1, 10), (3, 2, 5), (1, 3, 1), (2, 4, 1), (9, 5, 1)]
    chats = [(1, "+1"), (2, "CHAT2"), (3, None)]
    built = build(spark, rows, links, chats, [("CHAT2", "Friends", "contacts_manual")])
    assert set(built) == {0, 1, 2, 3, 4}  # message 5 lies in a chat nobody knows
    assert (built[0].chat_identifier, built[0].contact_name, built[0].is_group_chat) == ("CHAT2", "Friends", True)
    assert built[1].chat_identifier == "+1"  # equal dates: the lower chat id
    assert (built[2].chat_identifier, built[2].contact_name, built[2].is_group_chat) == (None, None, False)
    assert [built[i].is_thread_origin for i in range(5)] == [True, True, False, False, False]
    assert [built[i].thread_original_message_id for i in range(5)] == [0, 1, None, None, None]
    assert [built[i].is_threaded_reply for i in range(5)] == [False, True, True, True, True]


def test_group_names_and_contact_priority(spark):
    rows = [
        {"cache_roomnames": "chat1", "group_title": "old", "date": 1},
        {"cache_roomnames": "chat1", "group_title": "new", "date": 3},
        {"cache_roomnames": "chat1", "group_title": "also new", "date": 3},
        {"cache_roomnames": "chat1", "group_title": None, "date": 9},
        {"cache_roomnames": "chat2", "group_title": "undated", "date": None},
        {"cache_roomnames": "chat2", "group_title": "dated", "date": -5},
        {"cache_roomnames": None, "group_title": "nowhere"},
    ]
    groups = contact_group_names(message_rows(spark, rows))
    assert {tuple(row) for row in groups.collect()} == {("chat1", "also new"), ("chat2", "dated")}
    manual = spark.createDataFrame([("chat1", "M"), ("+1", "B"), ("+1", "A")], STATIC_SCHEMAS["contacts_manual"])
    book = spark.createDataFrame([("C", "+1", "phone"), ("D", "+2", "phone")], STATIC_SCHEMAS["contacts"])
    best = {tuple(row) for row in contacts_user(groups, manual, book).collect()}
    assert best == {
        ("chat1", "also new", "contact_group_names"),
        ("chat2", "dated", "contact_group_names"),
        ("+1", "A", "contacts_manual"),
        ("+2", "D", "contacts"),
    }


def test_a_hot_chat_is_split_at_the_join(spark):
    """A third of all links in one chat: the join with the chats is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        n = 60_000
        links = spark.range(n).selectExpr(
            "IF(id % 3 = 0, 1, id % 500) AS chat_id", "id AS message_id", "id AS message_date"
        )
        chat = spark.range(500).selectExpr("id AS ROWID", "concat('+', id) AS chat_identifier")
        names = spark.range(500).selectExpr("concat('+', id) AS chat_identifier", "concat('N', id) AS contact_name")
        message = spark.range(n).selectExpr(
            "id AS ROWID", "concat('g', id) AS guid", "id AS date", "'hi' AS text", "0 AS associated_message_type",
            "CAST(NULL AS STRING) AS balloon_bundle_id", "'SMS' AS service", "1 AS is_from_me",
            "IF(id % 3 = 0, 'g7', NULL) AS thread_originator_guid", "0 AS cache_has_attachments",
            "0 AS was_data_detected",
        )
        built = messages.message_user(message, chat, links, names).groupBy("contact_name").count()
        counts = {row.contact_name: row["count"] for row in built.collect()}
        assert sum(counts.values()) == n
        assert counts["N1"] == sum(1 for i in range(n) if i % 3 == 0 or i % 500 == 1)
        assert "skew=true" in built._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
