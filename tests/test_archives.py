"""The hand-derived fixtures: both archive shapes from SQLite to records."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from confab.functions import to_jid, typedstream_text
from confab.operators import clean_apple, clean_whatsapp, session_records, summary, write_jsonl
from confab.sources import apple_messages, apple_tables, register, whatsapp_messages, whatsapp_tables

OBJ = "￼"
S = 10**9


def blob(text, tag=None):
    data = text.encode() if isinstance(text, str) else text
    n = len(data)
    tag = tag or (bytes([n]) if n < 0x81 else b"\x81" + n.to_bytes(2, "little") if n < 65536 else b"\x82" + n.to_bytes(4, "little"))
    return b"\x04\x0bstreamtyped\xc3\xff" + b"NSString" + b"\x01\x94\x84\x01+" + tag + data


@pytest.fixture
def apple(tmp_path, spark):
    register(spark)
    path = tmp_path / "chat.db"
    db = sqlite3.connect(path)
    db.executescript(
        "create table message(ROWID integer primary key, date integer, is_from_me integer, handle_id integer, text text, attributedBody blob, cache_has_attachments integer, associated_message_type integer);"
        "create table chat(ROWID integer primary key, chat_identifier text, style integer); create table chat_message_join(chat_id integer, message_id integer); create table handle(ROWID integer primary key, id text);"
    )
    db.executemany("insert into chat values(?,?,?)", [(1, "+14155550123", 45), (2, "chat777", 43), (3, "a@example.com", 45)])
    db.executemany("insert into handle values(?,?)", [(10, "+14155550123"), (11, "+14155550199")])
    rows = [
        (1, 1, 700000000 * S, 0, 10, "hi", None, 0),
        (2, 1, 700000001 * S + 9 * 10**8, 1, 10, None, blob("yo " + OBJ), 0),
        (3, 1, 700000002 * S, 0, 10, "Liked", None, 2000),
        (4, 1, 700043201 * S, 0, 10, "later", None, 0),
        (5, 1, 700086402 * S, 0, 10, "new", None, 0),
        (8, 2, 700000000 * S, 0, 11, "  hey  ", None, 0),
        (6, 2, 700030000 * S, 0, None, "renamed", None, 0),
        (7, 2, 700035000 * S, 0, 11, OBJ, blob("unused"), 0),
        (10, 2, 700060000 * S, 0, 11, "back", None, 0),
        (9, 3, 700000000 * S, 0, 10, OBJ, None, 0),
    ]
    db.executemany("insert into message values(?,?,?,?,?,?,0,?)", [(r[0], *r[2:]) for r in rows])
    db.executemany("insert into chat_message_join values(?,?)", [(r[1], r[0]) for r in rows])
    db.commit()
    yield str(path), db
    db.close()


def told(records):
    return sorted((r["chat_id"], r["group"], r["start"], r["end"], [(m["text"], m["me"], m["from"]) for m in r["messages"]]) for r in records.collect())


def test_apple(spark, apple):
    flat = apple_messages(apple_tables(spark, apple[0]))
    records = session_records(clean_apple(flat))
    a, b = "+14155550123", "+14155550199"
    assert told(records) == [
        (1, False, 1678307200, 1678350401, [("hi", False, a), ("yo", True, None), ("later", False, a)]),
        (1, False, 1678393602, 1678393602, [("new", False, a)]),
        (2, True, 1678307200, 1678307200, [("hey", False, b)]),
        (2, True, 1678367200, 1678367200, [("back", False, b)]),
    ]
    assert tuple(summary(flat, records).first()) == (3, 4, 6)


@pytest.mark.parametrize("chat,want", [("+14155550123", (1, 2, 4)), ("", (0, 0, 0))])
def test_apple_chat_filter(spark, apple, chat, want):
    flat = apple_messages(apple_tables(spark, apple[0]), chat)
    row = summary(flat, session_records(clean_apple(flat))).first()
    assert tuple(x or 0 for x in row) == want


def test_apple_variants(spark, apple):
    path, db = apple
    db.execute("insert into chat_message_join values(3, 1)")
    db.execute("update chat set style = null where ROWID = 3")
    db.commit()
    rows = told(session_records(clean_apple(apple_messages(apple_tables(spark, path)))))
    assert (3, False, 1678307200, 1678307200, [("hi", False, "+14155550123")]) in rows and len(rows) == 5


def test_whatsapp(spark, tmp_path):
    register(spark)
    db = sqlite3.connect(tmp_path / "w.db")
    db.executescript(
        "create table ZWAMESSAGE(Z_PK integer primary key, ZCHATSESSION integer, ZMESSAGEDATE real, ZISFROMME integer, ZFROMJID text, ZGROUPMEMBER integer, ZTEXT text, ZMESSAGETYPE integer);"
        "create table ZWACHATSESSION(Z_PK integer primary key, ZCONTACTJID text, ZSESSIONTYPE integer); create table ZWAGROUPMEMBER(Z_PK integer primary key, ZMEMBERJID text);"
    )
    one, group = "14255550123@s.whatsapp.net", "123-456@g.us"
    db.executemany("insert into ZWACHATSESSION values(?,?,?)", [(1, one, 0), (2, group, 1), (3, "x@broadcast", None)])
    db.execute("insert into ZWAGROUPMEMBER values(5, '19995550000@s.whatsapp.net')")
    db.executemany(
        "insert into ZWAMESSAGE values(?,?,?,?,?,?,?,?)",
        [
            (1, 1, 700000000.9, 0, one, None, "hello", 0),
            (2, 1, 700000001.2, 1, None, None, "https://e.example", 7),
            (3, 1, 700000002.0, 0, one, None, "caption", 1),
            (4, 2, 700000000.0, 0, group, 5, "yo", 0),
            (5, 2, 700000010.0, 0, group, None, "who", 0),
            (6, 2, 700000020.0, 0, group, 5, "   ", 0),
            (7, 3, 700000000.0, 0, None, None, "b", 0),
        ],
    )
    db.commit()
    flat = whatsapp_messages(whatsapp_tables(spark, str(tmp_path / "w.db")))
    records = session_records(clean_whatsapp(flat))
    assert told(records) == [
        (1, False, 1678307200, 1678307201, [("hello", False, one), ("https://e.example", True, None)]),
        (2, True, 1678307200, 1678307210, [("yo", False, "19995550000@s.whatsapp.net"), ("who", False, group)]),
        (3, True, 1678307200, 1678307200, [("b", False, None)]),
    ]
    assert tuple(summary(flat, records).first()) == (3, 3, 5)
    write_jsonl(records, str(tmp_path / "out"), single_file=True)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert [x["chat_id"] for x in lines] == [1, 2, 3]
    assert lines[0]["messages"][1] == {"t": 1678307201, "me": True, "from": None, "text": "https://e.example"}


BLOBS = [
    (None, ""), (b"", ""), (b"nothing here", ""), (b"xNSString\x01\x94\x84\x01+", ""), (b"xNSString", ""), (blob("a", b"\x81"), ""), (blob("", b"\x81\x05"), ""),
    (blob("short", b"\x7f"), "short"), (blob("x" * 200, b"\x83"), "x" * 131), (blob(b"\xc3("), "\ufffd("), (blob("\u00e9" * 50), "\u00e9" * 50), (blob("NSString twice NSString"), "NSString twice NSString"),
    (blob("\u00fc" * 40000), "\u00fc" * 40000), (blob("z" * 65535), "z" * 65535), (blob("z" * 65536), "z" * 65536), (blob("y", b"\x82\xff\xff\xff\xff"), "y"), (b"\xff\xfe\xc0" + blob("after"), "after"),
]


def test_blobs(spark):
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, (b, _) in enumerate(BLOBS)], "i int, b binary")
    got = {r.i: r.x for r in df.select("i", typedstream_text(F.col("b")).alias("x")).collect()}
    assert got == {i: text for i, (_, text) in enumerate(BLOBS)}


def test_filters_run_in_sqlite(spark, apple):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    from confab.sources.sqlite_ro import SqliteReader

    path, _ = apple
    reader = SqliteReader(StructType.fromDDL("ROWID bigint, associated_message_type int"), {"path": path, "table": "message", "numpartitions": "1"})
    asked = [EqualTo(("associated_message_type",), 2000), In(("ROWID",), (3, 4)), GreaterThan(("ROWID",), 1), EqualTo(("ROWID",), True)]
    assert list(reader.pushFilters(asked)) == asked and len(reader.where) == 2
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(3, 2000)]
    rows = spark.read.format("sqlite_ro").schema("ROWID bigint, associated_message_type int").option("path", path).option("table", "message").load()
    assert [r.ROWID for r in rows.filter("associated_message_type = 2000").collect()] == [3]
    assert rows.filter("associated_message_type in (0, 2000)").count() == 10


def test_missing_option(spark):
    register(spark)
    with pytest.raises(Exception, match="'path' is required"):
        spark.read.format("sqlite_ro").schema("a int").option("table", "t").load().count()


@pytest.mark.parametrize("chat,counts,lines", [(None, (3, 4, 6), 4), ("+14155550123", (1, 2, 4), 2), ("", (0, 0, 0), 0)])
def test_command(spark, apple, tmp_path, chat, counts, lines):
    """Twice to the same path, below a folder that isn't there: the second run replaces the first."""
    from confab.__main__ import main

    out = tmp_path / "new" / "out"
    for _ in range(2):
        said = main(["apple", apple[0], str(out), *([] if chat is None else [chat])], spark)
        assert said == f"{counts[2]} messages in {counts[1]} sessions of {counts[0]} chats -> {out}"
        assert sum(len(f.read_text().splitlines()) for f in out.glob("part-*")) == lines


def test_jid(spark):
    df = spark.createDataFrame([("+1 (425) 555-0123",), (" x@g.us ",), ("abc",)], "c string")
    assert [r[0] for r in df.select(to_jid(F.col("c"))).collect()] == ["14255550123@s.whatsapp.net", "x@g.us", "@s.whatsapp.net"]
