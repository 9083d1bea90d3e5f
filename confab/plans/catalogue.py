"""Every operator of the engine as a query over the driver's tables, with the same result in DuckDB's SQL.

``events`` stands in for messages per chat, ``conversations`` for turns, part-lineitem-orders for a bridge table and
documents-labels for a nullable dimension.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions.text import PLACEHOLDER, PY_WS, own_or_sender, strip_unicode, to_jid, typedstream_text, without_placeholder
from confab.operators.clean import clean_apple, clean_whatsapp
from confab.operators.records import in_order, session_records, summary
from confab.operators.sessionize import GAP_SECONDS, session_numbers, sessionize
from confab.operators.sinks import write_jsonl
from confab.session import table
from confab.sources.archives import APPLE_EPOCH, TEXT_TYPES, apple_epoch_ns, apple_epoch_s, apple_messages, whatsapp_messages
from confab.streaming.sessions import stream_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A session cut in SQL; {gap} seconds, {source} a relation with k, ord, id, t.
CUT = """SELECT *, sum(CASE WHEN t - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ord, id ROWS UNBOUNDED PRECEDING)::bigint AS session_no
FROM (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY ord, id) AS p FROM ({source}))"""
EVENTS = "SELECT user_id AS k, epoch_us(ts) AS ord, event_id AS id, epoch_us(ts) // 1000000 AS t, event_type, props, value FROM events"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", micros.alias("ord"), F.call_function("div", micros, F.lit(1_000_000).cast("bigint")).alias("t"), "event_type", "props", "value")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cleaned messages: a purchase is one's own turn, an error is a system row and goes."""
    return timed_events(spark, sf_dir).filter(F.col("event_type") != "error").select(
        F.col("user_id").alias("chat_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("chat"),
        (F.col("user_id") % 2 == 0).alias("group"),
        F.col("event_id").alias("message_id"),
        "ord",
        "t",
        (F.col("event_type") == "purchase").alias("me"),
        own_or_sender(F.col("event_type") == "purchase", F.col("event_type")).alias("from"),
        F.col("props").alias("text"),
    )


SESSIONS = 'SELECT k AS user_id, session_no, min(t) AS start, max(t) AS "end", count(*) AS n FROM ({cut}) GROUP BY ALL'


@query(SESSIONS.format(cut=CUT.format(gap=GAP_SECONDS, source=EVENTS)))
def sessions_12h(spark, sf_dir):
    return sessionize(timed_events(spark, sf_dir), ["user_id"], ["ord", "event_id"])


@query('SELECT k AS user_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM (' + CUT.format(gap=GAP_SECONDS, source=EVENTS) + ") GROUP BY k, session_no")
def sessions_session_window(spark, sf_dir):
    return stream_sessions(timed_events(spark, sf_dir), ["user_id"])


@query(" UNION ALL ".join(f"SELECT {gap}::int AS gap, * FROM ({SESSIONS.format(cut=CUT.format(gap=gap, source=EVENTS))})" for gap in (3600, 86400)))
def sessions_gap_param(spark, sf_dir):
    parts = [sessionize(timed_events(spark, sf_dir), ["user_id"], ["ord", "event_id"], gap=gap).select(F.lit(gap).alias("gap"), "*") for gap in (3600, 86400)]
    return parts[0].unionByName(parts[1])


MESSAGES = f"SELECT *, event_type = 'purchase' AS me, CASE WHEN event_type <> 'purchase' THEN event_type END AS sender FROM ({EVENTS}) WHERE event_type <> 'error'"
RECORDS = f"""SELECT k AS chat_id, 'user' || k AS chat, k % 2 = 0 AS "group", min(t) AS start, max(t) AS "end",
to_json(list({{'t': t, 'me': me, 'from': sender, 'text': props}} ORDER BY ord, id))::varchar AS messages
FROM ({CUT.format(gap=GAP_SECONDS, source=MESSAGES)}) GROUP BY k, session_no"""


@query(RECORDS)
def session_records_json(spark, sf_dir):
    records = session_records(event_messages(spark, sf_dir))
    return records.withColumn("messages", F.to_json("messages", {"ignoreNullFields": "false"}))


@query(
    f"""SELECT (SELECT count(DISTINCT user_id) FROM events)::bigint AS n_chats, count(*)::bigint AS n_sessions, coalesce(sum(n), 0)::bigint AS n_msgs
FROM (SELECT count(*) AS n FROM ({CUT.format(gap=GAP_SECONDS, source=f"SELECT * FROM ({MESSAGES}) WHERE event_type = 'purchase'")}) GROUP BY k, session_no)"""
)
def session_summary(spark, sf_dir):
    """Some users have no purchase: their chat counts, though no session is left of it."""
    flat = timed_events(spark, sf_dir).withColumnRenamed("user_id", "chat_id")
    return summary(flat, session_records(event_messages(spark, sf_dir).filter("me")))


@query(
    f"""SELECT 'clean_first' AS how, k AS user_id, count(DISTINCT session_no) AS sessions FROM ({CUT.format(gap=GAP_SECONDS, source=f"SELECT * FROM ({EVENTS}) WHERE event_type = 'click'")}) GROUP BY ALL
UNION ALL SELECT 'gap_first', k, count(DISTINCT session_no) FROM ({CUT.format(gap=GAP_SECONDS, source=EVENTS)}) WHERE event_type = 'click' GROUP BY ALL"""
)
def clean_then_gap(spark, sf_dir):
    rows, order = timed_events(spark, sf_dir), (["user_id"], ["ord", "event_id"])
    clicks = F.col("event_type") == "click"
    first, last = session_numbers(rows.filter(clicks), *order), session_numbers(rows, *order).filter(clicks)
    count = lambda how, df: df.groupBy("user_id").agg(F.count_distinct("session_no").alias("sessions")).select(F.lit(how).alias("how"), "user_id", "sessions")
    return count("clean_first", first).unionByName(count("gap_first", last))


@query("SELECT conv_id, count(*) AS n, to_json(list({'turn': turn, 'role': role, 'text': text} ORDER BY turn))::varchar AS turns FROM conversations GROUP BY conv_id")
def conversation_records(spark, sf_dir):
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), in_order(("turn",), ("turn", "role", "text")).alias("turns"))
    return grouped.withColumn("turns", F.to_json("turns", {"ignoreNullFields": "false"}))


@query("SELECT event_id AS message_id, user_id AS chat_id, event_type AS kind FROM events")
def projection_alias(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.col("user_id").alias("chat_id"), F.col("event_type").alias("kind"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def filter_eq(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "click").select("event_id", "value")


@query(f"SELECT event_id, user_id FROM events WHERE user_id % 10 IN {TEXT_TYPES}")
def filter_in(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((F.col("user_id") % 10).isin(*TEXT_TYPES)).select("event_id", "user_id")


OPTIONAL = "SELECT event_id FROM {events} WHERE (:kind IS NULL OR event_type = :kind)"


def optional_filter(spark: SparkSession, sf_dir: str, kind: str | None) -> DataFrame:
    """A bound parameter that is null folds the whole predicate away; any other value, '' too, reaches the scan."""
    return spark.sql(OPTIONAL, args={"kind": kind}, events=table(spark, sf_dir, "events"))


@query("SELECT event_id FROM events")
def optional_param_null(spark, sf_dir):
    return optional_filter(spark, sf_dir, None)


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def optional_param_set(spark, sf_dir):
    return optional_filter(spark, sf_dir, "view")


@query("SELECT event_id FROM events WHERE event_type = ''")
def optional_param_empty(spark, sf_dir):
    return optional_filter(spark, sf_dir, "")


@query("SELECT o_orderkey, l_linenumber, p_name FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def join_bridge(spark, sf_dir):
    part, bridge, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    return bridge.join(orders.filter(F.col("o_orderstatus") == "F"), F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "l_linenumber", "p_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def join_n1(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_join_nullable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(f"SELECT event_id, (epoch_us(ts) - 1704067200000000) * 1000 AS ns, ((epoch_us(ts) - 1704067200000000) * 1000) // 1000000000 + {APPLE_EPOCH} AS sent_at FROM events")
def epoch_int_div(spark, sf_dir):
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) * 1000
    return table(spark, sf_dir, "events").select("event_id", ns.alias("ns")).withColumn("sent_at", apple_epoch_ns(F.col("ns")))


@query(f"SELECT event_id, trunc(value - 50)::bigint + {APPLE_EPOCH} AS sent_at FROM events")
def cast_trunc(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", apple_epoch_s(F.col("value") - 50).alias("sent_at"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'member' END, d.source) AS sender FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coalesce_sender(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.when(F.col("toxic") == 1, "member"), F.col("source")).alias("sender"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN text ELSE role END AS body FROM conversations")
def truthy_fallback(spark, sf_dir):
    """Turns with turn % 3 = 0 have an empty text, with 2 a null one; both fall through."""
    text = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(text != "", text).otherwise(F.col("role")).alias("body"))


PADDING = (" \u001c", "  \t\u0085")


def _sql_text(s: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


@query(f"SELECT conv_id, turn, trim(replace({_sql_text(PADDING[0] + PLACEHOLDER)} || text || {_sql_text(PLACEHOLDER + PADDING[1])}, chr({ord(PLACEHOLDER)}), ''), {_sql_text(PY_WS)}) AS body FROM conversations")
def strip_unicode_padding(spark, sf_dir):
    padded = F.concat(F.lit(PADDING[0] + PLACEHOLDER), F.col("text"), F.lit(PLACEHOLDER + PADDING[1]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", strip_unicode(without_placeholder(padded)).alias("body"))


@query("SELECT conv_id, turn, text FROM conversations WHERE turn % 3 <> 0 AND NOT (role = 'system')")
def empty_body_drop(spark, sf_dir):
    """Bodies of every third turn are blanked; system turns have no sender, as events in a chat."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"), F.when(F.col("role") != "system", F.col("role")).alias("sender"))
    return rows.filter(~(F.col("sender").isNull() | (F.col("sender") == ""))).withColumn("text", strip_unicode("text")).filter(F.col("text") != "").drop("sender")


@query("SELECT conv_id, turn, role = 'assistant' AS me, CASE WHEN role <> 'assistant' THEN role END AS sender FROM conversations")
def mask_own_turn(spark, sf_dir):
    me = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", me.alias("me"), own_or_sender(me, F.col("role")).alias("sender"))


@query("SELECT d.doc_id, coalesce(l.toxic = 1, false) AS by_style, l.toxic IS DISTINCT FROM 0 AS by_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def group_flag_null(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("by_style"), (~F.col("toxic").eqNullSafe(F.lit(0))).alias("by_type"))


def encode_typedstream(text):
    """A blob that holds ``text``, with the shortest length tag that fits."""
    data = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    byte = lambda shift: F.unhex(F.lpad(F.hex(F.shiftright(size, shift).bitwiseAND(F.lit(255)).cast("bigint")), 2, "0"))
    tag = F.when(size < 0x81, byte(0)).when(size < 65536, F.concat(F.unhex(F.lit("81")), byte(0), byte(8))).otherwise(F.concat(F.unhex(F.lit("82")), byte(0), byte(8), byte(16), byte(24)))
    return F.concat(F.unhex(F.lit("040B73FFC384")), F.encode(F.lit("NSString"), "UTF-8"), F.unhex(F.lit("019484012B")), tag, data)


@query("SELECT doc_id, text AS body FROM documents UNION ALL SELECT -1 - doc_id, repeat(text, 40) FROM documents WHERE length(text) BETWEEN 2000 AND 2200")
def typedstream_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    long = docs.filter(F.length("text").between(2000, 2200)).select((-1 - F.col("doc_id")).alias("doc_id"), F.repeat("text", F.lit(40)).alias("text"))
    return docs.unionByName(long).select("doc_id", typedstream_text(encode_typedstream(F.col("text"))).alias("body"))


@query("SELECT c_custkey, regexp_replace('+1 (' || c_custkey || ') 555-' || c_nationkey, '[^0-9]', '', 'g') || '@s.whatsapp.net' AS jid, c_name || '@g.us' AS kept FROM customer")
def jid_normalize(spark, sf_dir):
    number = F.concat(F.lit(" +1 ("), F.col("c_custkey").cast("string"), F.lit(") 555-"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", to_jid(number).alias("jid"), to_jid(F.concat(F.lit(" "), F.col("c_name"), F.lit("@g.us "))).alias("kept"))


@query(f"SELECT k AS user_id, id AS event_id, (row_number() OVER (PARTITION BY k ORDER BY t // 3600, id))::bigint AS place FROM ({EVENTS})")
def ordered_with_tiebreak(spark, sf_dir):
    """Hours as the raw date: many ties, which the id breaks."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.call_function("div", F.col("t"), F.lit(3600).cast("bigint")), "event_id")
    return timed_events(spark, sf_dir).select("user_id", "event_id", F.row_number().over(order).cast("bigint").alias("place"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only on one machine there is a default."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or '/tmp/confab-shared').rstrip('/')}/jsonl-{uuid.uuid4().hex}"


@query(RECORDS.replace("to_json(list({'t': t, 'me': me, 'from': sender, 'text': props} ORDER BY ord, id))::varchar AS messages", "count(*) AS n, count(*) FILTER (sender IS NULL) AS own"))
def jsonl_roundtrip(spark, sf_dir):
    records = session_records(event_messages(spark, sf_dir))
    path = shared_folder(spark)
    write_jsonl(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.select("chat_id", "chat", "group", "start", "end", F.size("messages").cast("bigint").alias("n"), F.size(F.filter("messages", lambda m: m["from"].isNull())).cast("bigint").alias("own"))


def apple_shape(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The events as an Apple archive: each is in its user's chat, each tenth in a second one; every fifth body is a blob, every seventh blank."""
    events = timed_events(spark, sf_dir)
    id_, kind = F.col("event_id"), F.col("event_type")
    message = events.select(
        id_.alias("ROWID"),
        ((F.col("ord") - 1704067200000000) * 1000).alias("date"),
        (kind == "purchase").cast("int").alias("is_from_me"),
        F.when(kind != "error", F.col("user_id") % 50).alias("handle_id"),
        F.when(id_ % 7 == 0, f" {PLACEHOLDER} ").when(id_ % 5 != 0, F.col("props")).alias("text"),
        F.when(id_ % 5 == 0, encode_typedstream(F.col("props"))).alias("attributedBody"),
        F.when(id_ % 11 == 0, 2000).otherwise(0).alias("associated_message_type"),
    )
    bridge = events.select(F.col("user_id").alias("chat_id"), id_.alias("message_id")).unionByName(events.filter(id_ % 10 == 0).select((F.col("user_id") + 1_000_000).alias("chat_id"), id_.alias("message_id")))
    style = F.when(F.col("c") % 3 == 0, F.lit(43)).when(F.col("c") % 3 == 1, F.lit(45))
    chat = bridge.select(F.col("chat_id").alias("c")).distinct().select(F.col("c").alias("ROWID"), F.concat(F.lit("chat"), F.col("c").cast("string")).alias("chat_identifier"), style.alias("style"))
    handle = spark.range(45).select(F.col("id").alias("ROWID"), F.concat(F.lit("+1415555"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"))
    return {"message": message, "chat_message_join": bridge, "chat": chat, "handle": handle}


#: A handle past the table's end is null, as is an error's: what isn't one's own and has no sender is an event of the system.
APPLE_RECORDS = f"""WITH links AS (SELECT user_id AS k, * FROM events UNION ALL SELECT user_id + 1000000, * FROM events WHERE event_id % 10 = 0),
m AS (SELECT k, epoch_us(ts) AS ord, event_id AS id, (epoch_us(ts) - 1704067200000000) * 1000 // 1000000000 + {APPLE_EPOCH} AS t, event_type = 'purchase' AS me,
  CASE WHEN event_type <> 'error' AND user_id % 50 < 45 THEN '+1415555' || lpad((user_id % 50)::varchar, 4, '0') END AS sender,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE trim(props, {{ws}}) END AS body
  FROM links WHERE event_id % 11 <> 0),
c AS (SELECT * FROM m WHERE (me OR sender IS NOT NULL) AND body <> '')
SELECT k AS chat_id, 'chat' || k AS chat, k % 3 = 0 AS "group", min(t) AS start, max(t) AS "end",
  to_json(list({{{{'t': t, 'me': me, 'from': CASE WHEN NOT me THEN sender END, 'text': body}}}} ORDER BY ord, id))::varchar AS messages
FROM ({CUT.format(gap=GAP_SECONDS, source="SELECT * FROM c")}) GROUP BY k, session_no""".format(ws=_sql_text(PY_WS))


@query(APPLE_RECORDS)
def apple_archive_records(spark, sf_dir):
    """The shipped adapter and cleaner, from an archive's tables to session records."""
    records = session_records(clean_apple(apple_messages(apple_shape(spark, sf_dir))))
    return records.withColumn("messages", F.to_json("messages", {"ignoreNullFields": "false"}))


def whatsapp_shape(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The events as a WhatsApp archive: a chat for each user, message types by id, members for two thirds of the group messages."""
    events = timed_events(spark, sf_dir)
    id_, user = F.col("event_id"), F.col("user_id")
    message = events.select(
        id_.alias("Z_PK"),
        user.alias("ZCHATSESSION"),
        ((F.col("ord") - 1704067200000000) / 1_000_000 + 0.25).alias("ZMESSAGEDATE"),
        (F.col("event_type") == "purchase").cast("int").alias("ZISFROMME"),
        F.when(F.col("event_type") != "error", F.concat(user.cast("string"), F.lit("@s.whatsapp.net"))).alias("ZFROMJID"),
        F.when(id_ % 3 != 0, id_ % 40).alias("ZGROUPMEMBER"),
        F.when(id_ % 7 == 0, "\u00a0\t").when(id_ % 13 != 0, F.concat(F.lit(" "), F.col("props"))).alias("ZTEXT"),
        (id_ % 9).cast("int").alias("ZMESSAGETYPE"),
    )
    kind = F.when(F.col("c") % 3 == 0, F.lit(0)).when(F.col("c") % 3 == 1, F.lit(1))
    session = events.select(user.alias("c")).distinct().select(F.col("c").alias("Z_PK"), F.concat(F.col("c").cast("string"), F.lit("@g.us")).alias("ZCONTACTJID"), kind.alias("ZSESSIONTYPE"))
    member = spark.range(30).select(F.col("id").alias("Z_PK"), F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("@s.whatsapp.net")).alias("ZMEMBERJID"))
    return {"ZWAMESSAGE": message, "ZWACHATSESSION": session, "ZWAGROUPMEMBER": member}


WHATSAPP_RECORDS = f"""WITH m AS (SELECT user_id AS k, epoch_us(ts) AS ord, event_id AS id, trunc((epoch_us(ts) - 1704067200000000) / 1000000 + 0.25)::bigint + {APPLE_EPOCH} AS t, event_type = 'purchase' AS me,
  coalesce(CASE WHEN event_id % 3 <> 0 AND event_id % 40 < 30 THEN 'm' || (event_id % 40) || '@s.whatsapp.net' END, CASE WHEN event_type <> 'error' THEN user_id || '@s.whatsapp.net' END) AS sender,
  CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN '' ELSE trim(props, {{ws}}) END AS body
  FROM events WHERE event_id % 9 IN {TEXT_TYPES}),
c AS (SELECT * FROM m WHERE body <> '')
SELECT k AS chat_id, k || '@g.us' AS chat, k % 3 <> 0 AS "group", min(t) AS start, max(t) AS "end",
  to_json(list({{{{'t': t, 'me': me, 'from': CASE WHEN NOT me THEN sender END, 'text': body}}}} ORDER BY ord, id))::varchar AS messages
FROM ({CUT.format(gap=GAP_SECONDS, source="SELECT * FROM c")}) GROUP BY k, session_no""".format(ws=_sql_text(PY_WS))


@query(WHATSAPP_RECORDS)
def whatsapp_archive_records(spark, sf_dir):
    """The other archive's adapter and cleaner; an unknown sender stays."""
    records = session_records(clean_whatsapp(whatsapp_messages(whatsapp_shape(spark, sf_dir))))
    return records.withColumn("messages", F.to_json("messages", {"ignoreNullFields": "false"}))
