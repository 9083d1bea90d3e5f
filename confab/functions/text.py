"""Message text as pure Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that Unicode-aware stripping removes (29 of them; none lies above U+3000).
PY_WS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
PLACEHOLDER = "￼"
MARKER = "NSString"
#: Bytes from the marker's start to the length tag: the marker itself and a five-byte type header.
TAG_OFFSET = len(MARKER) + 5
JID_SUFFIX = "@s.whatsapp.net"


def strip_unicode(text: Column) -> Column:
    """Both ends without Unicode white space; ``trim`` alone knows the plain space only."""
    return F.btrim(text, F.lit(PY_WS))


def without_placeholder(text: Column) -> Column:
    """All attachment placeholders removed."""
    return F.replace(text, F.lit(PLACEHOLDER), F.lit(""))


def _unsigned(data: Column) -> Column:
    """Bytes, most significant first, as an unsigned integer; no bytes: 0."""
    return F.coalesce(F.conv(F.hex(data), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def _little_endian(blob: Column, at: Column, width: int) -> Column:
    """Taken byte by byte: reversing a binary column would reverse it as text."""
    return _unsigned(F.concat(*[F.substring(blob, at + i, F.lit(1)) for i in reversed(range(width))]))


def typedstream_text(blob: Column) -> Column:
    """The first string of a typedstream blob.

    A one-byte tag gives the length, or 0x81/0x82 announces a two-/four-byte little-endian one. Null blobs, blobs
    without the marker and blobs that end with the header give ''. A length past the end takes what is there; bytes that
    aren't UTF-8 become U+FFFD.
    """
    mark = F.locate(MARKER, F.decode(blob, "ISO-8859-1"))
    at = mark + TAG_OFFSET
    tag = _unsigned(F.substring(blob, at, F.lit(1)))
    start = at + F.when(tag == 0x81, 3).when(tag == 0x82, 5).otherwise(1)
    length = F.when(tag == 0x81, _little_endian(blob, at + 1, 2)).when(tag == 0x82, _little_endian(blob, at + 1, 4)).otherwise(tag)
    bounded = F.least(length, F.octet_length(blob).cast("bigint")).cast("int")
    body = F.make_valid_utf8(F.substring(blob, start, bounded).cast("string"))
    return F.when(mark > 0, F.coalesce(body, F.lit(""))).otherwise(F.lit(""))


def message_body(text: Column, blob: Column) -> Column:
    """The text if it isn't empty, else what the blob holds, else ''."""
    return F.when(text != "", text).otherwise(typedstream_text(blob))


def to_jid(chat: Column) -> Column:
    """A JID as it is, anything else as its ASCII digits and the user suffix."""
    plain = strip_unicode(chat)
    return F.when(F.contains(plain, F.lit("@")), plain).otherwise(F.concat(F.regexp_replace(plain, "[^0-9]", ""), F.lit(JID_SUFFIX)))


def own_or_sender(me: Column, sender: Column) -> Column:
    """No sender on one's own turns."""
    return F.when(~me, sender)
