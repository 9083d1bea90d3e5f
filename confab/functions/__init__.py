"""Column expressions over message bodies and identifiers."""

from confab.functions.text import PY_WS, message_body, own_or_sender, strip_unicode, to_jid, typedstream_text, without_placeholder

__all__ = ["PY_WS", "message_body", "own_or_sender", "strip_unicode", "to_jid", "typedstream_text", "without_placeholder"]
