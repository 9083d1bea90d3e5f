"""DataFrame operators: cleaning, sessions, records, sinks."""

from confab.operators.clean import clean_apple, clean_whatsapp
from confab.operators.export import write_sessions
from confab.operators.records import session_records, summary
from confab.operators.sessionize import GAP_SECONDS, session_numbers, sessionize
from confab.operators.sinks import write_jsonl

__all__ = ["GAP_SECONDS", "clean_apple", "clean_whatsapp", "session_numbers", "session_records", "sessionize", "summary", "write_jsonl", "write_sessions"]
