"""Readers of chat databases."""

from confab.sources.archives import apple_messages, apple_tables, whatsapp_messages, whatsapp_tables
from confab.sources.sqlite_ro import SqliteReadOnly, register

__all__ = ["SqliteReadOnly", "apple_messages", "apple_tables", "register", "whatsapp_messages", "whatsapp_tables"]
