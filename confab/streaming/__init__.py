"""Sessions over unbounded input (an extension: batch is the primary form)."""

from confab.streaming.sessions import stream_sessions

__all__ = ["stream_sessions"]
