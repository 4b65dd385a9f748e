"""Structured Streaming: page replay into frontier tables, event windows."""
