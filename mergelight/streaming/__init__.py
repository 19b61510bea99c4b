"""Structured Streaming forms of the event, status and scan operators."""
