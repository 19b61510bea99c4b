"""Whole reviews put together from operators."""
