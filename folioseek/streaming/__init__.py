"""Refresh by Structured Streaming."""
