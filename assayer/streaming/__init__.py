"""Structured Streaming: live scoring and monitor views."""
